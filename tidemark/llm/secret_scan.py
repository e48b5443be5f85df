"""Secrets in documents: fixed patterns, and spans added by a conditional random field.

The field learns from the patterns' own finds in a bounded sample of windows: what a secret looks like,
what stands around it and in what kind of file, without being shown the patterns' letters or lengths. It
then tags every token of every document and adds what the patterns do not cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import crf
from tidemark.llm.secret_rules import ACCESS, HEX, KINDS, Span, base_spans, shown
from tidemark.session import work_dir

SAMPLE = 2000
HALF_WINDOW = 24
TAGGED = "tagged"
_CHARS = 1 << 20
_ALL_KINDS = (*KINDS, TAGGED)
# A pattern, and texts one of which it needs; they are looked for first, in lower case.
_RULES = ((r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""", ("passw", "secret", "token", "apikey", "api_key")),
          (ACCESS.pattern, ("akia",)), (HEX.pattern, ()))


def _tokens(types: crf.Types, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token type numbers of all texts in a row, and the bounds of the texts."""
    parts = [crf.TOKEN.findall(text) for text in texts]
    starts = np.concatenate([[0], np.cumsum([len(part) for part in parts])]).astype(np.int64)
    return types.number([token for part in parts for token in part]), starts


def secret_tags(text: str, spans: list[Span]) -> np.ndarray:
    """Tags of the tokens of a text whose secrets are known; a token that reaches into one belongs to it."""
    tags, at = [], 0
    known = sorted({(begin, end) for _, _, end, begin in spans})
    last = None
    for match in crf.TOKEN.finditer(text):
        while at < len(known) and known[at][1] <= match.start():
            at += 1
        if at < len(known) and known[at][0] < match.end():
            tags.append(crf.INSIDE if last == at else crf.BEGIN)
            last = at
        else:
            tags.append(crf.OUTSIDE)
            last = None
    return np.array(tags, np.int64)


_WINDOW = "features array<int>, tags array<int>"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a sampled document: around its first secret, around its oddest other token, and one by chance."""
    for batch in batches:
        rows: dict[str, list] = {"features": [], "tags": []}
        for text in batch["text"].to_pylist():
            types = crf.Types()
            numbers, starts = _tokens(types, [text])
            if not len(numbers):
                continue
            tags = secret_tags(text, base_spans(text))
            known = crf.features(types, numbers, starts)
            odd = np.where(tags == crf.OUTSIDE, types.flag(numbers, crf.ODD), 0)
            middles = {int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") % len(numbers)}
            middles |= {int(tags.argmax())} if tags.any() else set()
            middles |= {int(odd.argmax())} if odd.any() else set()
            for middle in sorted(middles):
                low, high = max(0, middle - HALF_WINDOW), middle + HALF_WINDOW
                own = tags[low:high].copy()
                own[0] = min(own[0], crf.BEGIN)
                rows["features"].append(known[low:high].ravel().tolist())
                rows["tags"].append(own.tolist())
        yield pa.RecordBatch.from_pydict({name: pa.array(value, pa.list_(pa.int32())) for name, value in rows.items()})


def has_find(text: Column) -> Column:
    """Whether a pattern finds something in a text; a pattern is tried where a word it needs stands."""
    found, folded = F.lit(False), F.lower(text)
    for rule, needs in _RULES:
        may = F.lit(not needs)
        for word in needs:
            may = may | folded.contains(word)
        found = found | (may & text.rlike(rule))
    return found


def learned(docs: DataFrame, sample: int = SAMPLE) -> crf.Model | None:
    """The field, fitted on at most ``sample`` documents with a pattern's find and as many without.

    They are those with the least hashes of id and text. None where no document has a find. The
    driver gets three windows of 48 tokens a document, 3 kB each.
    """
    hit = has_find(F.col("text"))
    order = F.xxhash64("doc_id", "text")
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = whole.withColumns({"hit": hit, "order": order})
    counts = dict(whole.groupBy("hit").count().collect())
    if not counts.get(True):
        return None

    def under(n: int) -> int:
        """A bound of the hash below which about 1.2 times the sample is found."""
        return min(2**64 - 1, 2**64 * (6 * sample // 5 + 50) // max(n, 1)) - 2**63

    bounds = {kind: under(n) for kind, n in counts.items()}
    # The hash is compared first, so patterns are tried again on few documents only.
    near = whole.where(F.col("order") <= F.lit(max(bounds.values())))
    near = near.where(F.when(F.col("hit"), F.lit(bounds[True])).otherwise(F.lit(bounds.get(False, bounds[True]))) >= F.col("order"))
    path = f"{work_dir(docs.sparkSession, 'secret-sample')}/documents"
    near.write.parquet(path)
    near = docs.sparkSession.read.parquet(path)
    parts = [near.where(F.col("hit") == kind).orderBy("order", "doc_id").limit(sample).select("text") for kind in (True, False)]
    rows = [(r.features, r.tags) for r in parts[0].unionByName(parts[1]).mapInArrow(_windows, _WINDOW).collect()]
    chains = [(np.array(x, np.int64).reshape(-1, crf.FEATURES), np.array(y, np.int64)) for x, y in sorted(rows)]
    return crf.fit(chains)


def tagged_spans(model: crf.Model, types: crf.Types, texts: list[str]) -> list[list[tuple[int, int]]]:
    """Start and end of every secret the field finds in each text."""
    numbers, starts = _tokens(types, texts)
    tags = model.tags(model.emissions(types, numbers, starts), starts)
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    positive = np.flatnonzero(tags)
    for row in np.unique(np.searchsorted(starts, positive, "right") - 1).tolist():
        for tag, match in zip(tags[starts[row]:starts[row + 1]], crf.TOKEN.finditer(texts[row])):
            if tag == crf.BEGIN:
                found[row].append(match.span())
            elif tag == crf.INSIDE:
                found[row][-1] = found[row][-1][0], match.end()
    return found


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about a million characters; a longer text is a run of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > _CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


_COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_tagged long"


def secrets(spark: SparkSession, docs: DataFrame, model: crf.Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per document: counts of the patterns' finds, the digest of their spans, and all spans.

    Spans read ``kind:start:end`` in code points with the end left out, by start and kind; kinds are
    assign, access, hex and, for what the field adds, tagged. A tagged span that a pattern's span covers
    is not listed again. A null text is empty and has no spans. Rows are judged one by one, so repeated
    ids and rows give a row each; other columns are ignored. Without a model one is learned from the
    same documents; where no pattern finds anything, nothing is tagged.

    Documents are read three times, to count, to learn and to scan, and never shuffled; the weights are
    400 kB, whatever the input.
    """
    model = model or learned(docs, sample)
    kept = spark.sparkContext.broadcast(model)
    number = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, types = kept.value, crf.Types()
        for batch in batches:
            ids, at = batch["doc_id"], 0
            for texts in _pieces(batch["text"].to_pylist()):
                tagged = tagged_spans(field, types, texts) if field else [[] for _ in texts]
                rows: dict[str, list] = {name.split()[0]: [] for name in _COLUMNS.split(", ")}
                for text, more in zip(texts, tagged):
                    base = [(start, kind, end) for start, kind, end, _ in base_spans(text)]
                    added = [(a, len(KINDS), b) for a, b in more if not any(start <= a and b <= end for start, _, end in base)]
                    for kind, name in enumerate(KINDS):
                        rows[f"n_{name}"].append(sum(span[1] == kind for span in base))
                    rows["base_sha256"].append(hashlib.sha256(shown(base, KINDS).encode()).hexdigest())
                    rows["spans"].append(shown(sorted(base + added), _ALL_KINDS))
                    rows["n_tagged"].append(len(added))
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(at, len(texts)), **rows})
                at += len(texts)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, f"doc_id {number}, {_COLUMNS}")
