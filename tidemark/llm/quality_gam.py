"""Quality classifier: a generalised additive model with pairwise interactions.

Each document has sixteen numbers taken from its text alone. The model is a sum of one lookup table per
number and one per chosen pair of numbers. Tables are learned by cyclic boosting: in turn, each number
gets one shallow tree (three leaves) fitted to the present gradients, shrunk and added to its table. Then the
pairs whose best quadrant split promises the largest gain get tables of their own the same way. A
document is scored by finding its bins and adding table entries, for whole batches at once.

The model is fitted on the driver, from a sample of at most ``MOST_ROWS`` labelled rows chosen by hash
(sixteen numbers each); everything else runs over all documents in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels
from tidemark.session import work_dir

MOST_ROWS = 50_000
BINS = 32
CYCLES = 150
PAIR_CYCLES = 60
PAIRS = 8
RATE = 0.1
LEAST_LEAF = 8.0
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_bytes", "symbol_share", "pipe_share", "bang_share", "upper_share", "digit_share", "stop_share",
    "other_alphabet_share", "short_word_share", "long_word_share", "distinct_word_share", "top_word_share",
    "repeat_window_share", "log_line_words", "repeat_line_share",
)


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(characters)] = 1
    return table


# One bit field per byte class, so a single running sum counts several classes.
_CLASSES = [_class(x) for x in (b"#*$%&<>", b"|", b"!", bytes(range(65, 91)), b"0123456789", b".,;:?", bytes(range(0xC3, 0xF5)), b"\n")]


def features(column: pa.Array) -> np.ndarray:
    """A row of sixteen numbers per text; a null or blank text has zeros."""
    data, bounds = kernels.text_buffers(column)
    words, places = kernels.word_hashes(column)
    out = np.zeros((len(column), len(FEATURES)))
    for row in range(len(column)):
        low, high = int(bounds[row]), int(bounds[row + 1])
        own = words[places[row]:places[row + 1]]
        n = len(own)
        if not n:
            continue
        text = data[low:high]
        counts = np.bincount(text, minlength=256)
        symbols, pipes, bangs, upper, digits, stops, other, breaks = (int(counts @ c) for c in _CLASSES)
        spaces = int(counts[0x20] + counts[0x09:0x0E].sum())
        letters = max(high - low - spaces, 1)
        starts, ends = kernels.word_spans(text, np.array([0]))
        lengths = ends - starts
        ordered = np.sort(own)
        edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        top = np.diff(np.append(edges, n)).max()
        windows = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7)
        sums = np.add.reduceat(kernels.mix(own + np.uint64(1)), np.searchsorted(starts, _line_starts(text, starts)))
        out[row] = (
            np.log1p(n), letters / n, symbols / n, pipes / n, bangs / n, upper / letters, digits / letters, stops / n,
            other / letters, (lengths <= 2).mean(), (lengths > 14).mean(), len(edges) / n, top / n,
            1 - len(np.unique(windows)) / max(len(windows), 1), np.log1p(n / len(sums)), 1 - len(np.unique(sums)) / len(sums),
        )
    return out


def _line_starts(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of the words that come first in their line."""
    line = np.searchsorted(np.flatnonzero(text == 0x0A), starts)
    return starts[np.append(True, line[1:] != line[:-1])]


@dataclass
class Model:
    """Bin edges and tables; ``pairs`` names the two numbers of each pair table."""

    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    tables: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), BINS)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edges, values[:, i], "right") for i, edges in enumerate(self.edges)], axis=1)

    def score(self, values: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(values), self.start)
        bins = self.bins(values)
        total = np.full(len(values), self.start)
        for i, table in enumerate(self.tables):
            total += table[bins[:, i]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[:, i], bins[:, j]]
        return 1 / (1 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1)


def _cut(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """The best place to cut bins low..high in two, and its gain."""
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    if not len(left_g):
        return 0.0, low
    gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    gain[(left_h < LEAST_LEAF / 4) | (all_h - left_h < LEAST_LEAF / 4)] = 0
    best = int(np.argmax(gain))
    return float(gain[best]), low + best + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The leaf value of every bin in a tree of up to three leaves."""
    leaves = [(0, len(g))]
    for _ in range(2):
        gain, cut, at = max((*_cut(g, h, *leaf), k) for k, leaf in enumerate(leaves))
        if gain <= 1e-9:
            break
        low, high = leaves.pop(at)
        leaves += [(low, cut), (cut, high)]
    values = np.zeros(len(g))
    for low, high in leaves:
        values[low:high] = g[low:high].sum() / (h[low:high].sum() + 1)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """The best pair of cuts of a two-way table, and its gain."""
    sums = [np.cumsum(np.cumsum(x, 0), 1) for x in (g, h)]
    best = []
    for s in sums:
        corner, right, below = s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1]
        best.append((corner, right, below, s[-1, -1] - corner - right - below))
    gain = sum(_gain(a, b) for a, b in zip(*best, strict=True)) - _gain(sums[0][-1, -1], sums[1][-1, -1])
    for weight in best[1]:
        gain[weight < LEAST_LEAF / 4] = 0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[i, j]), int(i) + 1, int(j) + 1


def fit(values: np.ndarray, labels: np.ndarray) -> Model:
    """A model of label 1; with one class or no rows, a constant one."""
    model = Model()
    if not len(labels) or labels.min() == labels.max():
        model.start = float(labels.mean()) if len(labels) else 0.5
        return model
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(values[:, i], inner)) for i in range(values.shape[1])]
    bins = model.bins(values)
    mean = labels.mean()
    model.start = float(np.log(mean / (1 - mean)))
    total = np.full(len(labels), model.start)

    def gradients():
        p = 1 / (1 + np.exp(-total))
        return labels - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(CYCLES):
        for i in range(values.shape[1]):
            g, h = gradients()
            step = RATE * _tree(np.bincount(bins[:, i], g, BINS), np.bincount(bins[:, i], h, BINS))
            model.tables[i] += step
            total += step[bins[:, i]]
    g, h = gradients()
    promise = []
    for i in range(values.shape[1]):
        for j in range(i + 1, values.shape[1]):
            both = bins[:, i] * BINS + bins[:, j]
            tables = [np.bincount(both, x, BINS * BINS).reshape(BINS, BINS) for x in (g, h)]
            promise.append((_quadrants(*tables)[0], i, j))
    chosen = sorted(promise, reverse=True)[:PAIRS]
    model.pairs = [(i, j) for gain, i, j in chosen if gain > 0]
    model.pair_tables = [np.zeros((BINS, BINS)) for _ in model.pairs]
    for _ in range(PAIR_CYCLES):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = gradients()
            both = bins[:, i] * BINS + bins[:, j]
            tables = [np.bincount(both, x, BINS * BINS).reshape(BINS, BINS) for x in (g, h)]
            gain, a, b = _quadrants(*tables)
            if gain <= 1e-9:
                continue
            step = np.zeros((BINS, BINS))
            for rows in (slice(0, a), slice(a, None)):
                for columns in (slice(0, b), slice(b, None)):
                    step[rows, columns] = RATE * tables[0][rows, columns].sum() / (tables[1][rows, columns].sum() + 1)
            table += step
            total += step[bins[:, i], bins[:, j]]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in kernels.pieces(batches, "text"):
        table = features(piece.column("text"))
        bounds = np.arange(len(table) + 1) * len(FEATURES)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), kernels.lists(table.reshape(-1), bounds, pa.float64())],
                                         ["doc_id", "features"])


def _scores(model: Model):
    def scores(batches):
        for batch in batches:
            values = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(values), pa.float64())], ["doc_id", "score"])

    return scores


def held_out(doc_id, folds: int = 5) -> object:
    """Whether crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns ``labels.quality`` of the documents that are not held out. Null labels and labels of unknown
    documents teach nothing; repeated documents and labels count as often as they stand. Null and blank
    texts are scored as texts without words. Without labels, or with one class alone, all scores are the
    same. Other columns of either table are not read.
    """
    folder = work_dir(spark, "quality-gam")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(_features, "doc_id long, features array<double>").write.parquet(f"{folder}/features")
    stored = spark.read.parquet(f"{folder}/features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    count = known.count()
    if count > most_rows:
        share = int(most_rows * 0.98 / count * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share)
    taught = stored.join(known, "doc_id").select("features", "quality").toArrow()
    values = taught.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    marks = taught.column("quality").to_numpy().astype(float)
    order = np.lexsort([*values.T, marks])  # one order of rows, whatever order they came in
    scored = stored.mapInArrow(_scores(fit(values[order], marks[order])), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
