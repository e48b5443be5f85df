"""Language-model scores of whole documents: unigram base and a gated recurrent model.

Tokens are the case-folded words of a text and one end. Counts are taken over every training
document. The model predicts the 4,096 most frequent tokens one by one. Rarer tokens seen at least twice, as far
as they travel with the tasks, fall into 64 bands of frequency with equal counts; the model predicts the band, and
the token is its smoothed share of the band's counts. The rest class has the tokens seen once, those joined, and
unknown ones alike. So all words, known or not, share one unit of probability.

Training is data parallel: each task runs truncated backpropagation over its share of the training
documents, from common weights, and Spark averages the resulting weights by their tokens. Each of ``ROUNDS``
rounds uses another part of the training documents, dealt by hash, so that after the last one every training
document was learned from once.

Counts of up to ``FREQUENT`` tokens (a fixed bound) travel with the tasks. The others are joined: each
document sends its distinct rare tokens once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels, recurrent
from tidemark.session import work_dir

FREQUENT = 1 << 18
ROUNDS = 2
FOLDS, HELD_OUT = 7, 2
PIECE_BYTES = 24 << 20
END_HASH = np.uint64(0x5851F42D4C957F2D)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of every text, each with its end token, and their bounds."""
    words, bounds = kernels.word_hashes(column)
    return np.insert(words, bounds[1:], END_HASH), bounds + np.arange(len(bounds))


def held_out(doc_id) -> object:
    """Whether crc32 of the id as text leaves 2 modulo 7; a null id is training data."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in kernels.pieces(batches, "text", PIECE_BYTES):
        token, count = np.unique(tokens_of(piece.column("text"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count, pa.int64())], ["token", "count"])


class Lookup:
    """Places of token hashes in a fixed table, found through their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.first = np.searchsorted(self.keys >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64))
        self.deep = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash in the keys as given, -1 where it has none."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> np.uint64(44)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < end)
        for step in range(self.deep):
            place = at[left] + step
            same = self.keys[place] == hashes[left]
            out[left[same]] = self.order[place[same]]
            left = left[~same & (place + 1 < end[left])]
        return out


class Vocabulary:
    """The most frequent training tokens, by falling count, with the corpus totals."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.lexsort((tokens, -counts))
        self.tokens, self.counts = tokens[order].view(np.uint64), counts[order]
        self.total, self.distinct = total, distinct
        self.own = min(len(self.tokens), recurrent.WORDS)
        numbered = max(self.own, int(np.count_nonzero(self.counts > 1)))
        banded = self.counts[self.own:numbered]
        band = (np.cumsum(banded) - banded) * recurrent.BANDS // max(int(banded.sum()), 1)
        self.bands = np.bincount(band, banded, recurrent.BANDS)
        self.rest_total = total - int(self.counts[:numbered].sum())
        self.rest_distinct = distinct - numbered
        # By place, and last for a token that has none.
        self.numbers = np.concatenate([np.arange(self.own), recurrent.REST + 1 + band, np.full(len(self.tokens) - numbered + 1, recurrent.REST)])
        # What a token has within its band; of a token of the rest, without the rest's size.
        self.within = np.append(np.log10(self.counts + 1.0), 0.0)
        self.within[:self.own] = 0
        self.within[self.own:numbered] -= np.log10(self.bands[band] + np.bincount(band, minlength=recurrent.BANDS)[band])

    def lookup(self) -> Lookup:
        return Lookup(self.tokens)


def _vocabulary(stored: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary and the least count bin that it holds; tokens of lower bins are joined instead."""
    whole = stored.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).first()
    bin_of = F.floor(64 * F.log2("count"))
    bins = sorted(stored.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("v")).collect(), reverse=True)
    least, held = 1 << 30, 0
    for row in bins:  # a few thousand bins at most
        if held + row.v > FREQUENT:
            break
        least, held = row.bin, held + row.v
    frequent = stored.where(bin_of >= least).toArrow()
    tokens, counts = (frequent.column(name).to_numpy() for name in ("token", "count"))
    return Vocabulary(tokens, counts, int(whole.n or 0), int(whole.v)), least


def _numbered(vocabulary: Vocabulary, places: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    numbers = vocabulary.numbers[places]
    return [numbers[low:high] for low, high in zip(bounds[:-1], bounds[1:], strict=True)]


def _taught(vocabulary: Vocabulary, weights: recurrent.Weights):
    """One row of weights from each task that saw training documents."""

    def taught(batches):
        learner, lookup = recurrent.Learner(weights), vocabulary.lookup()
        for piece in kernels.pieces(batches, "text", PIECE_BYTES):
            tokens, bounds = tokens_of(piece.column("text"))
            learner.learn(_numbered(vocabulary, lookup.find(tokens), bounds))
        if learner.seen:
            flat = learner.w.flat()
            yield pa.RecordBatch.from_arrays(
                [pa.array([learner.seen], pa.int64()), kernels.lists(flat, np.array([0, len(flat)]), pa.float32())], ["seen", "weights"])

    return taught


def train(docs: DataFrame, vocabulary: Vocabulary, folder: str) -> recurrent.Weights:
    """Weights averaged over all tasks; ``docs`` holds the training documents (doc_id, text)."""
    weights = recurrent.start(vocabulary.counts[:vocabulary.own], vocabulary.rest_total, vocabulary.bands)
    for turn in range(ROUNDS):
        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ROUNDS)) == turn).select("text")
        path = f"{folder}/weights-{turn}"
        part.mapInArrow(_taught(vocabulary, weights), "seen long, weights array<float>").write.parquet(path)
        each = docs.sparkSession.read.parquet(path).select("seen", F.posexplode("weights").alias("place", "value"))
        mean = each.groupBy("place").agg((F.sum(F.col("value") * F.col("seen")) / F.sum("seen")).alias("value")).toArrow()
        if mean.num_rows:  # as many rows as the model has weights
            flat = np.empty(mean.num_rows)
            flat[mean.column("place").to_numpy()] = mean.column("value").to_numpy()
            weights = weights.like(flat)
    return weights


def _scored(vocabulary: Vocabulary, weights: recurrent.Weights):
    """Per document what the frequent tokens and the model give, and the rare tokens still to be joined."""

    def scored(batches):
        lookup, seen = vocabulary.lookup(), 0
        gains = np.log10(vocabulary.counts + 1.0)
        for piece in kernels.pieces(batches, "text", PIECE_BYTES):
            tokens, bounds = tokens_of(piece.column("text"))
            places = lookup.find(tokens)
            known = places >= 0
            value = np.where(known, gains[places] if len(gains) else 0.0, 0.0)
            rest = vocabulary.numbers[places] == recurrent.REST
            sums = [np.add.reduceat(x, bounds[:-1]) for x in (known.astype(np.int64), value, vocabulary.within[places], rest.astype(np.int64))]
            model = recurrent.score(weights, _numbered(vocabulary, places, bounds))
            rare, rare_bounds, often = [], [0], []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                token, count = np.unique(tokens[low:high][~known[low:high]], return_counts=True)
                rare.append(token)
                often.append(count)
                rare_bounds.append(rare_bounds[-1] + len(token))
            rows = piece.num_rows
            number = (TaskContext.get().partitionId() << 40) + seen + np.arange(rows)
            seen += rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), piece.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), *map(pa.array, sums), pa.array(model),
                 kernels.lists(np.concatenate(rare).view(np.int64), np.array(rare_bounds), pa.int64()),
                 kernels.lists(np.concatenate(often), np.array(rare_bounds), pa.int32())],
                ["row", "doc_id", "n_tokens", "known", "gain", "rest_gain", "n_rest", "model", "rare", "often"])

    return scored


def language_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    A null or blank text is one end token. Repeated rows are scored each, and count in training as
    often as they stand. Without training documents every token is unknown. Other columns are not read.
    """
    folder = work_dir(spark, "language-model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = rows.where(~held_out(F.col("doc_id")))
    counts = training.select("text").mapInArrow(_counted, "token long, count long")
    counts.groupBy("token").agg(F.sum("count").alias("count")).write.parquet(f"{folder}/counts")
    stored = spark.read.parquet(f"{folder}/counts")
    vocabulary, least = _vocabulary(stored)
    weights = train(training, vocabulary, folder)
    kind = ("row long, doc_id long, n_tokens long, known long, gain double, rest_gain double, n_rest long, model double, "
            "rare array<long>, often array<int>")
    rows.mapInArrow(_scored(vocabulary, weights), kind).write.parquet(f"{folder}/scored")
    scored = spark.read.parquet(f"{folder}/scored")
    wanted = scored.select("row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select(
        "row", F.col("x.rare").alias("token"), F.col("x.often").alias("often"))
    rare = wanted.join(stored.where(F.floor(64 * F.log2("count")) < least), "token").groupBy("row").agg(
        F.sum("often").alias("more"), F.sum(F.col("often") * F.log10(F.col("count") + 1)).alias("more_gain"))
    both = scored.drop("rare", "often").join(rare, "row", "left")
    more, gain = F.coalesce("more", F.lit(0)), F.coalesce("more_gain", F.lit(0.0))
    every = float(np.log10(vocabulary.total + vocabulary.distinct + 1))
    rest = float(np.log10(vocabulary.rest_total + vocabulary.rest_distinct + 1))
    return both.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + more).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("gain") + gain - F.col("n_tokens") * every).alias("base_score"),
        (F.col("model") / float(np.log(10)) + F.col("rest_gain") + gain - F.col("n_rest") * rest).alias("score"))
