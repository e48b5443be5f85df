"""Benchmark decontamination by size-partitioned MinHash containment search.

A benchmark item is short and a document may be very long, so the Jaccard similarity of the two says
nothing. As in containment MinHash, only the item is sketched: 32 hash functions each pick the
smallest shingle of the item, and the share of the picks that a document holds estimates how much
of the item it contains. Items are partitioned by size (powers of two): an item of up to 32 shingles
is its own sketch, so its estimate is exact, and a document is searched only in the partitions
whose items it is large enough to contain. Candidates are verified by exact shingle containment.

A pair at the threshold is missed with probability below 1e-9, and never for items of up to 32 shingles.
Items are held by every task, in blocks of about a million shingles; documents are read once per block
and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels

FUNCTIONS = 32
BLOCK_SHINGLES = 1 << 20
_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64)


def hits_needed(percent: int, miss: float = 1e-9) -> int:
    """The most picks that may be asked for while an item at the threshold is missed less often than ``miss``."""
    share, below = percent / 100, 0.0
    for hits in range(FUNCTIONS + 1):
        below += comb(FUNCTIONS, hits) * share**hits * (1 - share) ** (FUNCTIONS - hits)
        if below > miss:
            return max(hits, 1)
    return FUNCTIONS


class _Partition:
    """The sketches of the items of one size class."""

    def __init__(self, items: list[int], sets: list[np.ndarray], percent: int):
        self.least = ceil(percent * min(len(sets[i]) for i in items) / 100)
        keys, owners, weights, self.needed = [], [], [], {}
        for i in items:
            if len(sets[i]) <= FUNCTIONS:
                picks, counts = sets[i], np.ones(len(sets[i]), np.int64)
                self.needed[i] = ceil(percent * len(picks) / 100)
            else:
                picked = [sets[i][np.argmin(kernels.mix(sets[i] ^ seed))] for seed in _SEEDS]
                picks, counts = np.unique(np.array(picked, np.uint64), return_counts=True)
                self.needed[i] = hits_needed(percent)
            keys.append(picks)
            owners.append(np.full(len(picks), i))
            weights.append(counts)
        keys, owners, weights = (np.concatenate(x) for x in (keys, owners, weights))
        order = np.argsort(keys, kind="stable")
        self.owners, self.weights = owners[order], weights[order]
        self.keys, self.starts, self.counts = np.unique(keys[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def candidates(self, shingles: np.ndarray) -> Iterator[int]:
        """Items of which one document's set seems to hold enough."""
        if len(shingles) < self.least:
            return
        close = shingles[self.maybe[shingles >> np.uint64(44)]]
        at = np.minimum(np.searchsorted(self.keys, close), len(self.keys) - 1)
        at = at[self.keys[at] == close]
        hits: dict[int, int] = {}
        for low, count in zip(self.starts[at], self.counts[at], strict=True):
            for spot in range(low, low + count):
                item = int(self.owners[spot])
                hits[item] = hits.get(item, 0) + int(self.weights[spot])
        yield from (item for item, count in hits.items() if count >= self.needed[item])


class Items:
    """One block of benchmark items, ready for search."""

    def __init__(self, rows: list[tuple[int | None, list[int]]], percent: int):
        self.percent = percent
        self.ids = [item for item, _ in rows]
        self.sets = [np.array(values, np.int64).view(np.uint64) for _, values in rows]
        sizes: dict[int, list[int]] = {}
        for i, values in enumerate(self.sets):
            sizes.setdefault(len(values).bit_length(), []).append(i)
        self.partitions = [_Partition(items, self.sets, percent) for _, items in sorted(sizes.items())]

    def found(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) for each item that one document contains."""
        out = []
        for partition in self.partitions:
            for item in partition.candidates(shingles):
                wanted = self.sets[item]
                spots = np.minimum(np.searchsorted(shingles, wanted), len(shingles) - 1)
                shared = int((shingles[spots] == wanted).sum())
                if 100 * shared >= self.percent * len(wanted):
                    out.append((item, shared))
        return out

    def search(self, piece: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) for each document of the piece that contains an item."""
        values, bounds = kernels.shingle_sets(piece.column("text"))
        for row in range(piece.num_rows):
            if bounds[row + 1] > bounds[row]:
                for item, shared in self.found(values[bounds[row]:bounds[row + 1]]):
                    yield row, item, shared


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in kernels.pieces(batches, "text"):
        values, bounds = kernels.shingle_sets(piece.column("text"))
        yield pa.RecordBatch.from_arrays(
            [piece.column("item_id"), kernels.lists(values.view(np.int64), bounds, pa.int64())], ["item_id", "shingles"])


def item_blocks(benchmark: DataFrame, percent: int = 75) -> Iterator[Items]:
    """The items in blocks of about a million shingles, dealt by a hash of their sets.

    Items without words are in no block: no document contains them. Repeated items count once.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sets = rows.mapInArrow(_item_sets, "item_id long, shingles array<long>").where(F.size("shingles") > 0).distinct()
    total = sets.agg(F.sum(F.size("shingles").cast("long"))).first()[0] or 0
    blocks = ceil(total / BLOCK_SHINGLES)
    for block in range(blocks):
        part = sets.where(F.pmod(F.xxhash64("shingles"), F.lit(blocks)) == block)
        got = [(row.item_id, row.shingles) for row in part.collect()]
        if got:
            yield Items(got, percent)


def _matches(items: Items) -> Callable:
    def matches(batches):
        for piece in kernels.pieces(batches, "text"):
            found = list(items.search(piece))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array([row for row, _, _ in found], pa.int64())),
                 pa.array([items.ids[item] for _, item, _ in found], pa.int64()),
                 pa.array([len(items.sets[item]) for _, item, _ in found], pa.int64()),
                 pa.array([shared for _, _, shared in found], pa.int64())],
                ["doc_id", "item_id", "item_shingles", "shared_shingles"])

    return matches


def _clean(items: Items, text: str) -> Callable:
    def clean(batches):
        for piece in kernels.pieces(batches, text):
            keep = np.ones(piece.num_rows, bool)
            only_text = pa.RecordBatch.from_arrays([piece.column(text)], ["text"])
            keep[[row for row, _, _ in items.search(only_text)]] = False
            yield piece.filter(pa.array(keep))

    return clean


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles) for each document that holds most of an item.

    A document holds an item when it has at least ``percent`` of the item's distinct five-word shingles,
    wherever they stand. A text of one to four words has one shingle, its whole sequence. Null and blank
    texts match nothing; null ids are returned as they are; repeated documents are reported each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, item_id long, item_shingles long, shared_shingles long"
    out = None
    for items in item_blocks(benchmark, percent):
        part = rows.mapInArrow(_matches(items), kind)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], kind) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay as they are."""
    for items in item_blocks(benchmark, percent):
        docs = docs.mapInArrow(_clean(items, "text"), docs.schema)
    return docs
