"""Near-duplicate documents by HyperMinHash registers, banding, estimation and exact verification.

A document's set is its distinct five-word shingles. Its sketch has 256 buckets; a bucket keeps, of its
smallest hash, the number of leading zeros (6 bits) and the next 10 bits: one 16-bit register.
Documents with equal sets form one class, found by a digest of the whole set. Classes that agree in
one band of compressed registers are candidates; the register estimate, corrected for chance
collisions, discards those far below the threshold, and whole sets confirm the rest.

No bucket is expanded into all pairs. First every class of a bucket is compared with one member
of the bucket, which ties large groups of near copies together. Then only pairs whose classes are in
different components are compared, between blocks of bounded size that carry whole sets; only
confirmed links leave a task. That loses no link which could change a component, and a bucket's
members never meet in one task.

A link at the threshold is missed with probability (1 - 0.75^4)^48 = 1.2e-8 by the bands, and by the
estimate only when it errs by more than five standard deviations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import kernels
from tidemark.llm.components import components
from tidemark.session import work_dir

BUCKETS = 256
MANTISSA = 10
EMPTY = 65535
BANDS = 48
ROWS = 4
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 1 << 19

_random = np.random.Generator(np.random.PCG64(77))
_DONORS = np.argsort(_random.random((BANDS * ROWS, BUCKETS)), axis=1).astype(np.int64)
_ROW_FACTORS = _random.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = _random.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of 256 registers per sorted set of 64-bit hashes."""
    table = np.full((len(bounds) - 1, BUCKETS), EMPTY, np.uint16)
    if not len(values):
        return table
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bucket = (values >> np.uint64(56)).astype(np.int64)
    place = rows * BUCKETS + bucket
    first = np.empty(len(values), bool)
    first[0] = True
    np.not_equal(place[1:], place[:-1], out=first[1:])
    rest = values[first] << np.uint64(8)
    zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    table.reshape(-1)[place[first]] = zeros.astype(np.uint64) * np.uint64(1 << MANTISSA) + mantissa
    return table


def band_keys(table: np.ndarray) -> np.ndarray:
    """48 band keys per row of registers; an empty bucket borrows from the same donor in every row."""
    codes = table.astype(np.int64)
    filled = table != EMPTY
    columns = np.arange(BANDS * ROWS)
    values = columns % BUCKETS * 65536 + codes[:, columns % BUCKETS]
    row, column = np.nonzero(~filled[:, columns % BUCKETS] & filled.any(axis=1)[:, None])
    for turn in range(BUCKETS):
        if not len(row):
            break
        donor = _DONORS[column, turn]
        found = filled[row, donor]
        values[row[found], column[found]] = donor[found] * 65536 + codes[row[found], donor[found]]
        row, column = row[~found], column[~found]
    grid = values.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    keys = np.zeros(grid.shape[:2], np.uint64)
    for place in range(ROWS):
        keys += kernels.mix(grid[:, :, place]) * _ROW_FACTORS[place]
    return kernels.mix(keys + _BAND_SEEDS).view(np.int64)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets by their registers, less the expected chance collisions."""
    used = (left != EMPTY) | (right != EMPTY)
    equal = ((left == right) & used).sum(axis=-1)
    ratio = np.maximum(n_left, 1) / np.maximum(n_right, 1)
    # Expected collisions of unequal minima; the constant is that of the published estimator.
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 * BUCKETS / (1 << MANTISSA)
    return (equal - chance) / np.maximum(used.sum(axis=-1), 1)


def least_estimate(percent: int) -> float:
    share = percent / 100
    return share - 5 * (share * (1 - share) / BUCKETS) ** 0.5


def _classes_of(values: np.ndarray, bounds: np.ndarray) -> list[int | None]:
    """A 64-bit class number from a digest of each whole set; None for an empty set."""
    return [int.from_bytes(hashlib.md5(values[low:high].tobytes()).digest()[:8], "little", signed=True)
            if high > low else None for low, high in zip(bounds[:-1], bounds[1:], strict=True)]


def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the class of their text instead of the text."""
    for piece in kernels.pieces(batches, "text"):
        classes = pa.array(_classes_of(*kernels.shingle_sets(piece.column("text"))), pa.int64())
        yield pa.RecordBatch.from_arrays([piece.column("doc"), piece.column("doc_id"), classes], ["doc", "doc_id", "class"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in kernels.pieces(batches, "text"):
        values, bounds = kernels.shingle_sets(piece.column("text"))
        table = registers(values, bounds)
        rows = [row.tobytes() for row in table]
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(np.diff(bounds), pa.int64()),
             pa.array(_classes_of(values, bounds), pa.int64()), pa.array(rows, pa.binary())],
            ["doc_id", "n_shingles", "class", "registers"])


def _table_of(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(-1, BUCKETS)


def _table(column: pa.Array) -> np.ndarray:
    return _table_of(column.to_pylist())


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(one) > len(two):
        one, two = two, one
    if not len(one):
        return False
    shared = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            keys = band_keys(_table(part.column("registers")))
            members = np.repeat(part.column("class").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(members)], ["key", "class"])


def _likely(percent: int):
    least = least_estimate(percent)

    def likely(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 4000):
                part = batch.slice(low, 4000)
                left, right = part.column("n_a").to_numpy(), part.column("n_b").to_numpy()
                good = estimate(_table(part.column("r_a")), _table(part.column("r_b")), left, right) >= least
                yield part.select(["a", "b"]).filter(pa.array(good))

    return likely


def _confirmed(percent: int):
    def confirmed(batches):
        for batch in batches:
            sides = []
            for name in ("s_a", "s_b"):
                column = batch.column(name)
                sides.append((column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()))
            good = np.zeros(batch.num_rows, bool)
            (left, at), (right, to) = sides
            for row in range(batch.num_rows):
                good[row] = _similar(left[at[row]:at[row + 1]], right[to[row]:to[row + 1]], percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return confirmed


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in kernels.pieces(batches, "text"):
        values, bounds = kernels.shingle_sets(piece.column("text"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(_classes_of(values, bounds), pa.int64()), kernels.lists(values.view(np.int64), bounds, pa.int64())],
            ["class", "shingles"])


def _crossing(percent: int, left: list, right: list | None, key: int, tables: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a block the likely partners from other components in the other block.

    Without another block the partners come from the same one. A pair that shares several bands is
    looked at in the first of them alone.
    """
    least = least_estimate(percent)
    table, table2 = tables
    keys = band_keys(table)
    keys2 = band_keys(table2) if right else keys
    roots, sizes = (np.array([x[name] for x in left], np.int64) for name in ("root", "n_shingles"))
    roots2, sizes2 = (np.array([x[name] for x in right or left], np.int64) for name in ("root", "n_shingles"))
    band = int(np.flatnonzero(keys[0] == key)[0])
    for i in range(len(left)):
        fit = (roots2 != roots[i]) & (100 * np.minimum(sizes2, sizes[i]) >= percent * np.maximum(sizes2, sizes[i]))
        if not right:
            fit[:i + 1] = False
        spots = np.flatnonzero(fit & ~(keys2[:, :band] == keys[i, :band]).any(axis=1))
        if len(spots):
            spots = spots[estimate(table[i], table2[spots], sizes[i], sizes2[spots]) >= least]
        if len(spots):
            yield i, spots


def _pending(percent: int):
    """The members of two blocks of a bucket that still have a likely partner in another component."""

    def pending(batches):
        for batch in batches:
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                tables = tuple(_table_of([x["registers"] for x in side or left]) for side in (left, right))
                found = set()
                for i, spots in _crossing(percent, left, right, row["key"], tables):
                    found.add(left[i]["class"])
                    found.update((right or left)[j]["class"] for j in spots)
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())],
                                                 ["key", "class"])

    return pending


def _confirmed_across(percent: int):
    """The confirmed links between two blocks of a bucket whose members carry their whole sets."""

    def sets_of(side):
        return [np.array(x["shingles"], np.int64).view(np.uint64) for x in side]

    def across(batches):
        for batch in batches:
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                ours = sets_of(left)
                theirs = sets_of(right) if right else ours
                tables = tuple(registers(np.concatenate(s), np.cumsum([0] + [len(x) for x in s])) for s in (ours, theirs))
                found = [(left[i]["class"], (right or left)[j]["class"])
                         for i, spots in _crossing(percent, left, right, row["key"], tables)
                         for j in spots if _similar(ours[i], theirs[j], percent)]
                yield pa.RecordBatch.from_arrays([pa.array([p[side] for p in found], pa.int64()) for side in (0, 1)], ["a", "b"])

    return across


class NearDuplicates:
    """Shingle-set classes of ``docs`` and the links between them, worked out in the shared folder.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Rows without ``doc_id`` are
    not compared. A null or blank text has an empty set and no link. Repeated rows and rows that
    share a ``doc_id`` are separate members of the class of their own text.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, percent: int = 75):
        self.spark, self.percent, self.folder = spark, percent, work_dir(spark, "near-dedup")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        kind = "doc_id long, n_shingles long, class long, registers binary"
        self.sketches = self._written(self.docs.mapInArrow(_sketch, kind), "sketches")
        named = self.sketches.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
        self.classes = self._written(
            named.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"),
                                       F.first("registers").alias("registers")), "classes")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _side(self, side: str) -> DataFrame:
        return self.classes.select(F.col("class").alias(side), F.col("n_shingles").alias(f"n_{side}"),
                                   F.col("registers").alias(f"r_{side}"))

    def _sets(self, classes: DataFrame, name: str) -> DataFrame:
        """The whole shingle sets of some classes, from the text of one document of each."""
        first = self.classes.join(classes, "class", "left_semi").select(F.col("first_id").alias("doc_id")).distinct()
        texts = self.docs.join(first, "doc_id", "left_semi").select("text")
        return self._written(texts.mapInArrow(_sets, "class long, shingles array<long>"), f"sets-{name}")

    def _confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs of classes whose whole sets reach the threshold."""
        sets = self._sets(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "pairs")
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("class").alias(side), F.col("shingles").alias(f"s_{side}")), side)
        found = pairs.select("a", "b", "s_a", "s_b").mapInArrow(_confirmed(self.percent), "a long, b long")
        return self._written(found.distinct(), "links")

    def _empty(self, df: DataFrame) -> bool:
        return not df.take(1)

    def links(self) -> DataFrame:
        """(a, b) for enough confirmed links to give every component."""
        bands = self.classes.select("class", "registers").mapInArrow(_bands, "key long, class long")
        buckets = bands.groupBy("key").agg(F.min("class").alias("hub"), F.max("class").alias("last"),
                                           F.count(F.lit(1)).alias("members")).where("hub <> last")
        buckets = self._written(buckets, "buckets")
        larger = buckets.where("members > 2").select("key", "hub")
        crowd = self._written(bands.join(larger, "key").select("key", "class", "hub"), "crowd")
        pairs = crowd.where("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b"))
        pairs = pairs.union(buckets.where("members = 2").select(F.col("hub").alias("a"), F.col("last").alias("b"))).distinct()
        near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent
        likely = pairs.join(self._side("a"), "a").join(self._side("b"), "b").where(near)
        tested = self._written(likely.select("a", "n_a", "r_a", "b", "n_b", "r_b").mapInArrow(
            _likely(self.percent), "a long, b long"), "tested")
        links = self._confirm(tested)
        pending = self._pending(crowd, links)
        return links if self._empty(pending) else links.union(self._across(pending))

    def _blocks(self, members: DataFrame, values: str, name: str) -> DataFrame:
        """Pairs of blocks of each bucket; ``members`` has key, class, root, n_shingles and ``values``."""
        many = F.greatest(F.count(F.lit(1)) / BLOCK_MEMBERS, F.sum("n_shingles") / BLOCK_SHINGLES)
        split = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(many).alias("blocks"))
        placed = members.join(split.where("low <> high"), "key")
        placed = placed.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
        member = F.struct("class", "root", "n_shingles", values)
        blocks = self._written(placed.groupBy("key", "block").agg(F.collect_list(member).alias("members")), name)
        left = blocks.select("key", F.col("block").alias("i"), F.col("members").alias("left"))
        right = blocks.select("key", F.col("block").alias("j"), F.col("members").alias("right"))
        within = left.select("key", "left", F.lit(None).cast(right.schema["right"].dataType).alias("right"))
        return within.union(left.join(right, "key").where("i < j").select("key", "left", "right"))

    def _pending(self, crowd: DataFrame, links: DataFrame) -> DataFrame:
        """(key, class, root) of members of buckets that may still have a link to another component."""
        roots = components(self.spark, links).withColumnRenamed("node", "class")
        placed = crowd.select("key", "class").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        placed = self._written(placed, "placed")
        split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        members = placed.join(split.select("key"), "key", "left_semi").join(self.classes.drop("first_id"), "class")
        found = self._blocks(members, "registers", "blocks").mapInArrow(_pending(self.percent), "key long, class long")
        return self._written(found.distinct().join(placed, ["key", "class"]), "pending")

    def _across(self, pending: DataFrame) -> DataFrame:
        sets = self._sets(pending.select("class").distinct(), "pending")
        members = pending.join(sets.withColumn("n_shingles", F.size("shingles").cast("long")), "class")
        found = self._blocks(members, "shingles", "pending-blocks").mapInArrow(_confirmed_across(self.percent), "a long, b long")
        return self._written(found.distinct(), "links-across")

    def _placed(self) -> DataFrame:
        """(class, component_id, first_class): the component's smallest doc_id and the class of the row that bears it."""
        roots = components(self.spark, self.links()).withColumnRenamed("node", "class")
        classes = self.classes.select("class", "first_id").join(roots, "class", "left")
        classes = classes.withColumn("root", F.coalesce("root", "class"))
        first = classes.groupBy("root").agg(F.min(F.struct("first_id", "class")).alias("first"))
        return classes.join(first, "root").select(
            "class", F.col("first.first_id").alias("component_id"), F.col("first.class").alias("first_class"))

    def documents(self) -> DataFrame:
        """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
        light = self.sketches.select("doc_id", "n_shingles", "class")
        out = light.join(self._placed().drop("first_class"), "class", "left")
        component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"),
                          F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

    def representatives(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that stay: one of each component, and all that are not compared.

        A row whose doc_id stands once is decided by it. Rows that share a doc_id are told apart by the class
        of their own text; of those with equal sets one stays, that with the least digest of its columns.
        """
        placed = self._written(self._placed(), "placed-classes")
        stays = F.col("class").isNull() | ((F.col("class") == F.col("first_class")) & (F.col("doc_id") == F.col("component_id")))
        marks = self.sketches.where("doc_id is not null").select("doc_id", "class").join(placed, "class", "left")
        marks = marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(stays).alias("stays")).where("n > 1 or not stays")
        marks = self._written(marks, "marks")
        alone = docs.join(marks.select(F.col("doc_id").alias("_marked")), docs["doc_id"].cast("long") == F.col("_marked"), "left_anti")
        shared = marks.where("n > 1").select("doc_id")
        if self._empty(shared):
            return alone
        rows = docs.select(F.struct(*(docs[f"`{name}`"] for name in docs.columns)).alias("doc"),
                           docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
        rows = rows.join(shared, "doc_id", "left_semi").select("doc", "doc_id", "text")
        kind = T.StructType([rows.schema["doc"], T.StructField("doc_id", T.LongType()), T.StructField("class", T.LongType())])
        judged = rows.mapInArrow(_with_class, kind).join(placed, "class", "left").where(stays).select("doc", "doc_id", "class")
        judged = self._written(judged, "shared-ids")
        digest = F.sha2(F.to_json("doc"), 256)
        one = judged.where("class is not null").groupBy("doc_id", "class").agg(F.min_by("doc", digest).alias("doc"))
        return alone.union(judged.where("class is null").select("doc.*")).union(one.select("doc.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, for every row of ``docs``.

    A row without ``doc_id`` has a null component and is kept. An empty table gives an empty result.
    """
    return NearDuplicates(spark, docs, percent).documents()


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that with the smallest doc_id.

    Rows are removed by their own text: of rows that share a doc_id, only those go whose group another
    row stands for. Of repeated rows one stays. Rows without ``doc_id`` and null or blank texts are not
    compared and stay. Other columns may have any name. Empty in, empty out.
    """
    return NearDuplicates(spark, docs, percent).representatives(docs)
