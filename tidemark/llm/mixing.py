"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. All its documents get the whole copies that the target holds
for certain; the remainder is a sample without replacement in which a document's inclusion probability
grows with the logarithm of its length. Documents are ranked by random odds divided by inclusion odds,
u / (1 - u) over p / (1 - p), and taken in this order while the remainder holds. Then the order is gone through
again among the documents no larger than what is left, round by round until none fits. Last, the one
document whose size comes closest to what is left is added if it brings the source nearer to its target.

All of it is DataFrame operations. Ranks are cut by two levels of 1,024 bins a source, which are
summed before the shuffle, and only the documents of the one bin that the cut falls into are ordered
exactly. So a source with a third of all documents is ordered nowhere as a whole, and the decision for
a document is a comparison with the bounds and cuts of its source's rounds.

Every row is a unit of its own. Rows that share doc_id, source and size are numbered, and the number takes
part in the draw, so that as many of them are taken as the target asks for. Rows are joined with documents
only to find which ones are repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import work_dir

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 20240601
ROUND = "struct<most:double,cut:struct<rank:bigint,doc_id:bigint,part:bigint,size:bigint>>"
_BITS = 10
_SCALE = 1 << 40
_CHUNK = 1 << 16
_KEY = ("doc_id", "source", "size")


def word_count(text: Column) -> Column:
    """Words of a text: runs of code points other than 0x20 and 0x09-0x0D; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text.cast("string"), r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of a table with source and size.

    Sources by code point, null last, take the weights in turn. Together the targets are the sum of all
    sizes; none is above ``most`` times its source's size, and what is cut off is shared out by weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.lit(list(weights)), (turn + 1).cast("int")))
    sources = sources.withColumn("most", most * F.col("source_size"))
    # Sources that reach their limit first come first; the level is where the first one stays below it.
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, every = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sources = sources.withColumn("level", free / open_weight)
    level = F.first(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")), ignorenulls=True).over(every)
    target = F.least(F.col("most").cast("double"), F.coalesce(level * F.col("weight"), F.col("most").cast("double")))
    return sources.select("source", "source_size", target.alias("target"))


def _preference() -> Column:
    """Relative inclusion of a document, in whole thousandths so that sums are exact."""
    return F.round(1000 * F.log(2 + F.col("size"))).cast("long")


def _rank() -> Column:
    """The Pareto rank, u/(1-u) over p/(1-p), mapped to 0 .. 2^40 in the same order."""
    p = F.least(F.lit(0.999999), F.col("rest") * F.col("preference") / F.col("mean_preference"))
    draw = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    draw = F.when(F.col("part") == 0, draw).otherwise(F.xxhash64(draw, F.col("part")))
    u = (F.pmod(draw, F.lit(1 << 52)) + 0.5) / (1 << 52)
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.when(F.col("rest") > 0, F.floor(odds / (1 + odds) * _SCALE))


def _joined(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's columns, null source to null source."""
    names = [F.col(f"s.{name}") for name in sources.columns if name != "source"]
    return rows.alias("r").join(sources.alias("s"), F.expr("r.source <=> s.source")).select("r.*", *names)


def _joined_left(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """As ``_joined``, rows without a source's columns too."""
    names = [F.col(f"s.{name}") for name in sources.columns if name != "source"]
    return rows.alias("r").join(sources.alias("s"), F.expr("r.source <=> s.source"), "left").select("r.*", *names)


def _place() -> Column:
    return F.struct("rank", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "part", "size")


def _in_rounds() -> Column:
    """Whether one of the source's rounds takes a document of its size at ``place``."""
    return F.exists("rounds", lambda r: (r["most"].isNull() | (F.col("size") <= r["most"])) & (r["cut"].isNull() | (F.col("place") < r["cut"])))


def _cut(waiting: DataFrame, state: DataFrame, written: Callable[[DataFrame, str], DataFrame], turn: int) -> DataFrame:
    """(source, cut): the place of the first document, in order, that does not fit; no row where all fit."""
    # Two levels of bins, then the exact order within the bin that holds the cut.
    cuts, inside = state.select("source", "left", F.lit(0).cast("decimal(38,0)").alias("taken")), waiting
    for level in (1, 2):
        bin_of = F.pmod(F.shiftright("rank", 40 - _BITS * level), F.lit(1 << _BITS))
        binned = inside.withColumn("bin", bin_of)
        order = Window.partitionBy("source").orderBy("bin")
        bins = binned.groupBy("source", "bin").agg(F.sum("size").cast("decimal(38,0)").alias("words"))
        bins = _joined(bins.withColumn("upto", F.sum("words").over(order)), cuts.select("source", "taken", "left"))
        crossing = bins.where(F.col("taken") + F.col("upto") > F.col("left")).groupBy("source").agg(
            F.min_by(F.struct("bin", (F.col("taken") + F.col("upto") - F.col("words")).cast("decimal(38,0)").alias("taken"), "left"), "bin").alias("c"))
        cuts = written(crossing.select("source", "c.bin", "c.taken", "c.left"), f"cuts-{turn}-{level}")
        inside = _joined(binned, cuts.select("source", F.col("bin").alias("cut_bin"))).where("bin = cut_bin").drop("bin", "cut_bin")
    order = Window.partitionBy("source").orderBy("place")
    last = _joined(inside.withColumn("upto", F.sum("size").over(order)), cuts.select("source", "taken", "left"))
    return last.where(F.col("taken") + F.col("upto") > F.col("left")).groupBy("source").agg(F.min("place").alias("cut"))


def _further_rows(groups: DataFrame) -> DataFrame:
    """Units of the second and later rows of repeated ones; a long run is unfolded by many tasks."""
    last = F.col("rows") - 1
    chunks = groups.select(*_KEY, "preference", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / _CHUNK))).alias("chunk"))
    parts = F.sequence(F.greatest(F.lit(1), F.col("chunk") * _CHUNK), F.least(last, (F.col("chunk") + 1) * _CHUNK - 1))
    return chunks.repartition(*_KEY, "chunk").select(*_KEY, "preference", F.explode(parts).alias("part"))


def mixing_plan(spark: SparkSession, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per source that decides every document's copies, and (doc_id, source, size, rows) of repeated rows.

    ``sizes`` has doc_id, source and size. Rows that share all three are numbered 0, 1, and so on.
    """
    folder = work_dir(spark, "mixing")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    groups = sizes.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows")).withColumn("words", F.col("rows") * F.col("size"))
    groups = written(groups.withColumn("preference", _preference()), "groups")
    share = F.sum(F.col("preference").cast("decimal(38,0)") * F.col("words")) / F.nullif(F.sum("words"), F.lit(0))
    preference = groups.groupBy("source").agg(share.cast("double").alias("mean_preference"))
    targets = source_targets(groups.select("source", F.col("words").alias("size")))
    repeated = written(groups.where("rows > 1").select(*_KEY, "rows"), "repeated")
    units = groups.select(*_KEY, "preference", F.lit(0).cast("long").alias("part"))
    if not repeated.isEmpty():
        units = units.union(_further_rows(groups.where("rows > 1")))
    copies = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("int")
    sources = _joined(targets, preference).withColumn("copies", copies)
    sources = sources.withColumn("gap", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
    sources = sources.withColumn("rest", F.coalesce(F.col("gap") / F.nullif("source_size", F.lit(0)), F.lit(0.0)))
    sources = written(sources, "sources")
    ranked = written(_joined(units, sources.select("source", "rest", "mean_preference")).withColumn("rank", _rank())
                     .where("rank is not null and size > 0").select(*_KEY, "part", "rank"), "ranked")

    # A round takes, of the documents not taken and no larger than what is left, those before its cut.
    state = sources.withColumns({"left": F.col("gap"), "rounds": F.array().cast(f"array<{ROUND}>")})
    waiting, turn = ranked.withColumn("place", _place()), 0
    while True:
        if turn:
            waiting = _joined(waiting, state.select("source", "left")).where("size <= left").drop("left")
        waiting = written(waiting, f"waiting-{turn}")
        if turn and waiting.isEmpty():
            break
        cut = written(_cut(waiting, state, written, turn), f"cut-{turn}")
        tried = _joined_left(waiting, cut)
        ahead = F.col("cut").isNull() | (F.col("place") < F.col("cut"))
        got = tried.where(ahead).groupBy("source").agg(F.sum("size").alias("got"))
        most = F.when(F.lit(turn > 0), F.col("left"))
        state = _joined_left(_joined_left(state, cut), got).withColumns({
            "rounds": F.array_append("rounds", F.struct(most.alias("most"), F.col("cut").alias("cut"))),
            "left": F.col("left") - F.coalesce("got", F.lit(0))}).drop("cut", "got")
        state = written(state, f"left-{turn}")
        waiting = tried.where(~ahead).drop("cut")
        turn += 1
    # The rest may be exceeded by one document that brings the source nearer to its target.
    miss = F.abs(F.col("size") - F.col("left"))
    outside = _joined(ranked.withColumn("place", _place()), state.select("source", "left", "rounds")).where(
        ~_in_rounds() & (miss < F.col("left")))
    fill = outside.groupBy("source").agg(F.min_by("place", F.struct(miss.alias("miss"), "place")).alias("fill"))
    return written(_joined_left(state, fill), "plan"), repeated


def _numbered(spark: SparkSession, rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` with ``part``, their number among the rows of equal doc_id, source and size.

    Repeated rows are written with the partition they were read in. They are counted by partition and numbered
    within it, so equal rows never have to meet in one task.
    """
    same = F.expr(" and ".join(f"r.{name} <=> s.{name}" for name in _KEY))
    both = rows.alias("r").join(repeated.alias("s"), same, "left").select("r.*", F.col("s.rows").alias("rows"))
    single = both.where("rows is null").select(*rows.columns, F.lit(0).cast("long").alias("part"))
    if repeated.isEmpty():
        return single
    path = f"{work_dir(spark, 'mixing-repeated')}/rows"
    several = both.where("rows is not null").drop("rows")
    several.withColumns({"shard": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).write.parquet(path)
    several = spark.read.parquet(path)
    before = Window.partitionBy(*_KEY).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = several.groupBy(*_KEY, "shard").agg(F.count(F.lit(1)).alias("n"))
    shards = shards.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # Only ids are ordered; whole rows are joined with their numbers.
    place = F.row_number().over(Window.partitionBy(*_KEY, "shard").orderBy("row")) - 1
    numbers = several.select(*_KEY, "shard", "row").withColumn("place", place)
    same = F.expr(" and ".join(f"r.{name} <=> s.{name}" for name in (*_KEY, "shard")))
    numbers = numbers.alias("r").join(shards.alias("s"), same).select("row", (F.col("place") + F.col("base")).alias("part"))
    return single.union(several.join(numbers, "row").select(*rows.columns, "part"))


def with_copies(spark: SparkSession, rows: DataFrame, plan: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` (with doc_id, source and size) with source_size, target and taken_copies."""
    both = _joined(_numbered(spark, rows, repeated), plan)
    both = both.withColumn("preference", _preference()).withColumn("rank", _rank()).withColumn("place", _place())
    sampled = F.col("rank").isNotNull() & (_in_rounds() | F.coalesce(F.col("place") == F.col("fill"), F.lit(False)))
    both = both.withColumn("taken_copies", F.col("copies") + F.when(sampled, 1).otherwise(0))
    return both.select(*rows.columns, "source_size", "target", "taken_copies")


def _sized(docs: DataFrame, carry: list[str]) -> DataFrame:
    return docs.select(F.struct(*carry).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def mixture(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` is the row's size times its copies, at most three. A null or blank text has size 0. Null
    sources are a source of their own, the last. Repeated rows are decided one by one: how many of them are
    taken is fixed, which ones is not. A null doc_id is an id like any other. Empty in, empty out.
    """
    folder = work_dir(spark, "mixture")
    _sized(docs, ["doc_id"]).drop("doc").write.parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes")
    out = with_copies(spark, sizes, *mixing_plan(spark, sizes))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken_copies")).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken, with its own columns."""
    folder = work_dir(spark, "mixed")
    _sized(docs, ["doc_id"]).drop("doc").write.parquet(f"{folder}/sizes")
    plan = mixing_plan(spark, spark.read.parquet(f"{folder}/sizes"))
    taken = with_copies(spark, _sized(docs, docs.columns), *plan).where("taken_copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), "taken_copies"))).select("doc.*")
