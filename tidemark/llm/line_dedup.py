"""Line deduplication: lines that are equal or a few edits apart form a class, and its first line stays.

Segment-partition edit join. A line is cut into threshold + 1 segments; when two lines are within the
threshold, one segment is equal in both, moved by no more than the edits allow. The index holds the
segments of each line, and a line probes them in lines of its length and up to the threshold shorter.

For a threshold of one edit, the default, keys are longer: one of two halves is equal, and the other half is cut into two again, and
one of its quarters is equal as well. So the index holds, for each line, four keys of its length,
the equal half and the equal quarter. A line probes the keys of its own length (a substitution moves
nothing) and, of the lines one shorter, those whose parts lie before the edit as they stand and those
behind it one further on: eight keys a line, each three quarters of its text. Candidates are verified
by a banded bit-parallel edit distance (Wu-Manber automaton, one word of band bits an error level), once
the common prefix and suffix are cut off.

All of it is DataFrame operations. A line is known by a 64-bit hash of its text, so equal lines collapse
before anything is compared, and from then on lines are shuffled as a few numbers. The distinct lines are
stored in buckets of their hash; the texts of candidates are fetched bucket by bucket, without moving the
others. Lines of any length take part; the threshold is the same for all of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.session import work_dir

LEAST = 1  # code points of a line that is compared for edits: every line that has a word
EDITS = 1
MOST_EDITS = 14  # the band of the verification is a word of 31 bits


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` needs it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _common_prefix(a: Column, b: Column) -> Column:
    """Code points that two strings share at their start, by halving the range."""
    def halved(range_: Column, _: Column) -> Column:
        middle = ((range_["low"] + range_["high"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.struct(F.when(same, middle).otherwise(range_["low"]).alias("low"),
                        F.when(same, range_["high"]).otherwise(F.greatest(middle - 1, range_["low"])).alias("high"))

    shorter = F.least(F.char_length(a), F.char_length(b))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(shorter + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), shorter.alias("high"))
    return F.aggregate(steps, start, halved, lambda range_: range_["low"])


def _automaton(a: Column, b: Column, edits: int) -> Column:
    """Whether b is within ``edits`` of a.

    Word e has a bit for each diagonal of the band: set when the prefix of a that ends on it is within
    e edits of the prefix of b read so far.
    """
    chars_a, chars_b = F.split(a, ""), F.split(b, "")
    start = F.struct(*[F.lit(sum(1 << (edits + d) for d in range(e + 1))).alias(f"r{e}") for e in range(edits + 1)])
    band = (1 << (2 * edits + 1)) - 1

    def run(pattern: Column) -> Column:
        def step(state: Column, read: Column) -> Column:
            equal = F.lit(0)
            for d in range(2 * edits + 1):
                at = read["i"] + d - edits
                same = (at >= 0) & (F.get(pattern, F.greatest(at, F.lit(0))) == read["c"])
                equal = equal + F.when(F.coalesce(same, F.lit(False)), 1 << d).otherwise(0)
            words: list[Column] = []
            for e in range(edits + 1):
                word = state[f"r{e}"].bitwiseAND(equal)
                if e:
                    before = state[f"r{e - 1}"]
                    word = word.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(words[-1], 1))
                words.append(word.bitwiseAND(F.lit(band)))
            return F.struct(*[word.alias(f"r{e}") for e, word in enumerate(words)])

        reads = F.transform(chars_b, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        end = F.char_length(a) - F.char_length(b) + edits
        hit = F.aggregate(reads, start, step, lambda state: state[f"r{edits}"])
        return F.when((end >= 0) & (end <= 2 * edits), F.getbit(hit.cast("long"), end) == 1).otherwise(False)

    return F.when((F.char_length(a) == 0) | (F.char_length(b) == 0), F.char_length(a) + F.char_length(b) <= edits).otherwise(
        _let(chars_a, run))


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two strings are at most ``edits`` apart."""

    def trimmed(x: Column) -> Column:
        def cut(t: Column) -> Column:
            def tested(suffix: Column) -> Column:
                left = F.substring(t["a"], F.lit(1), F.char_length(t["a"]) - suffix)
                right = F.substring(t["b"], F.lit(1), F.char_length(t["b"]) - suffix)
                return _automaton(left, right, edits)

            return _let(_common_prefix(F.reverse(t["a"]), F.reverse(t["b"])), tested)

        return _let(F.struct(F.substring(x["a"], x["p"] + 1, F.char_length(x["a"])).alias("a"),
                             F.substring(x["b"], x["p"] + 1, F.char_length(x["b"])).alias("b")), cut)

    return _let(F.struct(a.alias("a"), b.alias("b"), _common_prefix(a, b).alias("p")), trimmed)


def _key(number: int, length: Column, *parts: Column) -> Column:
    return F.xxhash64(F.lit(number), length, *parts)


def _refined(line: Column, longer: int) -> list[Column]:
    """For one edit: keys of a line, or its probes into lines one code point shorter.

    Parts are (start, end) fractions of the indexed length: a half and a quarter of the other half.
    """
    length = F.char_length(line) - longer
    half, low, high = (length / 2).cast("int"), (length / 4).cast("int"), (length * 3 / 4).cast("int")
    zero = F.lit(0)
    # (number, half start, half end, quarter start, quarter end, half moved, quarter moved)
    parts = [(0, zero, half, half, high, 0, 0), (1, zero, half, high, length, 0, 1),
             (2, half, length, zero, low, 1, 0), (3, half, length, low, half, 1, 1)]
    return [_key(number, length, F.substring(line, a + 1 + moved * longer, b - a), F.substring(line, c + 1 + also * longer, d - c))
            for number, a, b, c, d, moved, also in parts]


def _moved(line: Column, longer: int, edits: int, moves: Iterable[int]) -> list[Column]:
    """The ``edits`` + 1 segments of a line ``longer`` code points shorter, cut out of this one moved by each of ``moves``."""
    length = F.char_length(line) - longer
    cuts = [(length * i / (edits + 1)).cast("int") for i in range(edits + 2)]
    return [_key(number, length, F.substring(line, a + 1 + move, b - a)) for number, (a, b) in enumerate(zip(cuts, cuts[1:])) for move in moves]


def _keys(line: Column, edits: int = EDITS) -> list[Column]:
    """Index keys of a line: what lines within ``edits`` of it and no shorter than it look for."""
    return _refined(line, 0) if edits == 1 else _moved(line, 0, edits, [0])


def _probes(line: Column, edits: int = EDITS) -> list[Column]:
    """Keys of lines of this length or up to ``edits`` shorter that this line looks for, besides its own.

    ``edits`` edits leave one of ``edits`` + 1 segments of the shorter line as it is. It is moved by the insertions
    less the deletions before it, and with ``longer`` more insertions than deletions these are (edits - longer) / 2
    at most.
    """
    if edits == 1:
        return _refined(line, 1)
    out = []
    for longer in range(edits + 1):
        deleted = (edits - longer) // 2
        out += _moved(line, longer, edits, [move for move in range(-deleted, longer + deleted + 1) if move or longer])
    return out


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, place (from 0) and line of every line that has a word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("place", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def line_classes(spark: SparkSession, docs: DataFrame, folder: str, edits: int = EDITS) -> DataFrame:
    """(line_id, class) of every line that is within ``edits`` edits of another; the class is its smallest line_id."""
    if not 1 <= edits <= MOST_EDITS:
        raise ValueError(f"edits are 1 to {MOST_EDITS}, not {edits}")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def bucketed(df: DataFrame, name: str) -> tuple[str, DataFrame]:
        """A table in the folder, in as many buckets of line_id as a shuffle has partitions."""
        table = f"{name}_{uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("path", f"{folder}/{name}").bucketBy(buckets, "line_id").saveAsTable(table)
        return table, spark.table(table)

    long = _lines(docs).where(F.char_length("line") >= LEAST).select(F.xxhash64("line").alias("line_id"), "line")
    table, lines = bucketed(long.groupBy("line_id").agg(F.min("line").alias("line")), "lines")
    keyed = lines.select("line_id", F.array(*_keys(F.col("line"), edits)).alias("own"),
                         F.array_distinct(F.array(*_probes(F.col("line"), edits))).alias("probes"))
    keyed = written(keyed, "keys")
    own = keyed.select(F.explode("own").alias("key"), F.col("line_id").alias("a"))
    other = keyed.select(F.explode("own").alias("key"), F.col("line_id").alias("b"), F.lit(False).alias("longer")).union(
        keyed.select(F.explode("probes").alias("key"), F.col("line_id").alias("b"), F.lit(True).alias("longer")))
    pairs = own.join(other, "key").where("a < b or (longer and a <> b)")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).distinct()
    texts = written(lines.join(wanted, "line_id", "left_semi"), "texts")
    spark.sql(f"drop table {table}")
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("line_id").alias(side), F.col("line").alias(f"line_{side}")), side)
    links = written(pairs.where(within(F.col("line_a"), F.col("line_b"), edits)).select("a", "b"), "links")
    return components(spark, links).select(F.col("node").alias("line_id"), F.col("root").alias("class"))


def repeated_lines(spark: SparkSession, docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) for every row of ``docs`` that has a line with a word.

    Lines within ``edits`` edits of each other share a class, whatever their length. Of each class the line with the smallest (doc_id, place) stays; ``removed`` holds the places of the
    others, ascending. A null doc_id comes first. Rows that share a doc_id are one document whose
    places repeat. Null and blank texts have no lines and no row here.
    """
    folder = work_dir(spark, "line-dedup")
    classes = line_classes(spark, docs, folder, edits)
    placed = _lines(docs).select("doc_id", "place", F.xxhash64("line").alias("line_id"))
    placed.join(classes, "line_id", "left").select("doc_id", "place", F.coalesce("class", "line_id").alias("class")).write.parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "place")
    first = placed.groupBy("class").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    gone = F.col("first").isNotNull() & (place > F.col("first"))
    marked = placed.join(first, "class", "left").select("doc_id", "place", gone.alias("gone"))
    out = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("gone").cast("long")).alias("n_removed"),
                                       F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("place")))).alias("removed"))
    return out


def without_repeated_lines(spark: SparkSession, docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all other columns stay."""
    gone = repeated_lines(spark, docs, edits).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("removed").alias("_removed"))
    both = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id")).join(
        gone, F.col("id").eqNullSafe(F.col("_id")), "left")
    lines = F.split(F.col("doc.text").cast("string"), "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("_removed", i)), "\n")
    text = F.when(F.col("_removed").isNull(), F.col("doc.text")).otherwise(kept)
    return both.select(*[text.alias("text") if name == "text" else F.col(f"doc.`{name}`") for name in docs.columns])
