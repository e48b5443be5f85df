"""Quality rules: base rules, then robust multivariate outliers per language and source.

Text statistics are transformed to a vector of five numbers. Each (lang, source) group gets a
minimum-covariance-determinant estimate: centre and covariance of the three quarters of its documents
that lie closest together, found by concentration steps from a median and MAD start. A document whose
squared Mahalanobis distance from its group passes a chi-square quantile is rejected.

All of it is DataFrame operations. A step groups by (lang, source, distance bin), which is summed before
the shuffle, so a group with a third of all documents is no heavier than the others; the closest three
quarters are whole bins up to the one that completes them. Vectors are whole thousandths, so sums are
exact and a rerun gives the same verdicts. Small groups lean on the corpus: its estimate counts as
``PRIOR`` documents of the group. Fixed floors keep a statistic that hardly varies from condemning a
document with a single symbol or repeated line.
"""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import work_dir

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"#*$%&|<>"
SIZE = 5
#: Smallest standard deviation of each statistic: log words, log word length, symbols a word, log repeated lines, repeated share.
#: Of symbols and repeated lines it is their resolution: one symbol in the fewest words that the base rules pass, one line.
FLOORS = (0.5, 0.1, 1 / 50, log(2), 0.1)
SUBSET = 0.75
STEPS = 5
PRIOR = 50
TAIL = 1e-3
UNIT = 1000
GROUP = ("lang", "source")


def _gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * exp(a * log(x) - x - lgamma(a)) if x > 0 else 0.0


def chi_square_below(x: float, degrees: int) -> float:
    return _gamma_share(degrees / 2, x / 2)


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, degrees) < share else (low, middle)
    return high


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` needs it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice."""

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return F.sort_array(F.transform(starts, lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))

        met = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(met, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    count = _let(words, lambda w: _let(windows(w), lambda s: _let(twice(s), covered)))
    return F.when(F.size(words) < 3, 0).otherwise(count)


def text_statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (null: empty), from one split into words."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r")))
    return {
        "n_words": counts["n"],
        "word_chars": F.char_length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": counts["r"],
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    """The transformed statistics in thousandths."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = (F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), F.col("n_symbols") / words,
              F.log1p("n_dup_lines"), F.col("n_repeat_words") / words)
    return [F.round(value * UNIT).cast("long").alias(f"v{i}") for i, value in enumerate(values)]


def _distance() -> Column:
    """Squared Mahalanobis distance: the length of the centred vector times the inverse Cholesky factor."""
    parts = []
    for i in range(SIZE):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + F.col(f"w{i}{j}") * (F.col(f"v{j}") / UNIT - F.col(f"m{j}"))
        parts.append(row * row)
    return sum(parts[1:], parts[0])


def _same_group(left: str, right: str) -> Column:
    return F.expr(" and ".join(f"{left}.{name} <=> {right}.{name}" for name in GROUP))


def _placed(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The rows with their group's estimate; groups are matched null to null."""
    names = [F.col(f"e.{name}") for name in estimates.columns if name not in GROUP]
    return rows.alias("r").join(estimates.alias("e"), _same_group("r", "e"), "left").select("r.*", *names)


def _factored(moments: DataFrame) -> DataFrame:
    """Rows with centre m* and covariance s** get the inverse Cholesky factor w** of the covariance."""
    for j in range(SIZE):
        inner = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        moments = moments.withColumn(f"l{j}{j}", F.sqrt(F.col(f"s{j}{j}") - inner))
        below = {}
        for i in range(j + 1, SIZE):
            inner = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            below[f"l{i}{j}"] = (F.col(f"s{j}{i}") - inner) / F.col(f"l{j}{j}")
        moments = moments.withColumns(below) if below else moments
    for i in range(SIZE):
        row = {f"w{i}{i}": 1 / F.col(f"l{i}{i}")}
        for j in range(i):
            inner = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            row[f"w{i}{j}"] = -inner / F.col(f"l{i}{i}")
        moments = moments.withColumns(row)
    return moments.select(*GROUP, *[f"m{i}" for i in range(SIZE)], *[f"w{i}{j}" for i in range(SIZE) for j in range(i + 1)])


def _start(rows: DataFrame) -> DataFrame:
    """Median and MAD of each statistic, on a grid of hundredths, so a group's values stay few."""
    grid = [F.round(F.col(f"v{i}") / UNIT, 2).alias(f"v{i}") for i in range(SIZE)]
    coarse = rows.select(*GROUP, *grid)
    centre = coarse.groupBy(*GROUP).agg(*[F.median(f"v{i}").alias(f"m{i}") for i in range(SIZE)])
    away = _placed(coarse, centre)
    spread = away.groupBy(*GROUP).agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(SIZE)], *[
        F.median(F.round(F.abs(F.col(f"v{i}") - F.col(f"m{i}")), 2)).alias(f"d{i}") for i in range(SIZE)])
    covariance = {f"s{i}{j}": F.lit(0.0) if i < j else F.pow(F.col(f"d{i}") * 1.4826, F.lit(2)) + FLOORS[i] ** 2
                  for i in range(SIZE) for j in range(i, SIZE)}
    return _factored(spread.withColumns(covariance))


_PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
_SUMS = ["n", *[f"a{i}" for i in range(SIZE)], *[f"p{i}{j}" for i, j in _PAIRS]]


def _closest(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Count, sums and sums of products of the closest three quarters of each group; one row per group."""
    sums = [F.sum(f"v{i}").alias(f"a{i}") for i in range(SIZE)] + [
        F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]
    bin_of = F.floor(32 * F.log2(1 + _distance()))
    bins = _placed(rows, estimates).withColumn("bin", bin_of).groupBy(*GROUP, "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
    group = Window.partitionBy(*GROUP)
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    close = bins.withColumn("before", before).withColumn("total", F.sum("n").over(group))
    close = close.where(F.col("before") < F.ceil(SUBSET * F.col("total")))
    return close.groupBy(*GROUP).agg(*[F.sum(name).alias(name) for name in _SUMS])


def _concentrated(close: DataFrame) -> DataFrame:
    """The next estimate of each group from the sums of its closest documents."""
    whole = close.agg(*[F.sum(F.col(name).cast("decimal(38,0)")).alias(name) for name in _SUMS]).first().asDict()
    count = float(whole["n"] or 1)
    centre = [float(whole[f"a{i}"] or 0) / count / UNIT for i in range(SIZE)]
    # A normal sample's closest three quarters have a smaller covariance than all of it, by this factor.
    factor = SUBSET / chi_square_below(chi_square_quantile(SUBSET, SIZE), SIZE + 2)
    share = F.col("n") / (F.col("n") + PRIOR)
    means = {f"m{i}": F.col(f"a{i}") / F.col("n") / UNIT for i in range(SIZE)}
    covariance = {}
    for i, j in _PAIRS:
        own = F.col(f"p{i}{j}") / F.col("n") / UNIT**2 - F.col(f"m{i}") * F.col(f"m{j}")
        prior = float(whole[f"p{i}{j}"] or 0) / count / UNIT**2 - centre[i] * centre[j]
        covariance[f"s{i}{j}"] = factor * (share * own + (1 - share) * F.lit(prior)) + (FLOORS[i] ** 2 if i == j else 0.0)
    shrunk = {f"m{i}": share * F.col(f"m{i}") + (1 - share) * F.lit(centre[i]) for i in range(SIZE)}
    return _factored(close.withColumns(means).withColumns(covariance).withColumns(shrunk))


def estimates(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Centre and inverse Cholesky factor per (lang, source); ``rows`` has the group columns and v0-v4."""

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    now = written(_start(rows), "start")
    for step in range(STEPS):
        close = written(_closest(rows, now), f"closest-{step}")
        now = written(_concentrated(close), f"step-{step}")
    return now


def judged(spark: SparkSession, docs: DataFrame, carry: list[str], tail: float = TAIL) -> DataFrame:
    """Every row of ``docs`` as ``doc`` (its columns ``carry``) with its statistics and verdicts.

    Columns: doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance
    (squared; null where the base rules failed) and kept. Null and empty texts have zero statistics and
    fail the base rules. Null lang or source is a group of its own. Repeated rows are judged each, all
    alike. An empty table gives an empty result. Columns of ``docs`` may have any name.
    """
    folder = work_dir(spark, "quality-rules")
    found = docs.select(F.struct(*carry).alias("doc"), F.col("lang").cast("string").alias("lang"),
                        F.col("source").cast("string").alias("source"),
                        *[column.alias(name) for name, column in text_statistics(F.col("text")).items()])
    found.select("*", base_failed().alias("base_failed"), *_vector()).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    vectors = rows.where("not base_failed").select(*GROUP, *[f"v{i}" for i in range(SIZE)])
    placed = _placed(rows, estimates(spark, vectors, folder))
    distance = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & F.coalesce(distance <= chi_square_quantile(1 - tail, SIZE), F.lit(False))
    return placed.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         distance.alias("distance"), kept.alias("kept"))


def quality_verdicts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, distance and kept for every row of ``docs``."""
    return judged(spark, docs, ["doc_id"]).select("doc.doc_id", "*").drop("doc")


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that all rules keep, with all columns of ``docs``."""
    return judged(spark, docs, docs.columns).where("kept").select("doc.*")
