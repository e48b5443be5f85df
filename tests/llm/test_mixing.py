import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def targets_of(sizes: dict) -> dict:
    """Weights shared again and again until no target is above its limit."""
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    fixed: dict = {}
    while True:
        left, open_ = sum(sizes.values()) - sum(fixed.values()), [s for s in sizes if s not in fixed]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in open_}
        fixed |= {s: 3 * sizes[s] for s in above}


def check(docs, rows):
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(brute.words(r.text))
    want = targets_of(sizes)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    return taken, want


def test_targets_and_takings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixture(spark, docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: len(brute.words(r.text)) for r in docs.collect()}
    taken, want = check(docs, rows)
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s]
    assert sorted(rows) == sorted(mixing.mixture(spark, docs.repartition(5)).collect())


def test_awkward_rows(spark, awkward, nothing):
    docs = awkward.where("doc_id is not null").withColumns({n: F.lit(1) for n in ("size", "rank", "copies", "target", "doc", "r", "s")})
    check(docs, mixing.mixture(spark, docs).collect())
    rows = mixing.mixture(spark, awkward).collect()
    assert len(rows) == awkward.count()
    assert mixing.mixture(spark, nothing).count() == 0
    assert mixing.mixed(spark, nothing).count() == 0


def test_sources_without_words_and_one_source(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y z", "b"), (4, "q", "b")], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.mixture(spark, docs).collect()}
    assert [rows[i].taken for i in (1, 2, 3, 4)] == [0, 0, 3, 1]  # b has all words: its target is its size
    assert rows[1].source_size == 0 and rows[1].target == 0


def test_mixed_repeats_whole_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("copies", F.col("doc_id"))
    out = mixing.mixed(spark, docs)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    for r in mixing.mixture(spark, docs).collect():
        if r.size:
            assert got[r.doc_id] * r.size == r.taken


def test_longer_documents_are_likelier_but_none_is_certain(spark):
    rows = [(i, "w " * (4 if i % 2 else 400), "a") for i in range(2000)] + [(10_000 + i, "w " * 100, s) for i in range(4000) for s in "bc"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.mixture(spark, docs).collect() if r.doc_id < 2000]
    copies = {size: [r.taken // size for r in got if r.size == size] for size in (4, 400)}
    assert set(copies[4]) == set(copies[400]) == {1, 2}
    assert sum(copies[400]) > 1.05 * sum(copies[4])


def test_no_python_in_the_plan(spark):
    plan = mixing.mixture(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if x in plan]


def test_a_document_larger_than_the_remainder_stops_nothing(spark):
    draw = random.Random(1)
    sources = [f"a{k:02}" for k in range(18)]
    rows = [(s, draw.randint(50, 150)) for s in sources for _ in range(700)] + [(s, 28_000) for s in sources]
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(rows)]
    rows += [(i, "w " * 40, "a00") for i in (-1, -1, -1, -2, -2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(spark, docs).collect()
    taken, want = check(docs, got)
    off = {s: taken[s] / want[s] - 1 for k, s in enumerate(sources) if k % 3}  # of the others, all small documents do not suffice
    assert all(abs(x) <= 0.05 for x in off.values()), off


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_of_one_id_are_taken_one_by_one(spark, doc_id):
    rows = [(doc_id, "w " * 10, "a") for _ in range(100)] + [(1000 + i, "w " * 10, s) for i in range(50) for s in "bc"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mixture(spark, docs).collect()
    ours = [r for r in got if r.doc_id == doc_id]
    assert len(ours) == 100 and abs(sum(r.taken for r in ours) - ours[0].target) <= 10
    assert {r.taken for r in ours} == {10, 20}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(spark, docs.repartition(3)).collect()))
    out = mixing.mixed(spark, docs)
    assert out.where(F.col("doc_id").eqNullSafe(doc_id)).count() * 10 == sum(r.taken for r in ours)


def test_numbers_of_repeated_rows(spark):
    rows = [(1, "a", 3, k) for k in range(70)] + [(None, None, 3, k) for k in range(70, 100)] + [(2, "a", 3, 100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, k long").repartition(6)
    repeated = df.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    got = mixing._numbered(spark, df, repeated).collect()
    assert sorted(r.k for r in got) == list(range(101))
    for key, n in ((1, 70), (None, 30), (2, 1)):
        assert sorted(r.part for r in got if r.doc_id == key) == list(range(n))
    units = repeated.withColumn("preference", F.lit(1).cast("long"))
    assert sorted(r.part for r in mixing._further_rows(units).collect()) == sorted([*range(1, 70), *range(1, 30)])
