import brute
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import kernels
from tidemark.llm import near_dedup as nd
from tidemark.llm.components import components

FOLDER = "/root/testdata/sf0.001/documents.parquet"


def result(spark, docs):
    return {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in nd.near_duplicates(spark, docs).collect()}


def expected(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    roots = brute.near_components(texts)
    return {(i, len(brute.shingles(t))): (roots[i], roots[i] == i) for i, t in texts.items()}


def test_equals_brute_force_on_the_table(spark):
    docs = spark.read.parquet(FOLDER)
    assert result(spark, docs) == expected(docs)


def test_equals_brute_force_on_a_large_family(spark, near_family):
    assert result(spark, near_family) == expected(near_family)


def test_blocks_between_components_give_the_same(spark, near_family, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_MEMBERS", 8)
    assert result(spark, near_family) == expected(near_family)


def test_awkward_rows(spark, awkward):
    docs = awkward.where("doc_id is not null")
    assert result(spark, docs) == expected(docs)
    rows = nd.near_duplicates(spark, awkward).collect()
    assert len(rows) == awkward.count()
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_empty_table_and_clashing_columns(spark, nothing, awkward):
    assert nd.near_duplicates(spark, nothing).count() == 0
    docs = awkward.withColumn("class", F.lit(1)).withColumn("_gone", F.lit(2)).withColumn("key", F.lit("x"))
    kept = nd.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    assert {2, 3, 9, 12, 13, 15}.isdisjoint({r.doc_id for r in kept.collect()})


def test_the_stage_keeps_one_row_of_each_group_when_ids_repeat(spark):
    one, other = [f"a{i}" for i in range(100)], [f"z{i}" for i in range(100)]
    near = [*one[:50], "x", *one[51:]], [*other[:50], "x", *other[51:]]
    rows = [(1, one), (2, near[0]), (2, other), (3, one), (3, one), (4, near[1]), (5, []), (5, [])]
    docs = spark.createDataFrame([(i, " ".join(t), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `class` int")
    kept = nd.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text[:2]) for r in kept.collect()) == [(1, "a0"), (2, "z0"), (5, ""), (5, "")]
    same = docs.where("doc_id = 3").union(docs.where("doc_id = 3")).repartition(4)
    assert nd.drop_near_duplicates(spark, same).count() == 1
    orphans = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert nd.drop_near_duplicates(spark, orphans).count() == docs.count()


def test_registers_hold_zeros_and_mantissa():
    low = np.array([0x0080000000000000 >> 8, 0xFF00000000010000], np.uint64)
    table = nd.registers(np.sort(low), np.array([0, 2]))
    assert table[0, 0] == 8 << nd.MANTISSA
    assert table[0, 255] == 39 << nd.MANTISSA
    assert (table[0, 1:255] == nd.EMPTY).all()


def test_estimate_is_close():
    draw = np.random.default_rng(0)
    pool = kernels.mix(draw.integers(0, 1 << 62, 6000, dtype=np.uint64))
    for shared in (1000, 3000, 5000):
        one, two = np.sort(pool[:5500]), np.sort(pool[5500 - shared:6000])
        true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        table = nd.registers(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]))
        got = nd.estimate(table[:1], table[1:], np.array([len(one)]), np.array([len(two)]))[0]
        assert abs(got - true) < 5 * (true * (1 - true) / nd.BUCKETS) ** 0.5 + 0.01


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(5, 5), (300, 299), (299, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(spark, df).collect()}
    nodes = {x for pair in links if pair[0] != pair[1] for x in pair}
    assert got == {n: root for n, root in brute.groups(nodes, links).items()}
