import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import digest_tree as dt


def pairs(spark, rows):
    return spark.createDataFrame(rows, "k string, v int")


def brute(left, right):
    out = []
    for key in {k for k, _ in left + right}:
        a, b = (sorted((x for x in side if x[0] == key), key=str) for side in (left, right))
        if a != b:
            out += [("left", *x) for x in a] + [("right", *x) for x in b]
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 3])
def test_rows_equal_brute_force(spark, depth):
    draw = random.Random(depth)
    left = [(f"k{i}", draw.randint(0, 5)) for i in range(400)] + [("k1", None), ("k1", None), (None, 1)]
    right = [x for x in left if draw.random() > 0.02] + [("new", 1), ("k7", 99), (None, 1)]
    got = dt.differing_rows(pairs(spark, left), pairs(spark, right), "k", depth)
    assert sorted(map(tuple, got.collect()), key=str) == brute(left, right)


def test_equal_copies_stop_at_the_root(spark):
    rows = pairs(spark, [(f"k{i}", i) for i in range(300)])
    tree = dt.digest_tree(rows, "k")
    assert dt.differing_prefixes(tree, dt.digest_tree(rows.repartition(7), "k")) == []
    assert [r.row_count for r in tree.where("level = 0").collect()] == [300]
    assert tree.where("level = 1").agg(F.sum("row_count")).first()[0] == 300


def test_only_the_prefix_that_differs_is_found(spark):
    rows = pairs(spark, [(f"k{i}", i) for i in range(300)])
    other = rows.withColumn("v", F.when(F.col("k") == "k5", 0).otherwise(F.col("v")))
    found = dt.differing_prefixes(dt.digest_tree(rows, "k"), dt.digest_tree(other, "k"))
    assert found == [rows.where("k = 'k5'").select(dt.prefix("k", 3)).first()[0]]


def test_empty_sides(spark):
    rows, none = pairs(spark, [("a", 1)]), pairs(spark, [])
    assert [tuple(r) for r in dt.differing_rows(rows, none, "k").collect()] == [("left", "a", 1)]
    assert dt.differing_rows(none, none, "k").collect() == []
