import pytest

from tidemark.functions.columns import default_for
from tidemark.operators import joins


def test_defaults_by_type_and_nullable_columns(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame(
        [(1, "x", 5, True, None)], "k int, name string, n bigint, flag boolean, ends timestamp"
    )
    out = joins.left_join_defaults(left, right, ["k"], keep_null=["ends"]).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(1, "x", 5, True, None), (2, "", 0, False, None)]


def test_no_default_for_nested_types(spark):
    with pytest.raises(TypeError):
        default_for(spark.createDataFrame([([1],)], "a array<int>").schema["a"].dataType)
