import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import packed_digest, unpacked_digest
from tidemark.operators import revisions

SCHEMA = "k string, source_updated_at long, batch_id string, record_hash string, is_deleted boolean, v int"


def brute_force(rows):
    newest = {}
    for row in rows:
        if row[0] not in newest or row[1:4] > newest[row[0]][1:4]:
            newest[row[0]] = row
    return newest


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(7)
    keys = ["hot"] * 300 + [f"k{i}" for i in range(600)]
    rows = {
        (rng.choice(keys), rng.randrange(20), f"b{rng.randrange(3)}", f"{rng.randrange(10**9):09d}"): None
        for _ in range(3000)
    }
    rows = [(*key, rng.random() < 0.3, rng.randrange(100)) for key in rows]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6)


def test_latest_live_equals_brute_force(log):
    rows, df = log
    want = sorted(row for row in brute_force(rows).values() if not row[4])
    assert sorted(tuple(r) for r in revisions.latest_live(df, "k").collect()) == want


def test_live_keys_equal_latest_live(log):
    _, df = log
    by_rank = {r.k for r in revisions.latest_live(df, "k").collect()}
    assert {r.k for r in revisions.live_keys(df, "k").collect()} == by_rank


def test_tombstone_hides_and_later_revision_revives(spark):
    def live(*revs):
        rows = [("a", at, "b", str(at), gone, at) for at, gone in revs]
        return [r.v for r in revisions.latest_live(spark.createDataFrame(rows, SCHEMA), "k").collect()]

    assert live((1, False)) == [1]
    assert live((1, False), (2, True)) == []
    assert live((1, False), (2, True), (3, False)) == [3]


def test_tombstones_cover_exactly_the_missing_keys(log, spark):
    rows, df = log
    newest = brute_force(rows)
    kept = sorted(newest)[::2]
    keys = spark.createDataFrame([(k,) for k in kept], "k string")
    dated = df.withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    out = revisions.tombstones(dated, keys, "k", ["k", "v", "updated_at", "is_deleted"],
                               F.lit("2026-01-01").cast("timestamp")).collect()
    want = {k: row[5] for k, row in newest.items() if not row[4] and k not in kept}
    assert {r.k: r.v for r in out} == want
    assert all(r.is_deleted and r.updated_at.year == 2026 for r in out)


def test_groups_are_limited_before_the_shuffle(log):
    """A hot key must not send all its revisions to one task."""
    plan = revisions.latest_live(log[1], "k")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "Partial" in below and "WindowGroupLimit" in below


def test_upsert_replaces_and_adds(spark):
    target = spark.createDataFrame([("a", 9, "old"), ("b", 9, "old")], "k string, at int, v string")
    changes = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y"), ("c", 1, "z")], "k string, at int, v string")
    out = revisions.upsert_latest(target, changes, "k", ("at",)).collect()
    assert {(r.k, r.v) for r in out} == {("a", "old"), ("b", "y"), ("c", "z")}


def test_insert_if_absent_is_idempotent(spark):
    target = spark.createDataFrame([("a", 1)], "k string, n int")
    new = spark.createDataFrame([("a", 2), ("b", 1), ("b", 3)], "k string, n int")
    added = revisions.insert_if_absent(target, new, "k", ("n",))
    assert [tuple(r) for r in added.collect()] == [("b", 3)]
    assert revisions.insert_if_absent(target.unionByName(added), new, "k", ("n",)).isEmpty()


def test_beyond_newest_keeps_three_per_group(spark):
    rows = [("m", f"s{i}", i) for i in range(10)] + [("n", "t0", 0)]
    df = spark.createDataFrame(rows, "g string, name string, at int")
    out = revisions.beyond_newest(df, "g", "name", ("at",)).collect()
    assert sorted(r.name for r in out) == [f"s{i}" for i in range(7)]


def _texts():
    """Digests, and texts that begin like one, end early, go on, or hold characters that sort below, between or above hex digits."""
    rng = random.Random(3)
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)] + ["0" * 64, "f" * 64, "0" * 63 + "f", "0" * 62 + "10"]
    others = ["", " ", "A", "g", "\x00", "é", "😀", "h1", "0" * 63, "f" * 65, "0" * 62 + "0g", "0" * 62 + "1", "12" * 300]
    for digest in digests:
        cut = rng.randrange(65)
        others += [digest[:cut], digest.upper(), digest + "0"]
        others += [digest[:cut] + mark + digest[cut + rng.randrange(2):] for mark in ("", " ", "-", "/", ":", "A", "F", "`", "g", "~", "é")]
    return sorted({*digests, *others})


def test_packed_digests_sort_as_their_texts_and_can_be_had_back(spark):
    texts = _texts()
    rows = [(i, text) for i, text in enumerate(sorted(texts, key=lambda t: t.encode()))] + [(-1, None)]
    df = spark.createDataFrame(rows, "place int, text string").repartition(4).withColumn("packed", packed_digest("text"))
    got = df.select("place", "text", "packed", unpacked_digest("packed").alias("back")).orderBy("packed", "place").collect()
    assert [r.place for r in got] == list(range(-1, len(texts)))
    assert len({bytes(r.packed) for r in got[1:]}) == len(texts) and got[0].packed is None
    assert all(r.back == r.text for r in got)
    assert {len(r.packed) for r in got if r.text and len(r.text) == 64 and set(r.text) <= set("0123456789abcdef")} == {33}


def test_hashes_of_any_form_decide_ties_by_their_text(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(60)}", 1, "b", text, False, i) for i, text in enumerate(_texts() * 3)]
    rows = list({row[:4]: row for row in rows}.values())
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    newest = {}
    for row in rows:
        if row[0] not in newest or row[3].encode() > newest[row[0]][3].encode():
            newest[row[0]] = row
    assert sorted(tuple(r) for r in revisions.latest_live(df, "k").collect()) == sorted(newest.values())
    gone = df.withColumn("is_deleted", F.col("v") % 2 == 0)
    assert {r.k for r in revisions.live_keys(gone, "k").collect()} == {k for k, row in newest.items() if row[5] % 2}


def test_record_hashes_are_shuffled_packed(spark):
    """The 64 digits were most of the bytes that ranking shuffled."""
    at = F.lit("2024-01-01").cast("timestamp")
    rows = spark.range(20_000, numPartitions=2).select(
        F.col("id").cast("string").alias("k"), at.alias("source_updated_at"), F.lit("b").alias("batch_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("record_hash"), F.lit(False).alias("is_deleted"),
    )
    ranked = revisions.latest_live(rows, "k")
    assert ranked.schema.names == rows.schema.names
    ranked.collect()
    plan, sizes = ranked._jdf.queryExecution().executedPlan().executedPlan(), []
    while plan.children().size() or "QueryStage" in plan.nodeName():
        plan = plan.plan() if "QueryStage" in plan.nodeName() else plan.children().head()
        if plan.nodeName() == "Exchange":
            sizes.append(plan.metrics().apply("shuffleBytesWritten").value())
    assert len(sizes) == 1 and 0 < sizes[0] < 20_000 * 56
