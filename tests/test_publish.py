import pytest
import seed
from pyspark.sql import functions as F

from tidemark.operators import checksums, projection
from tidemark.plans import commerce
from tidemark.plans.publish import Gold, PublishError, decide, rebuild
from tidemark.schemas import MARTS
from tidemark.sources import storage
from tidemark.sources.ledger import Ledger

MART = "mart_daily_revenue"


@pytest.fixture(scope="module")
def mart(spark, tmp_path_factory):
    """The mart, built once, with its net revenue multiplied."""
    path = f"{tmp_path_factory.mktemp('mart')}/revenue"
    commerce.mart_daily_revenue(commerce.core_order_financial(seed.raw(spark))).coalesce(1).write.parquet(path)
    net = F.col("net_revenue")
    return lambda scale: spark.read.parquet(path).withColumn("net_revenue", (net * scale).cast("decimal(38,2)"))


@pytest.fixture
def gold(spark, root):
    return Gold(spark, root)


def put(gold, mart, scale, run_id):
    gold.write_candidate(mart(scale), MART, run_id)
    return gold.publish(MART, run_id)


def net(gold):
    return gold.read(MART).agg(F.sum("net_revenue")).first()[0]


def entry(status, **fields):
    base = {"candidate_checksum": "2:9", "previous_checksum": None, "production_checksum": None}
    return {**base, "status": status, **fields}


@pytest.mark.parametrize(
    ("known", "candidate", "live", "action"),
    [
        (None, "2:9", None, "swap"),
        (None, "2:9", "2:8", "swap"),
        (None, "2:9", "2:9", "commit"),
        (entry("PREPARED"), "2:9", "2:8", "swap"),
        (entry("PREPARED", previous_checksum="2:8"), "2:9", "2:8", "swap"),
        (entry("FAILED"), None, "2:9", "commit"),
        (entry("COMMITTED", production_checksum="2:9"), "2:7", "2:9", "keep"),
    ],
)
def test_decisions(known, candidate, live, action):
    assert decide(known, candidate, live) == action


@pytest.mark.parametrize(
    ("known", "candidate", "live", "message"),
    [
        (None, None, "2:8", "does not exist"),
        (None, "0:0", "2:8", "empty"),
        (entry("PREPARED"), "2:7", "2:8", "candidate changed"),
        (entry("PREPARED", previous_checksum="2:5"), "2:9", "2:8", "live table changed"),
        (entry("COMMITTED", production_checksum="2:9"), "2:9", "2:8", "was committed"),
    ],
)
def test_refusals(known, candidate, live, message):
    with pytest.raises(PublishError, match=message):
        decide(known, candidate, live)


def test_before_the_first_publication_the_contract_is_served_empty(gold):
    assert gold.read(MART).count() == 0
    assert projection.schema_differences(gold.read(MART), MARTS[MART]) == []


def test_publish_and_repeat(gold, mart):
    first = put(gold, mart, 1, "run-1")
    assert net(gold) == 160
    entries = gold.manifest.entries().count()
    assert gold.publish(MART, "run-1") == first
    assert gold.manifest.entries().count() == entries
    put(gold, mart, 2, "run-2")
    assert net(gold) == 320


@pytest.mark.parametrize("status", ["PREPARED", "COMMITTED"])
def test_crash_at_each_ledger_step_is_repaired(gold, mart, monkeypatch, status):
    put(gold, mart, 1, "run-1")
    gold.write_candidate(mart(2), MART, "run-2")

    def crash(self, *rows, real=Ledger.append):
        if any(row.get("status") == status for row in rows):
            raise KeyboardInterrupt
        real(self, *rows)

    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "append", crash)
        with pytest.raises(KeyboardInterrupt):
            gold.publish(MART, "run-2")
    assert net(gold) == 160
    gold.publish(MART, "run-2")
    assert net(gold) == 320


def test_rebuild_that_changes_nothing_commits_without_a_swap(gold, mart):
    put(gold, mart, 1, "run-1")
    live = gold.live(MART).candidate_path
    put(gold, mart, 1, "run-2")
    assert gold.live(MART).candidate_path == live
    assert gold.events.entries().where("event_type = 'RECONCILED'").count() == 1


def test_a_run_that_changed_nothing_can_be_rolled_back(gold, mart):
    put(gold, mart, 1, "run-1")
    second = put(gold, mart, 1, "run-2")
    gold.rollback(MART, second, "bad numbers", dry_run=False)
    assert net(gold) == 160
    assert gold.live(MART).rollback_of == second
    assert gold.manifest.find(publication_id=second).status == "ROLLED_BACK"


def test_drift_of_the_live_table_is_found(gold, mart):
    put(gold, mart, 1, "run-1")
    commerce.stamped(mart(3), MART, F.current_timestamp()).write.mode("overwrite").parquet(gold.live(MART).candidate_path)
    with pytest.raises(PublishError, match="was committed"):
        gold.publish(MART, "run-1")


def test_absent_and_empty_candidates_are_refused(gold, mart):
    with pytest.raises(PublishError, match="does not exist"):
        gold.publish(MART, "run-1")
    gold.write_candidate(mart(1).limit(0), MART, "run-2")
    with pytest.raises(PublishError, match="empty"):
        gold.publish(MART, "run-2")
    with pytest.raises(ValueError, match="unknown mart"):
        gold.publish("other", "run-2")


def test_schema_contract_is_enforced(gold, mart):
    mart(1).drop("currency").write.parquet(gold.candidate_path(MART, "run-1"))
    with pytest.raises(PublishError, match="missing currency"):
        gold.publish(MART, "run-1")


def test_rollback_is_a_plan_first(gold, mart):
    put(gold, mart, 1, "run-1")
    second = put(gold, mart, 2, "run-2")
    plan = gold.rollback(MART, second, "bad numbers")
    assert plan["dry_run"] and net(gold) == 320
    done = gold.rollback(MART, second, "bad numbers", dry_run=False)
    assert net(gold) == 160
    reverse = gold.live(MART)
    assert reverse.publication_id == done["rollback_publication_id"] and reverse.rollback_of == second
    assert gold.manifest.find(publication_id=second).status == "ROLLED_BACK"
    with pytest.raises(ValueError):
        gold.rollback(MART, second, "again")


def test_rollback_refuses_a_damaged_snapshot(gold, mart):
    put(gold, mart, 1, "run-1")
    first_path = gold.live(MART).candidate_path
    second = put(gold, mart, 2, "run-2")
    commerce.stamped(mart(3), MART, F.current_timestamp()).write.mode("overwrite").parquet(first_path)
    with pytest.raises(PublishError, match="snapshot"):
        gold.rollback(MART, second, "bad numbers", dry_run=False)
    assert net(gold) == 320


def test_three_snapshots_are_kept(spark, gold, mart):
    for scale in range(1, 7):
        put(gold, mart, scale, f"run-{scale}")
    there = [scale for scale in range(1, 7) if storage.exists(spark, gold.candidate_path(MART, f"run-{scale}"))]
    assert there == [3, 4, 5, 6]
    assert net(gold) == 6 * 160
    # A run whose snapshot is gone can be written again; one that is kept stays as it is.
    for run in ("run-1", "run-3"):
        gold.write_candidate(mart(9), MART, run)
    nets = [spark.read.parquet(gold.candidate_path(MART, run)).agg(F.sum("net_revenue")).first()[0] for run in ("run-1", "run-3")]
    assert nets == [9 * 160, 3 * 160]


def test_whole_rebuild_publishes_all_marts_or_none(spark, gold):
    done = rebuild(gold, seed.raw(spark), "run-1", published_at=seed.at(6))
    assert set(done) == set(MARTS)
    assert {name: gold.read(name).count() for name in MARTS} == {
        "mart_daily_revenue": 2, "mart_conversion_funnel": 2, "mart_customer_orders": 3
    }
    assert rebuild(gold, seed.raw(spark), "run-1") == done
    assert not storage.exists(spark, f"{gold.root}/core/run-1")
    bad = [("ref_big", "pay_002", "succeeded", seed.money(500), seed.at(3), seed.at(3), False)]
    with pytest.raises(PublishError, match="nonnegative financials"):
        rebuild(gold, seed.raw(spark, refunds=bad), "run-2")
    assert gold.live("mart_daily_revenue").run_id == "run-1"


def test_checksums_ignore_order_and_build_time(spark, mart):
    one = commerce.stamped(mart(1), MART, F.lit("2026-01-01").cast("timestamp"))
    two = commerce.stamped(mart(1).orderBy(F.desc("grain_key")).repartition(3), MART, F.current_timestamp())
    for method in ("sha256", "xxhash64"):
        first, second = (checksums.table_checksum(df, method=method).first() for df in (one, two))
        assert first == second
        assert first != checksums.table_checksum(mart(2), method=method).first()
    same = checksums.compare_tables({MART: one}, {MART: two}).first()
    assert same.matches and same.left_rows == 2
    assert not checksums.compare_tables({MART: one}, {MART: one.limit(1)}).first().matches


def test_null_patterns_change_the_fast_checksum(spark):
    sums = set()
    for pair in ((None, "a"), ("a", None)):
        df = spark.createDataFrame([pair], "x string, y string")
        sums.add(checksums.table_checksum(df, method="xxhash64").first().checksum)
    assert len(sums) == 2
