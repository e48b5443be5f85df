"""Building, checking, publishing and rolling back mart versions.

A version is a Parquet folder that is never written again once it is live. The pointer to the
live version is the newest committed entry of the publication ledger, so publishing and rolling
back append one small entry and move no data, and the previous version is its own snapshot.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import build_time
from tidemark.operators.checksums import table_checksum
from tidemark.operators.projection import schema_differences
from tidemark.operators.quality import mart_tests
from tidemark.operators.revisions import beyond_newest
from tidemark.plans import commerce
from tidemark.schemas import MARTS
from tidemark.session import together
from tidemark.sources import storage
from tidemark.sources.landing import NAMESPACE
from tidemark.sources.ledger import Ledger, utc_now
from tidemark.sources.windows import moment

SNAPSHOTS = 3


class PublishError(RuntimeError):
    """A publication or rollback that was refused."""


def decide(entry: Mapping[str, object] | None, candidate: str | None, live: str | None) -> str:
    """What a publication has to do, from its last ledger entry and the two current checksums.

    ``keep``: done before. ``commit``: the live table equals the candidate already, only the entry
    is missing. ``swap``: move the pointer.
    """
    if entry and entry["status"] == "COMMITTED":
        if live != entry["production_checksum"]:
            raise PublishError(f"the live table is {live}, but {entry['production_checksum']} was committed")
        return "keep"
    if entry:
        if live == entry["candidate_checksum"]:
            return "commit"
        if candidate != entry["candidate_checksum"]:
            raise PublishError(f"the prepared candidate changed: {candidate} / {entry['candidate_checksum']}")
        if entry["previous_checksum"] and entry["previous_checksum"] != live:
            raise PublishError(f"the live table changed since the candidate was prepared: {live}")
        return "swap"
    if candidate is None:
        raise PublishError("the candidate does not exist")
    if candidate.startswith("0:"):
        raise PublishError("the candidate is empty")
    return "commit" if live == candidate else "swap"


def publication_id(dataset: str, run_id: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{NAMESPACE}:publication:{run_id}:{dataset}"))


class Gold:
    """The published marts below one root folder; one writer at a time per mart."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.manifest = Ledger(spark, root, "publication_manifest")
        self.events = Ledger(spark, root, "publication_event")

    def candidate_path(self, dataset: str, run_id: str) -> str:
        return f"{self.root}/versions/{dataset}/{run_id}"

    def write_candidate(
        self, mart: DataFrame, dataset: str, run_id: str, published_at: datetime | None = None
    ) -> str:
        """Write a mart as a candidate and return its path.

        A repeat of a run replaces its candidate, but a version that was published once stays as
        it is while its folder is kept: readers may be on it.
        """
        path = self.candidate_path(dataset, run_id)
        if not (self._was_published(dataset, path) and storage.exists(self.spark, path)):
            stamp = moment(published_at) if published_at else build_time()
            commerce.stamped(mart, dataset, stamp).write.mode("overwrite").parquet(path)
        return path

    def _was_published(self, dataset: str, path: str) -> bool:
        committed = self.manifest.entries().where((F.col("dataset") == dataset) & (F.col("status") == "COMMITTED"))
        return not committed.where(F.col("candidate_path") == path).isEmpty()

    def live(self, dataset: str) -> Row | None:
        """The ledger entry of the live version."""
        return self.manifest.find(dataset=dataset, status="COMMITTED")

    def read(self, dataset: str) -> DataFrame:
        """The live version, or an empty table of the contract before the first publication."""
        entry = self.live(dataset)
        if entry is None:
            return self.spark.createDataFrame([], MARTS[dataset])
        return self.spark.read.schema(MARTS[dataset]).parquet(entry.candidate_path)

    def checksum(self, path: str | None) -> str | None:
        """Count and row checksum of a version; the build time is left out."""
        if path is None or not storage.exists(self.spark, path):
            return None
        row = table_checksum(self.spark.read.parquet(path), method="xxhash64").first()
        return f"{row.row_count}:{row.checksum}"

    def _note(self, publication: str, kind: str, **details: object) -> None:
        self.events.append(
            {"publication_id": publication, "event_type": kind, "details": json.dumps(details, default=str),
             "created_at": utc_now()}
        )

    def _enter(self, fields: Mapping[str, object], status: str, **changes: object) -> dict[str, object]:
        entry = {**fields, "status": status, "updated_at": utc_now(), **changes}
        self.manifest.append(entry)
        return entry

    def publish(self, dataset: str, run_id: str) -> str:
        """Make a run's candidate the live version; safe to repeat after a crash at any point."""
        if dataset not in MARTS:
            raise ValueError(f"unknown mart: {dataset}")
        publication, path = publication_id(dataset, run_id), self.candidate_path(dataset, run_id)
        found = self.manifest.find(publication_id=publication)
        known = found.asDict() if found else None
        live = self.live(dataset)
        live_path = live.candidate_path if live else None
        candidate_sum, live_sum = together(
            self.spark, lambda: self.checksum(path), lambda: self.checksum(live_path)
        )
        fields = known or {
            "publication_id": publication, "run_id": run_id, "dataset": dataset, "candidate_path": path,
            "candidate_checksum": candidate_sum,
        }
        try:
            action = decide(known, candidate_sum, live_sum)
            if action == "keep":
                return publication
            if action == "commit":
                # A new run whose content is live already goes back to that version, which stands before and after it.
                before = {} if known else {"previous_path": live_path, "previous_checksum": live_sum}
                self._enter(fields, "COMMITTED", **before, candidate_path=live_path, production_checksum=live_sum,
                            committed_at=utc_now(), error=None)
                self._note(publication, "RECONCILED", checksum=live_sum)
                return publication
            problems = schema_differences(self.spark.read.parquet(path), MARTS[dataset])
            if problems:
                raise PublishError(f"the candidate breaks the serving contract: {'; '.join(problems)}")
            fields = self._enter(fields, "PREPARED", previous_path=live_path, previous_checksum=live_sum, error=None)
            known = fields
            self._note(publication, "PREPARED", checksum=candidate_sum)
            self._enter(fields, "COMMITTED", production_checksum=candidate_sum, committed_at=utc_now())
            self._note(publication, "COMMITTED", checksum=candidate_sum)
        except Exception as error:
            if known and known["status"] != "COMMITTED":
                self._enter(fields, "FAILED", error=str(error))
                self._note(publication, "FAILED", error=str(error))
            raise
        self.drop_old_snapshots(dataset)
        return publication

    def rollback(self, dataset: str, publication: str, reason: str, dry_run: bool = True) -> dict[str, object]:
        """Go back to the version before a publication. By default only the plan is returned."""
        found = self.manifest.find(publication_id=publication)
        if found is None or found.dataset != dataset or found.status != "COMMITTED" or not found.previous_path:
            raise ValueError("not a committed publication with an earlier version")
        live = self.live(dataset)
        plan = {
            "dry_run": dry_run, "dataset": dataset, "publication_id": publication, "reason": reason,
            "current_checksum": self.checksum(live.candidate_path), "target_checksum": found.previous_checksum,
            "snapshot": found.previous_path,
        }
        if dry_run:
            return plan
        actual = self.checksum(found.previous_path)
        if actual != found.previous_checksum:
            raise PublishError(f"the snapshot is {actual}, but {found.previous_checksum} was recorded")
        run_id = str(uuid.uuid4())
        reverse = publication_id(dataset, run_id)
        self._enter(
            {"publication_id": reverse, "run_id": run_id, "dataset": dataset, "candidate_path": found.previous_path,
             "candidate_checksum": actual, "previous_path": live.candidate_path,
             "previous_checksum": plan["current_checksum"], "production_checksum": actual,
             "committed_at": utc_now(), "rollback_of": publication},
            "COMMITTED",
        )
        self._enter(found.asDict(), "ROLLED_BACK")
        self._note(publication, "ROLLED_BACK", by=reverse, reason=reason)
        self._note(reverse, "COMMITTED", rollback_of=publication)
        return {**plan, "rollback_publication_id": reverse}

    def snapshots(self, dataset: str) -> DataFrame:
        """Versions that were live once and are not now, with the time they were last made live."""
        committed = self.manifest.entries().where((F.col("dataset") == dataset) & (F.col("status") == "COMMITTED"))
        versions = committed.groupBy("dataset", "candidate_path").agg(F.max("recorded_ns").alias("live_since"))
        live = self.live(dataset)
        return versions.where(F.col("candidate_path") != (live.candidate_path if live else ""))

    def drop_old_snapshots(self, dataset: str) -> list[str]:
        """Delete all but the newest snapshots of a mart."""
        old = beyond_newest(self.snapshots(dataset), "dataset", "candidate_path", ("live_since",), SNAPSHOTS)
        paths = [row.candidate_path for row in old.select("candidate_path").collect()]
        for path in paths:
            storage.remove(self.spark, path)
        return paths


def build_candidates(
    gold: Gold, raw: Mapping[str, DataFrame], run_id: str, published_at: datetime | None = None
) -> dict[str, DataFrame]:
    """Write all three marts as candidates and return them as written.

    Order finance feeds two marts, so it is written once and read back, which also keeps a lost
    executor from costing the whole chain again; it is removed once both are written. Jobs that do not
    depend on each other run at once.
    """
    spark = gold.spark
    core_path = f"{gold.root}/core/{run_id}"

    def write(mart: DataFrame, name: str) -> DataFrame:
        path = gold.write_candidate(mart, name, run_id, published_at)
        return spark.read.schema(MARTS[name]).parquet(path)

    def orders() -> tuple[DataFrame, DataFrame]:
        commerce.core_order_financial(raw).write.mode("overwrite").parquet(core_path)
        core = spark.read.parquet(core_path)
        customers = commerce.staging(raw, "customers")
        marts = together(
            spark,
            lambda: write(commerce.mart_daily_revenue(core), "mart_daily_revenue"),
            lambda: write(commerce.mart_customer_orders(core, customers), "mart_customer_orders"),
        )
        storage.remove(spark, core_path)
        return tuple(marts)

    (revenue, customer_orders), funnel = together(
        spark, orders, lambda: write(commerce.mart_conversion_funnel(raw), "mart_conversion_funnel")
    )
    return {
        "mart_daily_revenue": revenue, "mart_conversion_funnel": funnel, "mart_customer_orders": customer_orders
    }


def rebuild(
    gold: Gold, raw: Mapping[str, DataFrame], run_id: str, published_at: datetime | None = None
) -> dict[str, str]:
    """Build, test and publish all marts. A failing data test publishes nothing."""
    built = build_candidates(gold, raw, run_id, published_at)
    tests = mart_tests(built["mart_daily_revenue"], built["mart_conversion_funnel"], built["mart_customer_orders"])
    failed = tests.where(F.col("violations") > 0).collect()
    if failed:
        raise PublishError("; ".join(f"{row.test}: {row.violations} rows" for row in failed))
    return {name: gold.publish(name, run_id) for name in MARTS}
