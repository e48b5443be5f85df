"""Content-addressed, immutable batches with a manifest and a checkpoint."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.checksums import SLICES, digest_sums, with_row_digest
from tidemark.operators.revisions import append_union
from tidemark.schemas import BATCH_OBJECTS
from tidemark.session import together
from tidemark.sources import storage
from tidemark.sources.ledger import Ledger, utc_now

NAMESPACE = "tidemark"
ROWS_PER_FILE = 5_000_000
_DIGESTS = [f"digest_{i}" for i in range(SLICES)]
_EMPTY = dict.fromkeys(("row_count", *_DIGESTS), 0)


@dataclass(frozen=True)
class Batch:
    batch_id: str
    source: str
    checksum: str
    row_count: int
    watermark: dict[str, object]
    reused: bool = False


def batch_identity(source: str, digests: Mapping[str, Mapping[str, object]]) -> tuple[str, str]:
    """Batch id and checksum of a set of table digests; equal content gives an equal id."""
    content = {name: [str(values[key]) for key in sorted(values)] for name, values in digests.items()}
    text = json.dumps(content, sort_keys=True, separators=(",", ":"))
    checksum = hashlib.sha256(text.encode()).hexdigest()
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{NAMESPACE}:{source}:{checksum}")), checksum


def table_path(root: str, source: str, table: str, batch_id: str) -> str:
    return f"{root}/landing/{source}/{table}/{batch_id}"


def objects_path(root: str, batch_id: str) -> str:
    return f"{root}/control/batch_objects/{batch_id}"


def batch_objects(spark: SparkSession, root: str, batch_id: str) -> DataFrame:
    """The manifest entries of one batch: table, path, checksum, bytes and rows of every file."""
    return spark.read.schema(BATCH_OBJECTS).parquet(objects_path(root, batch_id))


def _checksum_text():
    return F.concat_ws(":", *[F.col(f"digest_{i}").cast("string") for i in range(SLICES)])


def object_manifest(files: DataFrame) -> DataFrame:
    """Rows, bytes and content checksum of every file below a Parquet path.

    One columnar pass with partial sums per task: large files are split as usual, and none is
    ever held whole in memory.
    """
    place = {"_path": F.col("_metadata.file_path"), "_size": F.col("_metadata.file_size")}
    sums = with_row_digest(files).withColumns(place).groupBy("_path", "_size").agg(*digest_sums())
    return sums.select(
        F.col("_path").alias("object_path"),
        _checksum_text().alias("checksum"),
        F.col("_size").alias("size_bytes"),
        "row_count",
    )


def known_batch(spark: SparkSession, root: str, batch_id: str) -> Batch | None:
    found = Ledger(spark, root, "batch_manifest").find(batch_id=batch_id)
    if found is None:
        return None
    watermark = json.loads(found.watermark)
    return Batch(batch_id, found.source, found.checksum, found.row_count, watermark, reused=True)


def _write_counted(df: DataFrame, path: str) -> dict[str, object]:
    """Write a table and return its rows and newest update, measured on the rows as written.

    The observation sits in the stage that writes, so every committed task is counted once.
    """
    measured = Observation()
    extra = [F.max("updated_at").alias("newest")] if "updated_at" in df.columns else []
    observed = df.observe(measured, F.count(F.lit(1)).alias("row_count"), *extra)
    observed.write.option("compression", storage.CODEC).option("maxRecordsPerFile", ROWS_PER_FILE).mode("overwrite").parquet(path)
    return measured.get


def table_sums(objects: DataFrame) -> dict[str, dict[str, object]]:
    """Rows and digest sums of every table of a manifest: those of a table are the sums of its files'."""
    slices = F.split("checksum", ":")
    sums = [F.sum(F.element_at(slices, i + 1).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"digest_{i}") for i in range(SLICES)]
    rows = objects.groupBy("table_name").agg(F.sum("row_count").alias("row_count"), *sums).collect()
    return {row.table_name: {name: row[name] for name in ("row_count", *_DIGESTS)} for row in rows}


def land_batch(
    spark: SparkSession,
    root: str,
    source: str,
    tables: Mapping[str, DataFrame],
    watermark: Mapping[str, object] | None = None,
    move_checkpoint: bool = True,
) -> Batch | None:
    """Land one extract exactly once. None when it holds no rows.

    Without a ``watermark`` it is the newest ``updated_at`` among the rows that were written, so a
    row that reaches the source meanwhile cannot be skipped by the next run.

    Each table is read once, to be written to an incoming folder. Its files are read back once for their
    manifest, and the sums of their digests name the batch, so content that was landed before is
    recognised and dropped, and the checkpoint stays where it was. Ledger entries follow the data and the checkpoint comes
    last; a run that dies in between leaves files no manifest names, and its repeat takes over.
    """
    incoming = f"{root}/incoming/{uuid.uuid4().hex}"
    listed = f"{incoming}-objects"
    writes = [lambda name=name, df=df: _write_counted(df, f"{incoming}/{name}") for name, df in tables.items()]
    written = dict(zip(tables, together(spark, *writes)))
    newest = [at for values in written.values() if (at := values.get("newest")) is not None]
    if watermark is None:
        watermark = {"updated_at": max(newest).astimezone(UTC).isoformat()} if newest else {}
    expected = {name: values["row_count"] for name, values in written.items() if values["row_count"]}
    if not expected:
        storage.remove(spark, incoming)
        return None
    manifests = []
    for name in expected:
        files = object_manifest(spark.read.schema(tables[name].schema).parquet(f"{incoming}/{name}"))
        manifests.append(files.select(F.lit(name).alias("table_name"), "*"))
    append_union(manifests).write.parquet(listed)
    objects = spark.read.schema(BATCH_OBJECTS).parquet(listed)
    found = table_sums(objects)
    landed = {name: values["row_count"] for name, values in found.items()}
    if landed != expected:
        raise RuntimeError(f"landed rows differ from extracted rows: {landed} / {expected}")
    batch_id, checksum = batch_identity(source, {name: found.get(name, _EMPTY) for name in tables})
    known = known_batch(spark, root, batch_id)
    if known:
        storage.remove(spark, incoming)
        storage.remove(spark, listed)
        return known
    moved = F.col("object_path")
    for name in expected:
        target = table_path(root, source, name, batch_id)
        if storage.exists(spark, target):
            storage.remove(spark, target)
        storage.move(spark, f"{incoming}/{name}", target)
        root_of = F.substring_index("object_path", storage.as_uri(spark, f"{incoming}/{name}/"), 1)
        place = F.concat(root_of, F.lit(storage.as_uri(spark, f"{target}/")), F.substring_index("object_path", "/", -1))
        moved = F.when(F.col("table_name") == name, place).otherwise(moved)
    # One folder per batch, replaced as a whole: a repeat after a crash leaves no stale entries.
    objects.withColumn("object_path", moved).write.mode("overwrite").parquet(objects_path(root, batch_id))
    storage.remove(spark, incoming)
    storage.remove(spark, listed)
    now = utc_now()
    rows = sum(expected.values())
    mark = json.dumps(dict(watermark), sort_keys=True, default=str)
    Ledger(spark, root, "batch_manifest").append(
        {"batch_id": batch_id, "source": source, "object_prefix": f"{root}/landing/{source}", "checksum": checksum,
         "row_count": rows, "watermark": mark, "status": "STORED", "created_at": now, "updated_at": now}
    )
    if move_checkpoint:
        save_checkpoint(spark, root, source, mark, batch_id)
    return Batch(batch_id, source, checksum, rows, dict(watermark))


def save_checkpoint(spark: SparkSession, root: str, source: str, watermark: str, batch_id: str) -> None:
    Ledger(spark, root, "source_checkpoint").append(
        {"source": source, "watermark": watermark, "batch_id": batch_id, "updated_at": utc_now()}
    )


def checkpoint(spark: SparkSession, root: str, source: str) -> dict[str, object]:
    """The source's last watermark, empty before the first batch."""
    found = Ledger(spark, root, "source_checkpoint").find(source=source)
    return json.loads(found.watermark) if found else {}


def pending_batches(manifest: DataFrame) -> DataFrame:
    """Batches still to be loaded, oldest first."""
    return manifest.where(F.col("status").isin("STORED", "FAILED")).orderBy("created_at", "batch_id")


def integrity_problems(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, unknown, or differ from their manifest entry."""
    found = object_manifest(files).select("object_path", F.struct("checksum", "size_bytes", "row_count").alias("found"))
    wanted = expected.select("object_path", F.struct("checksum", "size_bytes", "row_count").alias("wanted"))
    return found.join(wanted, "object_path", "full").where(~F.col("found").eqNullSafe(F.col("wanted")))
