from pathlib import Path

import seed

from tidemark.operators.revisions import latest_live
from tidemark.plans import commerce
from tidemark.schemas import RAW_TABLES
from tidemark.sources.raw import typed_revisions
from tidemark.sources.windows import moment
from tidemark.streaming import landing as streams


def arrive(spark, folder, rows, batch):
    revisions = typed_revisions(seed.source(spark, "events", rows), RAW_TABLES["events"], batch, moment(seed.at(9)))
    revisions.coalesce(1).write.mode("append").parquet(folder)
    return revisions


def stream_of(spark, folder, schema, files_per_batch=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def rows_of(df):
    return sorted(tuple(str(v) for v in row) for row in df.select(sorted(df.columns)).collect())


EVENTS = seed.ROWS["events"]


def delete(event, at):
    return (*event[:7], at, True)


def late_view(number, days):
    """An event that happened long before the others and arrives after them."""
    when = seed.at(-days)
    return (f"evt_late_{number}", "product_viewed", "sess_late", None, None, "cmp_001", when, when, False)


def test_landing_equals_batch_and_loses_nothing_late(spark, tmp_path):
    incoming, log, mark = (f"{tmp_path}/{n}" for n in ("in", "log", "mark"))
    waves = [EVENTS[:4], EVENTS[2:], [late_view(1, 90), delete(EVENTS[0], seed.at(3))]]
    whole = None
    for number, rows in enumerate(waves):
        part = arrive(spark, incoming, rows, f"batch-{number}")
        whole = part if whole is None else whole.unionByName(part)
        streams.land_revisions(stream_of(spark, incoming, part.schema), log, mark)
    landed = spark.read.schema(whole.schema).parquet(log).drop(streams.BATCH)
    assert landed.count() == sum(map(len, waves))
    assert rows_of(latest_live(landed, "event_id")) == rows_of(latest_live(whole, "event_id"))


def forget_last_commit(mark):
    """Make the last micro-batch look unfinished, so the next run replays it."""
    commits = sorted((p for p in (Path(mark) / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)


def test_replayed_batch_replaces_itself(spark, tmp_path):
    incoming, log, mark = (f"{tmp_path}/{n}" for n in ("in", "log", "mark"))
    part = arrive(spark, incoming, EVENTS, "batch-1")
    for _ in range(2):
        streams.land_revisions(stream_of(spark, incoming, part.schema), log, mark)
        assert spark.read.schema(part.schema).parquet(log).count() == len(EVENTS)
        forget_last_commit(mark)


def test_first_deliveries_are_exact_in_any_order(spark, tmp_path):
    incoming, table, mark = (f"{tmp_path}/{n}" for n in ("in", "table", "mark"))
    waves = [EVENTS[3:], EVENTS[:5] + EVENTS[:2], [late_view(1, 400)] + EVENTS[4:6], [late_view(1, 400)]]
    want = sorted({e[0] for e in EVENTS} | {"evt_late_1"})

    def run(checkpoint, files=1):
        stream = stream_of(spark, incoming, part.schema, files)
        streams.land_first_deliveries(stream, "event_id", "occurred_at", table, checkpoint)
        return sorted(r.event_id for r in spark.read.parquet(table).collect())

    for number, rows in enumerate(waves):
        part = arrive(spark, incoming, rows, f"batch-{number}")
        found = run(mark)
        if number == 1:
            forget_last_commit(mark)
            assert run(mark) == found
    assert found == want
    # A lost checkpoint delivers everything once more; the table already holds it.
    assert run(f"{mark}-new", files=100) == want


def test_watermark_dedup_equals_batch_on_ordered_input(spark, tmp_path):
    incoming, out = f"{tmp_path}/in", f"{tmp_path}/out"
    ordered = sorted(EVENTS, key=lambda e: e[6])
    for number, rows in enumerate([ordered[:4], ordered[2:6], ordered[4:]]):
        part = arrive(spark, incoming, rows, f"batch-{number}")
    stream = streams.drop_redelivered(stream_of(spark, incoming, part.schema), "event_id", "occurred_at")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/mark")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == sorted(e[0] for e in EVENTS)


def test_funnel_metrics_follow_late_events_and_deletes(spark, tmp_path):
    incoming, log, metrics, mark = (f"{tmp_path}/{n}" for n in ("in", "log", "metrics", "mark"))
    waves = [
        EVENTS[:4],
        EVENTS[4:],
        [late_view(1, 40)],
        [delete(EVENTS[0], seed.at(3))],
        [delete(event, seed.at(4)) for event in EVENTS[5:]],
    ]
    whole = None
    for number, rows in enumerate(waves):
        part = arrive(spark, incoming, rows, f"batch-{number}")
        whole = part if whole is None else whole.unionByName(part)
        streams.refresh_funnel_metrics(stream_of(spark, incoming, part.schema), log, metrics, mark)
        batch = commerce.campaign_event_metrics(latest_live(whole, "event_id"))
        assert rows_of(streams.read_funnel_metrics(spark, metrics)) == rows_of(batch)
    # The second day has lost all its events by now.
    assert {str(r.event_date) for r in batch.collect()} == {"2025-11-22", "2026-01-01"}
