"""Registered queries: every operator over the given tables, and its SQL twin."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import UTC, date, datetime

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from tidemark.functions.columns import year_month  # noqa: E402
from tidemark.operators import checksums, digest_tree, joins, projection, quality, revisions, slo  # noqa: E402
from tidemark.plans import commerce, incremental, ingest, oracle, views  # noqa: E402
from tidemark.plans.publish import Gold, build_candidates  # noqa: E402
from tidemark.schemas import MARTS, MONEY, RAW_TABLES, RELATIONAL_TABLES, TOTAL  # noqa: E402
from tidemark.session import work_dir  # noqa: E402
from tidemark.sources import catalog_csv, compaction, landing, paged, pages, raw as raw_load, staged, storage, variant, windows  # noqa: E402
from tidemark.streaming import landing as streams, late  # noqa: E402

try:  # the training-data operators are a part that can be left out
    import corpus_pipeline
    from tidemark.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("tidemark.llm", "corpus_pipeline"):
        raise
    corpus_pipeline = llm_queries = None

AS_OF = datetime(2024, 1, 31, tzinfo=UTC)
Query = Callable[[SparkSession, str], DataFrame]


def _core(raw: views.RawViews) -> DataFrame:
    return commerce.core_order_financial(raw)


def _customer_orders(raw: views.RawViews) -> DataFrame:
    return commerce.mart_customer_orders(_core(raw), commerce.staging(raw, "customers"))


def _revenue(raw: views.RawViews) -> DataFrame:
    return commerce.mart_daily_revenue(_core(raw))


def _live(raw: views.RawViews, table: str) -> DataFrame:
    return commerce.staging(raw, table)


def _over_raw(build: Callable[[views.RawViews], DataFrame]) -> Query:
    return lambda spark, folder: build(views.RawViews(spark, folder))


def _over_tables(build: Callable[[views.Tables], DataFrame]) -> Query:
    return lambda spark, folder: build(views.Tables(spark, folder))


def _extract_incremental(raw):
    got = windows.extract({"orders": raw["orders"]}, watermark=datetime(1998, 2, 1, tzinfo=UTC))
    return got["orders"].select("order_id", "ordered_at", "updated_at")


def _extract_lookback(raw):
    got = windows.extract({n: raw[n] for n in ("orders", "events")}, watermark=datetime(2024, 1, 20, tzinfo=UTC))
    parts = [
        df.agg(F.count(F.lit(1)).alias("extracted"), F.max("updated_at").alias("newest")).select(
            F.lit(name).alias("table_name"), "extracted", "newest"
        )
        for name, df in got.items()
    ]
    return revisions.append_union(parts)


def _backfill_window(raw):
    window = windows.day_window(date(2024, 1, 10), date(2024, 1, 12))
    got = windows.extract({"events": raw["events"]}, window=window)
    return got["events"].select("event_id", "event_type", "occurred_at")


def _page_items(raw):
    item = F.struct("customer_id", "email", F.col("updated_at").cast("string").alias("updated_at"))
    text = F.to_json(F.struct(F.array(item).alias("items"), F.col("customer_id").alias("next_cursor")))
    record = T.StructType([T.StructField(n, T.StringType()) for n in ("customer_id", "email", "updated_at")])
    envelopes = pages.parse_pages(raw["customers"].select(text.alias("body")), "body", record)
    return pages.page_items(envelopes, window=windows.day_window(date(1995, 1, 2), date(1995, 1, 2)))


def _page_ingest(raw):
    """Customers as page files of many items, landed in two runs with pages arriving between them; what each run landed."""
    spark = raw.tables.spark
    root = work_dir(spark, "lake")
    names = ("customer_id", "email", "country", "updated_at")
    item = F.struct(*names[:3], F.col("updated_at").cast("string").alias("updated_at"))
    page = F.floor(F.regexp_extract("customer_id", "[0-9]+", 0).cast("long") / 500)
    bodies = raw["customers"].groupBy(page.alias("next_cursor")).agg(F.collect_list(item).alias("items"))
    record = T.StructType([T.StructField(n, T.StringType()) for n in names])
    landed = []
    for turn in (1, 2):
        bodies.where(F.col("next_cursor") % 2 == turn - 1).write.json(f"{root}/pages/{turn:04}")
        batch = paged.ingest_pages(spark, root, "customers", f"{root}/pages", record)
        if batch:
            rows = spark.read.parquet(landing.table_path(root, "customers", "customers", batch.batch_id))
            landed.append(rows.select(*names, F.lit(turn).alias("turn")))
        if paged.ingest_pages(spark, root, "customers", f"{root}/pages", record) is not None:
            raise RuntimeError("a run without new pages landed something")
    return revisions.append_union(landed)


def _catalog_text(tables):
    key = F.col("p_partkey")
    cost = F.when(key % 50 == 0, "not-a-decimal").when(key % 7 == 0, "").otherwise(
        F.col("p_retailprice").cast(MONEY).cast("string")
    )
    return tables["part"].select(
        F.concat(F.lit("prod_"), key.cast("string")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        cost.alias("unit_cost"),
        F.when(key % 90 == 1, "yesterday").otherwise("2026-01-01T00:00:00Z").alias("updated_at"),
    )


def _append_union(raw):
    logs = [raw["customers"].where(F.col("batch_id") == f"{views.BATCH}{n}") for n in (1, 2, 3)]
    counted = revisions.append_union(logs).groupBy("batch_id")
    return counted.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("customer_id").alias("customers"))


def _audit_append(raw):
    contract = RAW_TABLES["refunds"]
    landed = raw["refunds"].select(*contract.columns)
    rows = raw_load.typed_revisions(landed, contract, "b-1", windows.moment(AS_OF))
    return rows.withColumn("load_month", year_month(contract.month_of))


def _contract_projection(raw):
    text = raw["product_catalog"].select(
        F.lit("extra").alias("unknown"), *[F.col(n).cast("string").alias(n) for n in RAW_TABLES["product_catalog"].columns]
    )
    return projection.contract_projection(text, RAW_TABLES["product_catalog"].business)


def _generic_landing(raw):
    records = raw["customers"].select("customer_id", "email", "country", "updated_at")
    return raw_load.generic_records(records, "crm", "customers", "b-1", windows.moment(AS_OF))


def _generic_fields(raw):
    records = raw["customers"].select("customer_id", "email", "country", "updated_at")
    log = raw_load.generic_records(records, "crm", "customers", "b-1", windows.moment(AS_OF))
    return raw_load.generic_fields(log, "customers", records.schema)


def _generic_variant(raw):
    """Customers as generic records of which half got two more fields later; types are found in the log."""
    number = F.substring("customer_id", 5, 20).cast("long")
    early = raw["customers"].where(number % 2 == 0).select("customer_id", "email", "updated_at")
    later = raw["customers"].where(number % 2 == 1).select("customer_id", "email", "country", number.alias("number"), "updated_at")
    log = revisions.append_union([raw_load.generic_records(df, "crm", "customers", "b-1", windows.moment(AS_OF)) for df in (early, later)])
    return variant.generic_variant(log, "customers").withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def _source_fingerprint(tables):
    return catalog_csv.fingerprint(_catalog_text(tables))


def _business_columns(raw):
    log = raw["campaign_spend"]
    return log.select(*projection.business_columns(log))


def _load_guard(raw):
    log = raw["customers"]
    extra = F.when(F.col("batch_id").endswith("2"), 1).otherwise(0)
    manifest = log.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    manifest = manifest.select("batch_id", (F.col("n") + extra).alias("row_count"))
    return raw_load.load_guard(manifest, log.where(~F.col("batch_id").endswith("3")))


def _object_manifest(tables):
    parts = [
        landing.object_manifest(tables[name]).agg(F.sum("row_count").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name in ("customer", "orders", "supplier")
    ]
    return revisions.append_union(parts)


def _live_keys(raw, order=revisions.SOURCE_ORDER):
    parts = []
    for name in RELATIONAL_TABLES:
        key = RAW_TABLES[name].key
        parts.append(revisions.live_keys(raw[name], key, order).select(F.lit(name).alias("table_name"), F.col(key).alias("key")))
    return revisions.append_union(parts)


def _upsert(raw):
    rows = raw["customers"].select("customer_id", "email", "updated_at", "batch_id")
    first = F.col("batch_id").endswith("1")
    return revisions.upsert_latest(rows.where(first), rows.where(~first), "customer_id", ("updated_at", "batch_id"))


def _insert_if_absent(raw):
    live = revisions.live_keys(raw["customers"], "customer_id")
    buyers = raw.tables["orders"].select(
        F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")).alias("customer_id"), "o_orderkey"
    )
    return revisions.insert_if_absent(live, buyers, "customer_id", ("o_orderkey",))


def _left_join_defaults(raw):
    keys = commerce.campaign_event_metrics(_live(raw, "events")).select("event_date", "campaign_id")
    campaigns = _live(raw, "marketing_campaigns").select("campaign_id", "name", "channel", "ends_at")
    return joins.left_join_defaults(keys, campaigns, ["campaign_id"], keep_null=["ends_at"])


def _hard_delete_keys(raw):
    return revisions.hard_delete_keys(raw["customers"], views.source_customers(raw.tables), "customer_id")


def _missing_keys(raw):
    live = revisions.live_keys(raw["customers"], "customer_id")
    return revisions.missing_keys(live, views.source_customers(raw.tables), "customer_id")


def _tombstones(raw):
    now = windows.moment(datetime(2026, 2, 1, tzinfo=UTC))
    names = RAW_TABLES["customers"].columns
    return revisions.tombstones(raw["customers"], views.source_customers(raw.tables), "customer_id", names, now)


def _latest_row_for_keys(raw):
    names = RAW_TABLES["customers"].columns
    return revisions.latest_rows_for_keys(raw["customers"], raw["orders"], "customer_id", names)


def _candidates(raw):
    """The three marts, built and written once as a publishing run does."""
    spark = raw.tables.spark
    return build_candidates(Gold(spark, work_dir(spark, "candidates")), raw, "run", AS_OF)


def _compare_tables(raw):
    spark = raw.tables.spark
    copy = work_dir(spark, "revenue")
    _revenue(raw).write.parquet(copy)
    ours = spark.read.parquet(copy)
    # One table that differs from its copy and one that equals it.
    return checksums.compare_tables(
        {"mart_daily_revenue": ours, "mart_daily_revenue_copy": ours},
        {"mart_daily_revenue": ours.where(F.col("paid_orders") > 1), "mart_daily_revenue_copy": ours},
    )


def _differing_rows(raw):
    """Live orders against a copy in which some were deleted, some changed and some inserted."""
    orders = _live(raw, "orders").select(*RAW_TABLES["orders"].columns)
    number = F.substring("order_id", 5, 20).cast("long")
    status = F.when(number % 89 == 2, "lost").otherwise(F.col("status"))
    new = orders.where(number % 101 == 3).withColumn("order_id", F.concat("order_id", F.lit("-new")))
    copy = orders.where(number % 97 != 1).withColumn("status", status).unionByName(new)
    path = work_dir(raw.tables.spark, "copy")
    copy.write.parquet(path)
    return digest_tree.differing_rows(orders, raw.tables.spark.read.schema(orders.schema).parquet(path), "order_id")


def _compacted_orders(raw):
    """Orders loaded as three batches; two months are rewritten before the last batch comes."""
    spark = raw.tables.spark
    root = work_dir(spark, "lake")
    orders = raw["orders"].select(*RAW_TABLES["orders"].columns)
    lot = F.substring("order_id", 5, 20).cast("long") % 3
    for batch in range(2):
        landing.land_batch(spark, root, f"shop-{batch}", {"orders": orders.where(lot == batch)})
    staged.load_all_pending(spark, root)
    for month in ("199501", "199502"):
        compaction.compact_month(spark, root, "orders", month)
    landing.land_batch(spark, root, "shop-2", {"orders": orders.where(lot == 2)})
    staged.load_all_pending(spark, root)
    compaction.compact_month(spark, root, "orders", "199502")
    compaction.drop_replaced(spark, root, "orders")
    return compaction.read_compacted(spark, root, "orders").select(*orders.columns)


def _campaign_months(raw):
    """Distinct counts of a month from stored daily sketches, with the exact ones they have to be near."""
    spark = raw.tables.spark
    events, path = _live(raw, "events"), work_dir(spark, "sketches")
    commerce.campaign_sketches(events).write.parquet(path)
    month = F.date_format("event_date", "yyyyMM").alias("month")
    near = commerce.united_estimates(spark.read.parquet(path).select(month, "*"), "month", "campaign_id")
    exact = commerce.campaign_event_distincts(events.withColumn("occurred_at", F.date_trunc("month", "occurred_at")))
    exact = exact.select(month, *exact.columns).drop("event_date")
    both = exact.join(near.select("month", "campaign_id", *[F.col(n).alias(f"near_{n}") for n in commerce.SKETCHES]), ["month", "campaign_id"], "left")
    within = F.lit(True)
    for name in commerce.SKETCHES:
        within = within & (F.abs(F.col(f"near_{name}") - F.col(name)) <= 1 + F.lit(0.04) * F.col(name))
    return both.select(*exact.columns, F.coalesce(within, F.lit(False)).alias("within_bound"))


def _landed_and_loaded(raw):
    """All nine tables landed as one batch, checked against its manifest, loaded and read back."""
    spark = raw.tables.spark
    root = work_dir(spark, "lake")
    landing.land_batch(spark, root, "shop", {name: raw[name].select(*table.columns) for name, table in RAW_TABLES.items()})
    raw_load.load_pending(spark, root)
    parts = [
        raw_load.read_raw(spark, root, name).agg(
            F.count(F.lit(1)).alias("row_count"), F.count_distinct(table.key).alias("keys"), F.count_if("is_deleted").alias("deleted"),
            F.count_distinct("batch_id").alias("batches"),
        ).select(F.lit(name).alias("table_name"), "*")
        for name, table in RAW_TABLES.items()
    ]
    return revisions.append_union(parts)


def _halves(raw, root, name="shop"):
    """All nine tables landed as two batches of two sources; every row goes to one of them."""
    spark = raw.tables.spark
    for half, source in enumerate((name, f"{name}-2")):
        part = F.pmod(F.xxhash64("record_hash"), F.lit(2)) == half
        landing.land_batch(spark, root, source, {table: raw[table].where(part).select(*contract.columns) for table, contract in RAW_TABLES.items()})


def _load_all_pending(raw):
    """All waiting batches of all nine tables loaded together; content digests of what readers see."""
    spark = raw.tables.spark
    root = work_dir(spark, "lake")
    _halves(raw, root)
    errors = {batch: error for batch, error in staged.load_all_pending(spark, root).items() if error}
    if errors:
        raise RuntimeError(str(errors))
    loaded = {name: staged.read_loaded(spark, root, name) for name in RAW_TABLES}
    digests = checksums.table_digests({name: df.select(*RAW_TABLES[name].columns) for name, df in loaded.items()})
    batches = revisions.append_union([
        df.agg(F.count_distinct("batch_id").alias("batches")).select(F.lit(name).alias("table_name"), "batches") for name, df in loaded.items()
    ])
    return digests.join(batches, "table_name")


def _staged_load(raw):
    """Orders as readers see them while the second batch is half written, and after its repeat."""
    spark = raw.tables.spark
    root = work_dir(spark, "lake")
    orders = raw["orders"].select(*RAW_TABLES["orders"].columns)
    odd = F.substring("order_id", 5, 20).cast("long") % 2 == 1
    landing.land_batch(spark, root, "shop", {"orders": orders.where(odd)})
    staged.load_all_pending(spark, root)
    late = landing.land_batch(spark, root, "shop", {"orders": orders.where(~odd)})
    half = raw_load.typed_revisions(orders.where(~odd), RAW_TABLES["orders"], late.batch_id, windows.moment(AS_OF))
    raw_load.append_raw(half.where("currency = 'EUR'"), root, "orders")
    before = staged.read_loaded(spark, root, "orders").select(F.lit("before").alias("seen"), *orders.columns)
    before_path = work_dir(spark, "seen")
    before.write.parquet(before_path)
    staged.load_all_pending(spark, root)
    after = staged.read_loaded(spark, root, "orders").select(F.lit("after").alias("seen"), *orders.columns)
    return spark.read.schema(before.schema).parquet(before_path).unionByName(after)


def _backfill_job(raw):
    """Orders of a year come by a backfill, after all else; it ends in published marts.

    Events stay out: the given ones have sessions that check out without a cart, which the data tests refuse.
    """
    spark = raw.tables.spark
    root = work_dir(spark, "lake")
    tables = {name: _live(raw, name).select(*contract.columns) for name, contract in RAW_TABLES.items() if name != "events"}
    start, end = date(1995, 3, 1), date(1996, 2, 28)
    missed = F.col("updated_at").between(windows.moment(datetime(1995, 3, 1, tzinfo=UTC)), windows.moment(datetime(1996, 2, 28, 23, 59, 59, tzinfo=UTC)))
    landing.land_batch(spark, root, "shop", tables | {"orders": tables["orders"].where(~missed)})
    staged.load_all_pending(spark, root)
    gold = Gold(spark, f"{root}/gold")
    plan = ingest.plan_backfill("shop", start, end, "orders of a year", ["shop"], date(2026, 1, 1))
    ingest.backfill_and_publish(spark, root, plan, {"orders": tables["orders"]}, gold, AS_OF)
    return gold.read("mart_daily_revenue")


def _published_revenue(raw):
    """All marts built and published; the live revenue read through the publication ledger."""
    spark = raw.tables.spark
    gold = Gold(spark, work_dir(spark, "gold"))
    for name in build_candidates(gold, raw, "run", AS_OF):
        gold.publish(name, "run")
    return gold.read("mart_daily_revenue")


def _rolled_back_revenue(raw):
    """A second, smaller version published over the first and rolled back again."""
    spark = raw.tables.spark
    gold = Gold(spark, work_dir(spark, "gold"))
    path = work_dir(spark, "revenue")
    _revenue(raw).write.parquet(path)  # both versions come from it, so it is worked out once
    mart = spark.read.parquet(path)
    for run, rows in (("first", mart), ("second", mart.where("paid_orders > 1"))):
        gold.write_candidate(rows, "mart_daily_revenue", run, AS_OF)
        gold.publish("mart_daily_revenue", run)
    second = gold.live("mart_daily_revenue")
    gold.rollback("mart_daily_revenue", second.publication_id, "counted too few orders", dry_run=False)
    return gold.read("mart_daily_revenue")


def _catalog_csv_scan(tables):
    """The sound catalog rows written as CSV files and read back under the contract."""
    folder = f"{work_dir(tables.spark, 'catalog')}/files"
    text = _catalog_text(tables)
    sound = text.where(catalog_csv.problem(text).isNull())
    sound.write.option("header", True).option("escape", '"').csv(folder)
    return catalog_csv.read_catalog(tables.spark, folder, multi_line=False)


def _latest_incremental(raw, table):
    """The live rows of a snapshot that took the batches in one by one, the newest batch first."""
    spark = raw.tables.spark
    kept = incremental.LatestRows(spark, work_dir(spark, "latest"), table, parts=8)
    for row in raw[table].select("batch_id").distinct().orderBy(F.desc("batch_id")).collect():
        kept.refresh(raw[table], [row.batch_id])
    return kept.live()


def _revenue_by_differences(raw):
    """Daily revenue after two runs; half of all revisions arrive late, whatever they belong to."""
    spark = raw.tables.spark
    view = incremental.DailyRevenue(spark, work_dir(spark, "revenue"), parts=8)
    for half in (0, 1):
        late = F.pmod(F.xxhash64("record_hash"), F.lit(2)) == half
        view.apply({name: raw[name].where(late) for name in incremental.TABLES})
    return view.read()


def _landed_as_it_stands(raw, root):
    """The six relational tables as they stand, landed as one batch and loaded."""
    spark = raw.tables.spark
    tables = {}
    for name in RELATIONAL_TABLES:  # written, as they are read again by the jobs that follow
        rows, path = _live(raw, name).select(*RAW_TABLES[name].columns), work_dir(spark, name)
        rows.write.option("compression", storage.CODEC).parquet(path)
        tables[name] = spark.read.schema(rows.schema).parquet(path)
    batch = landing.land_batch(spark, root, "shop", tables)
    staged.load_all_pending(spark, root)
    return tables, batch


def _reconciled_keys(raw):
    """Live keys of six tables after the job that finds keys gone from the source and writes tombstones."""
    spark = raw.tables.spark
    root = work_dir(spark, "lake")
    tables, _ = _landed_as_it_stands(raw, root)
    source = {name: df.where(F.substring(F.md5(RAW_TABLES[name].key), 1, 1) != "0") for name, df in tables.items()}
    ingest.reconcile_hard_deletes(spark, root, "shop", source, datetime(2026, 2, 1, tzinfo=UTC))
    return _live_keys({name: staged.read_loaded(spark, root, name) for name in RELATIONAL_TABLES})


def _landed_twice(raw):
    """Six tables landed, and landed again: the batch is reused and the checkpoint stays where it was."""
    spark = raw.tables.spark
    root = work_dir(spark, "lake")
    tables, first = _landed_as_it_stands(raw, root)
    again = landing.land_batch(spark, root, "shop", tables, watermark={"updated_at": "2030-01-01T00:00:00+00:00"})
    mark = landing.checkpoint(spark, root, "shop")["updated_at"]
    seen = F.lit(again.reused and again.batch_id == first.batch_id)
    rows = revisions.append_union([
        staged.read_loaded(spark, root, name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name in RELATIONAL_TABLES
    ])
    return rows.withColumns({"reused": seen, "watermark": F.lit(mark).cast("timestamp")})


def _kept_snapshots(raw):
    """Five versions of revenue published, each over more days; the live one and the three before it are kept."""
    spark = raw.tables.spark
    gold = Gold(spark, work_dir(spark, "gold"))
    path = work_dir(spark, "revenue")
    _revenue(raw).write.parquet(path)
    mart = spark.read.parquet(path)
    for run in range(1, 6):
        gold.write_candidate(mart.where(F.pmod(F.day("order_date"), F.lit(6)) < run), "mart_daily_revenue", f"run-{run}", AS_OF)
        gold.publish("mart_daily_revenue", f"run-{run}")
    paths = sorted([row.candidate_path for row in gold.snapshots("mart_daily_revenue").collect() if storage.exists(spark, row.candidate_path)])
    paths.append(gold.live("mart_daily_revenue").candidate_path)
    kept = [
        spark.read.schema(MARTS["mart_daily_revenue"]).parquet(path).agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("net_revenue").cast(TOTAL).alias("net_revenue")
        ).select(F.lit(path.rpartition("/")[2]).alias("run_id"), "*") for path in paths
    ]
    return revisions.append_union(kept)


def _catalog_flags(tables):
    """The catalog file with a column that flags deleted products in several spellings."""
    folder = f"{work_dir(tables.spark, 'catalog')}/files"
    text = _catalog_text(tables)
    number = F.substring("product_id", 6, 20).cast("long") % 5
    flag = F.when(number == 0, "true").when(number == 1, "TRUE").when(number == 2, "no").when(number == 3, "False")
    sound = text.where(catalog_csv.problem(text).isNull()).withColumn("is_deleted", flag)
    sound.write.option("header", True).option("escape", '"').csv(folder)
    return catalog_csv.read_catalog(tables.spark, folder, multi_line=False)


def _table_counts(raw):
    return checksums.table_counts({name: _live(raw, name) for name in RELATIONAL_TABLES})


def _gold_rows(raw):
    return checksums.table_counts(_candidates(raw))


def _page(raw):
    since = windows.moment(datetime(1995, 1, 2, tzinfo=UTC))
    page = projection.keyset_page(_live(raw, "customers"), "customer_id", 100, after="cus_12", updated_since=since)
    return page.select("customer_id", "email", "updated_at")


def _snapshots_to_drop(tables):
    ledger = views.publication_manifest(tables)
    gone = revisions.beyond_newest(ledger, "dataset", "snapshot_table", ("created_at", "snapshot_table"))
    return gone.select("dataset", "snapshot_table")


def _orders_listing(raw):
    columns = ["order_id", "customer_email", "order_status", "gross_amount", "paid_amount", "refunded_amount", "net_amount"]
    return projection.listing(_customer_orders(raw), columns, ["order_id"])


def _funnel_listing(raw):
    columns = ["event_date", "campaign_name", "viewing_sessions", "cart_sessions", "checkout_sessions", "campaign_spend"]
    return projection.listing(commerce.mart_conversion_funnel(raw), columns, ["event_date", "campaign_id"])


class _LateRefunds(views.RawViews):
    """The raw tables with one more, late refund of 10.00 for every payment."""

    def _plan(self, name):
        log = super()._plan(name)
        if name != "refunds":
            return log
        paid = self["payments"]
        late = windows.moment(datetime(2026, 1, 4, tzinfo=UTC))
        fresh = {"status": F.lit("succeeded"), "amount": F.lit(10).cast(MONEY), "succeeded_at": late, "updated_at": late,
                 "source_updated_at": late, "refund_id": F.concat(F.lit("late_"), F.col("payment_id"))}
        return log.unionByName(paid.withColumns(fresh).select(*log.columns))


def _late_refund(spark, folder):
    return _revenue(_LateRefunds(spark, folder)).select("grain_key", "refunded_revenue", "net_revenue")


def _freshness(raw):
    return quality.freshness(raw, windows.moment(datetime(2024, 2, 1, tzinfo=UTC)))


def _source_contract(raw):
    # A payment's revisions share its transaction, so payments are taken as they stand.
    names = ("events", "order_items", "refunds", "campaign_spend", "orders", "customers", "marketing_campaigns")
    return quality.source_contract({name: raw[name] for name in names} | {"payments": _live(raw, "payments")})


def _mart_tests(raw):
    built = _candidates(raw)
    return quality.mart_tests(
        built["mart_daily_revenue"], built["mart_conversion_funnel"], built["mart_customer_orders"]
    )


def _slo_breaches(tables):
    return slo.slo_breaches({name: view(tables) for name, view in views.LEDGER_VIEWS.items()}, windows.moment(AS_OF))


class _StreamTables(views.Tables):
    """The test tables read as streams."""

    def _read(self, name):
        schema = super()._read(name).schema
        # A pattern, because a stream takes a folder or a pattern, and the table may be one file.
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}[.]parquet")


def _streamed_revisions(spark, folder):
    out = work_dir(spark, "stream-revisions")
    stream = views.raw_events(_StreamTables(spark, folder))
    streams.land_revisions(stream, f"{out}/log", f"{out}/checkpoint")
    log = spark.read.schema(stream.schema).parquet(f"{out}/log")
    return revisions.latest_live(log.drop(streams.BATCH), "event_id")


def _streamed_distinct_events(spark, folder):
    out = work_dir(spark, "stream-distinct")
    once = _StreamTables(spark, folder)["events"].select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                                                         "user_id", "event_type")
    delivered = once.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    streams.land_first_deliveries(delivered, "event_id", "ts", f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").select("event_id", "ts", "user_id", "event_type")


def _streamed_funnel_metrics(spark, folder):
    out = work_dir(spark, "stream-funnel")
    stream = views.raw_events(_StreamTables(spark, folder))
    streams.refresh_funnel_metrics(stream, f"{out}/log", f"{out}/metrics", f"{out}/checkpoint")
    return streams.read_funnel_metrics(spark, f"{out}/metrics")


def _late_events(spark, folder):
    """Events that arrive in three files, out of order by up to weeks, split by the stream's own watermark."""
    out = work_dir(spark, "late-events")
    events = views.Tables(spark, folder)["events"].select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    for arrival in range(3):
        events.where(F.col("event_id") % 3 == arrival).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    late.split_late(stream, "ts", "2 DAYS", f"{out}/rows", f"{out}/marks", f"{out}/checkpoint")
    return late.read_split(spark, f"{out}/rows", events).drop(streams.BATCH)


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query: daily revenue from the raw revision logs."""
    return _revenue(views.RawViews(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Query]:
    as_of = windows.moment
    registered: dict[str, Query] = {}
    for name in RAW_TABLES:
        registered[f"stg_{name}"] = _over_raw(lambda raw, table=name: _live(raw, table))
    over_raw = {
        "order_gross": lambda raw: commerce.order_gross(_live(raw, "order_items")),
        "order_paid": lambda raw: commerce.order_paid(_live(raw, "payments")),
        "refunds_by_order": lambda raw: commerce.refunds_by_order(_live(raw, "refunds"), _live(raw, "payments")),
        "core_order_financial": _core,
        "mart_daily_revenue": _revenue,
        "mart_customer_orders": _customer_orders,
        "mart_conversion_funnel": commerce.mart_conversion_funnel,
        "campaign_event_metrics": lambda raw: commerce.campaign_event_metrics(_live(raw, "events")),
        "campaign_event_distincts": lambda raw: commerce.campaign_event_distincts(_live(raw, "events")),
        "daily_spend": lambda raw: commerce.daily_spend(_live(raw, "campaign_spend")),
        "funnel_keys": lambda raw: commerce.funnel_keys(
            commerce.campaign_event_metrics(_live(raw, "events")), commerce.daily_spend(_live(raw, "campaign_spend"))
        ),
        "extract_incremental": _extract_incremental,
        "extract_lookback": _extract_lookback,
        "backfill_window": _backfill_window,
        "orders_in_extract_order": lambda raw: windows.in_extract_order(raw["orders"], "orders").select(
            "order_id", "updated_at"
        ),
        "source_watermark": lambda raw: windows.source_watermark([raw[n] for n in RELATIONAL_TABLES]),
        "page_items": _page_items,
        "page_ingest": _page_ingest,
        "raw_append_union": _append_union,
        "raw_audit_append": _audit_append,
        "contract_projection": _contract_projection,
        "generic_landing": _generic_landing,
        "generic_fields": _generic_fields,
        "generic_variant": _generic_variant,
        "business_columns": _business_columns,
        "load_guard": _load_guard,
        "batch_identity": lambda raw: checksums.table_digests({n: raw[n] for n in ("refunds", "campaign_spend")}),
        "upsert_latest": _upsert,
        "insert_if_absent": _insert_if_absent,
        "left_join_defaults": _left_join_defaults,
        "live_keys": _live_keys,
        "live_keys_by_load": lambda raw: _live_keys(raw, revisions.LOAD_ORDER),
        "hard_delete_keys": _hard_delete_keys,
        "missing_keys": _missing_keys,
        "tombstones": _tombstones,
        "latest_row_for_keys": _latest_row_for_keys,
        "source_net": lambda raw: quality.source_net(_live(raw, "payments"), _live(raw, "refunds")),
        "reconcile_net": lambda raw: quality.reconcile_net(_revenue(raw), _live(raw, "payments"), _live(raw, "refunds")),
        "table_checksum": lambda raw: checksums.table_checksum(_revenue(raw)),
        "compare_tables": _compare_tables,
        "landed_and_loaded": _landed_and_loaded,
        "differing_rows": _differing_rows,
        "compacted_orders": _compacted_orders,
        "campaign_months": _campaign_months,
        "reconciled_keys": _reconciled_keys,
        "landed_twice": _landed_twice,
        "kept_snapshots": _kept_snapshots,
        "load_all_pending": _load_all_pending,
        "staged_load": _staged_load,
        "backfill_job": _backfill_job,
        "published_revenue": _published_revenue,
        "rolled_back_revenue": _rolled_back_revenue,
        "stg_orders_incremental": lambda raw: _latest_incremental(raw, "orders"),
        "stg_customers_incremental": lambda raw: _latest_incremental(raw, "customers"),
        "mart_daily_revenue_delta": _revenue_by_differences,
        "table_counts": _table_counts,
        "table_count_total": lambda raw: _table_counts(raw).agg(F.sum("row_count").alias("total_rows")),
        "gold_rows": _gold_rows,
        "keyset_page": _page,
        "keyset_next_cursor": lambda raw: projection.next_cursor(_page(raw), "customer_id", 100),
        "orders_listing": _orders_listing,
        "funnel_listing": _funnel_listing,
        "daily_net_revenue": lambda raw: commerce.daily_net_revenue(_revenue(raw)),
        "duplicate_keys": lambda raw: quality.duplicate_keys(raw["order_items"], "order_item_id"),
        "null_counts": lambda raw: quality.null_counts(
            raw["events"], ["customer_id", "product_id", "campaign_id", "session_id"]
        ),
        "funnel_not_monotonic": lambda raw: quality.funnel_not_monotonic(commerce.mart_conversion_funnel(raw)),
        "negative_financials": lambda raw: quality.negative_financials(_customer_orders(raw)),
        "freshness": _freshness,
        "source_contract": _source_contract,
        "mart_tests": _mart_tests,
    }
    over_tables = {
        "catalog_csv_scan": _catalog_csv_scan,
        "catalog_flags": _catalog_flags,
        "csv_contract": lambda t: catalog_csv.catalog_violations(_catalog_text(t)),
        "source_fingerprint": _source_fingerprint,
        "object_manifest": _object_manifest,
        "snapshots_by_name": lambda t: projection.with_prefix(
            views.publication_manifest(t), "snapshot_table", "mart_daily_revenue__"
        ).select("snapshot_table", "created_at"),
        "released_runs": lambda t: slo.released_runs(views.pipeline_run(t), views.publication_manifest(t)).select(
            "run_id", "run_type", "status"
        ),
        "snapshots_to_drop": _snapshots_to_drop,
        "pending_batches": lambda t: landing.pending_batches(views.batch_manifest(t)).select("batch_id", "created_at"),
        "problem_batches": lambda t: slo.problem_batches(views.batch_manifest(t), as_of(AS_OF)),
        "problem_runs": lambda t: slo.problem_runs(views.pipeline_run(t), as_of(AS_OF)),
        "checkpoint_ages": lambda t: slo.checkpoint_ages(views.source_checkpoint(t), as_of(AS_OF)),
        "publication_ages": lambda t: slo.publication_ages(views.publication_manifest(t), as_of(AS_OF)),
        "release_problems": lambda t: slo.release_problems(views.dataset_release(t), as_of(AS_OF)),
        "slo_breaches": _slo_breaches,
    }
    registered |= {name: _over_raw(build) for name, build in over_raw.items()}
    registered |= {name: _over_tables(build) for name, build in over_tables.items()}
    registered["late_refund"] = _late_refund
    registered["late_events"] = _late_events
    registered["streamed_revisions"] = _streamed_revisions
    registered["streamed_distinct_events"] = _streamed_distinct_events
    registered["streamed_funnel_metrics"] = _streamed_funnel_metrics
    if llm_queries:
        registered |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return registered


def oracle_sql() -> dict[str, str]:
    twins = {name: oracle.sql(name) for name in queries() if name in oracle.QUERIES}
    if llm_queries:
        twins |= llm_queries.SQL
        if corpus_pipeline.ORACLE_SQL:
            twins["pipeline"] = corpus_pipeline.ORACLE_SQL
    return twins
