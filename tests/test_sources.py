from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import catalog_csv, pages, windows

HEADER = "product_id,product_name,category,unit_cost,updated_at,is_deleted"
GOOD = f"""{HEADER}
prod_001,Everyday Sneakers,footwear,22.50,2026-01-01T00:00:00+00:00,false
prod_002,"Canvas, ""big""
Backpack",bags,31.00,2026-01-01T00:00:00Z,TRUE
prod_003,Reusable Bottle,accessories,,2026-01-01T02:00:00+02:00,false
"""
BAD = f"""{HEADER}
prod_001,Everyday Sneakers,footwear,not-a-decimal,2026-01-02T00:00:00+00:00,false
prod_002,Canvas Backpack,bags,31.00,2026-01-01T00:00:00+00:00,false
"""


def written(tmp_path, text, name="catalog.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_good_catalog(spark, tmp_path):
    rows = catalog_csv.read_catalog(spark, written(tmp_path, GOOD)).orderBy("product_id").collect()
    assert [str(r.unit_cost) for r in rows] == ["22.50", "31.00", "None"]
    assert rows[1].product_name == 'Canvas, "big"\nBackpack'
    assert [r.is_deleted for r in rows] == [False, True, False]
    assert {r.updated_at for r in rows} == {datetime(2026, 1, 1)}


def test_bad_catalog_fails_whole_and_is_explained(spark, tmp_path):
    path = written(tmp_path, BAD)
    with pytest.raises(Exception, match="unit_cost is not numeric"):
        catalog_csv.read_catalog(spark, path).collect()
    # Not even a query that needs no bad column gets through.
    with pytest.raises(Exception, match="catalog contract"):
        catalog_csv.read_catalog(spark, path).select("category").collect()
    found = catalog_csv.catalog_violations(catalog_csv.read_text_columns(spark, path)).collect()
    assert [(r.product_id, r.unit_cost, r.problem) for r in found] == [
        ("prod_001", "not-a-decimal", "unit_cost is not numeric")
    ]
    assert found[0].file_path.endswith("catalog.csv")


def test_missing_column_and_optional_flag(spark, tmp_path):
    with pytest.raises(ValueError, match="unit_cost"):
        catalog_csv.read_catalog(spark, written(tmp_path, "product_id,product_name,category,updated_at\n"))
    text = "product_id,product_name,category,unit_cost,updated_at\np,n,c,1,2026-01-01T00:00:00Z\n"
    assert catalog_csv.read_catalog(spark, written(tmp_path, text)).first().is_deleted is False


def test_fingerprint_changes_with_content_only(spark, tmp_path):
    one = catalog_csv.text_fingerprint(spark, written(tmp_path, GOOD))
    two = catalog_csv.text_fingerprint(spark, written(tmp_path, GOOD, "copy.csv"))
    three = catalog_csv.text_fingerprint(spark, written(tmp_path, GOOD.replace("22.50", "22.51"), "new.csv"))
    assert one == two != three
    assert catalog_csv.changed_since(one, None)
    assert not catalog_csv.changed_since(one, {"sha256": one})
    assert catalog_csv.changed_since(three, {"sha256": one})


RECORD = T.StructType([T.StructField("campaign_id", T.StringType()), T.StructField("updated_at", T.StringType())])
PAGES = [
    '{"items": [{"campaign_id": "a", "updated_at": "2026-01-01T00:00:00Z"},'
    ' {"campaign_id": "b", "updated_at": "2026-01-02T23:59:59+00:00"}], "next_cursor": "b"}',
    '{"items": [{"campaign_id": "c", "updated_at": "2026-01-03T00:00:00Z"}, {"campaign_id": "d"}],'
    ' "next_cursor": null}',
    '{"items": [], "next_cursor": null}',
]


def test_pages_are_flattened_and_windowed(spark, tmp_path):
    written(tmp_path, "\n".join(PAGES), "pages.json")
    landed = pages.read_pages(spark, str(tmp_path / "pages.json"), RECORD)
    ids = [r.campaign_id for r in pages.page_items(landed).orderBy("campaign_id").collect()]
    assert ids == ["a", "b", "c", "d"]
    window = windows.day_window(date(2026, 1, 1), date(2026, 1, 2))
    inside = pages.page_items(landed, window=window)
    assert sorted(r.campaign_id for r in inside.collect()) == ["a", "b"]
    assert pages.page_watermark(pages.page_items(landed)).first().updated_at == datetime(2026, 1, 3)


def test_broken_page_fails(spark, tmp_path):
    written(tmp_path, '{"items": [', "broken.json")
    with pytest.raises(Exception):
        pages.read_pages(spark, str(tmp_path / "broken.json"), RECORD).collect()


def test_watermark_compares_times_not_text(spark):
    texts = ["2026-01-01T23:00:00-05:00", "2026-01-02T01:00:00+00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "updated_at string")
    assert pages.page_watermark(df).first().updated_at == datetime(2026, 1, 2, 4)


def test_lower_bounds():
    mark = datetime(2026, 1, 10, tzinfo=UTC)
    assert windows.lower_bound(mark, "orders") == datetime(2026, 1, 9, 22, tzinfo=UTC)
    assert windows.lower_bound(mark, "events") == datetime(2026, 1, 8, tzinfo=UTC)
    assert windows.lower_bound(None, "orders") == windows.EPOCH


def test_window_is_half_open_and_reaches_the_scan(spark, tmp_path):
    hours = spark.range(24 * 4).select(
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2026-01-01").cast("timestamp")).alias("updated_at")
    )
    hours.write.parquet(f"{tmp_path}/hours")
    df = windows.within(
        spark.read.parquet(f"{tmp_path}/hours"), "updated_at", windows.day_window(date(2026, 1, 2), date(2026, 1, 3))
    )
    assert df.count() == 48
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(updated_at,2026-01-02" in plan and "LessThan(updated_at,2026-01-04" in plan


def test_cursor_predicates_cover_every_row_once():
    spans = windows.cursor_predicates("updated_at", datetime(2026, 1, 1, tzinfo=UTC), datetime(2026, 1, 5, tzinfo=UTC), 4)
    assert len(spans) == 4
    assert spans[0].startswith("updated_at >= TIMESTAMP WITH TIME ZONE '2026-01-01 00:00:00.000000+00:00'")
    for left, right in zip(spans, spans[1:]):
        assert left.split(" < ")[1] == right.split(" AND ")[0].split(" >= ")[1]
    assert "<" not in spans[-1]


def test_moved_continuation_lines_are_a_change(spark, tmp_path):
    head = "product_id,product_name,category,unit_cost,updated_at\n"
    one = head + 'p1,"lamp\nred",home,1.00,2026-01-01T00:00:00Z\np2,"desk\noak",home,2.00,2026-01-01T00:00:00Z\n'
    two = head + 'p1,"lamp\noak",home,2.00,2026-01-01T00:00:00Z\np2,"desk\nred",home,1.00,2026-01-01T00:00:00Z\n'
    assert sorted(one.split("\n")) == sorted(two.split("\n"))
    prints = [catalog_csv.text_fingerprint(spark, written(tmp_path, text, f"{i}.csv")) for i, text in enumerate((one, two))]
    assert prints[0] != prints[1]


def test_days_months_and_hashes_do_not_depend_on_the_zone(spark):
    from tidemark.functions import columns

    df = spark.range(1).select(F.timestamp_micros(F.lit(1767232800123456)).alias("at"), F.lit("x").alias("name"))
    seen = set()
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = df.select(columns.utc_day("at").cast("string").alias("day"), columns.year_month("at").alias("month"),
                            columns.utc_text("at").alias("text"), columns.record_hash(df, ["at", "name"]).alias("hash"),
                            columns.record_json(["at", "name"]).alias("json")).first()
            seen.add(tuple(row))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(seen) == 1
    assert next(iter(seen))[:3] == ("2026-01-01", "202601", "2026-01-01 02:00:00.123456")
