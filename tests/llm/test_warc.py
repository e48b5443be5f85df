import base64
import gzip
import hashlib
import io
import zlib

import compare
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, warc
from tidemark.session import work_dir

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_equals_sql(spark):
    ours = compare.spark_rows(queries.op3_warc(spark, FOLDER))
    assert ours == compare.sql_rows(compare.connect(FOLDER), queries.SQL["op3_warc"])


def test_copies_nulls_repeats_and_long_payloads(spark, monkeypatch):
    long = "<p>é😀" * 300_000
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (7, "http://c", "same"), (7, "http://c", "same"), (3, None, None),
            (4, "x\r\nWARC-Type: evil", ""), (5, "u%0A", long), (6, "u", long), (None, "n", "alone"), (None, "n", "same"), (8, "h", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("digest", "bytes", "refers_to", "copies")}).repartition(3)
    got = warc.archived_pages(spark, pages).collect()
    assert all(r.digests_match for r in got)
    want = []
    for i, url, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        keeper = max(same, default=None)
        revisit = keeper is not None and i != keeper
        want.append((i, url or "", len((html or "").encode()), digest(html), "revisit" if revisit else "response", keeper if revisit else None))
    assert sorted(map(str, (tuple(r)[:-1] for r in got))) == sorted(map(str, want))


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "xyz"), (4, "d", "xyz")], SCHEMA)
    got = {r.page_id: r.record_type for r in warc.archived_pages(spark, pages, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archives_roll_and_an_empty_table_has_none(spark, monkeypatch):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    folder = work_dir(spark, "roll")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    manifest = warc.write_archives(spark, pages, folder)
    sums = manifest.agg(F.count(F.lit(1)), F.sum("records")).first()
    assert sums[0] >= 1 and sums[1] == pages.count()
    assert warc.read_archives(spark, manifest, folder).count() == pages.count()
    assert warc.archived_pages(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def members():
    return [warc.record_bytes(i, f"http://x/{i}", b"payload %d" % i * 1000, None, False) for i in range(5)]


@pytest.mark.parametrize("size", [1, 7, 1 << 18])
def test_sequential_reader_at_any_block_size(monkeypatch, size):
    monkeypatch.setattr(warc, "READ_BYTES", size)
    got = list(warc.read_records(io.BytesIO(b"".join(members())), payloads=True))
    assert [r.payload for r in got] == [b"payload %d" % i * 1000 for i in range(5)]
    assert all(r.sound for r in got)
    assert len(gzip.decompress(b"".join(members()))) > 5000


def test_damage_is_found():
    head, tail = members()[0], members()[1]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records(io.BytesIO(head + tail[:-20])))
    plain = gzip.decompress(head)
    changed = zlib.compressobj(5, zlib.DEFLATED, 31)
    bad = changed.compress(plain.replace(b"payload 0", b"payload 1", 1)) + changed.flush()
    assert [r.sound for r in warc.read_records(io.BytesIO(bad))] == [False]
    short = zlib.compressobj(5, zlib.DEFLATED, 31)
    cut = short.compress(plain[:-10]) + short.flush()
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.read_records(io.BytesIO(cut)))
