"""A folder of landed pages as a Spark data source, for batch reads and for streams.

A page is a JSON file whose path below the folder, without ``.json``, is its cursor; paths ascend in the order of
the pages. It holds envelopes, one or several in a row: a list of records and the cursor of what comes after.
Python only opens envelopes, a group of pages per partition, and holds one page at a time; records leave it
as JSON text, which Spark parses with the wanted schema.

The offset of a stream is the cursor of the last page that was listed, so a restart goes on behind it. A page
that arrives later under a smaller name than one already read is not seen, as with any cursor.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.functions.columns import parse_timestamp
from tidemark.sources.landing import Batch, checkpoint, land_batch, save_checkpoint
from tidemark.sources.windows import moment

SCHEMA = "page string, position int, record string"
GROUP_PAGES = 64
BATCH_RECORDS = 10_000
DECODER = json.JSONDecoder()


@dataclass
class PageGroup(InputPartition):
    names: tuple[str, ...]


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    files, place = fs.FileSystem.from_uri(path)
    return files, place.rstrip("/")


def _cursors(path: str, after: str, upto: str | None) -> list[str]:
    """The cursors behind ``after``, in order; pages being written start with a dot or an underscore."""
    files, place = _folder(path)
    listed = files.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=True))
    found = [x.path[len(place) + 1:].removesuffix(".json") for x in listed if x.type == fs.FileType.File and x.path.endswith(".json")]
    found = [name for name in found if not any(part[:1] in (".", "_") for part in name.split("/"))]
    return sorted(name for name in found if name > after and (upto is None or name <= upto))


class _Pages:
    """What batch reads and streams share."""

    def __init__(self, options: dict[str, str]):
        self.path, self.data_path = options["path"], options.get("datapath", "items")
        self.after, self.upto = options.get("after", ""), options.get("upto")
        self.group = int(options.get("grouppages", GROUP_PAGES))

    def groups(self, after: str, upto: str | None) -> list[PageGroup]:
        names = _cursors(self.path, after, upto)
        return [PageGroup(tuple(names[low:low + self.group])) for low in range(0, len(names), self.group)]

    def read(self, partition: PageGroup) -> Iterator[pa.RecordBatch]:
        files, place = _folder(self.path)
        for name in partition.names:
            with files.open_input_stream(f"{place}/{name}.json") as stream:
                text = stream.read().decode().strip()
            at = position = 0
            while at < len(text):
                body, at = DECODER.raw_decode(text, at)
                while text[at:at + 1].isspace():
                    at += 1
                if not isinstance(body, dict) or not isinstance(body.get(self.data_path), list):
                    raise ValueError(f"page {name} has no list {self.data_path}")
                records = body[self.data_path]
                for low in range(0, len(records), BATCH_RECORDS):
                    texts = [json.dumps(x, ensure_ascii=False) for x in records[low:low + BATCH_RECORDS]]
                    places = range(position, position + len(texts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(texts)), pa.array(places, pa.int32()), pa.array(texts, pa.string())],
                        ["page", "position", "record"])
                    position += len(texts)


class _PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[PageGroup]:
        return self.groups(self.after, self.upto) or [PageGroup(())]


class _PageStream(_Pages, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.seen = self.after

    def initialOffset(self) -> dict:
        return {"cursor": self.after}

    def latestOffset(self) -> dict:
        # Offsets never go back, also when pages that were read are removed.
        self.seen = max([self.seen, *_cursors(self.path, self.seen, self.upto)[-1:]])
        return {"cursor": self.seen}

    def partitions(self, start: dict, end: dict) -> list[PageGroup]:
        self.seen = max(self.seen, end["cursor"])
        return self.groups(start["cursor"], end["cursor"])

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """``spark.read.format("paged")``; options ``path``, ``dataPath``, ``after``, ``upTo`` and ``groupPages``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PageReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _PageStream(self.options)


def last_cursor(path: str, after: str = "") -> str:
    """The cursor of the last page behind ``after``, or ``after``."""
    return max([after, *_cursors(path, after, None)[-1:]])


def _typed(records: DataFrame, schema: T.StructType) -> DataFrame:
    item = F.from_json("record", schema, {"mode": "FAILFAST"})
    return records.select("page", "position", item.alias("item")).select("page", "position", "item.*")


def read_paged(spark: SparkSession, path: str, record: T.StructType, after: str = "", upto: str | None = None, **options) -> DataFrame:
    """The records of the pages behind ``after``, with their page and position. Broken pages fail the read."""
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").options(path=path, after=after, **options)
    return _typed((reader.option("upTo", upto) if upto is not None else reader).load(), record)


def stream_paged(spark: SparkSession, path: str, record: T.StructType, **options) -> DataFrame:
    """The same rows as a stream that follows the folder."""
    spark.dataSource.register(PagedSource)
    return _typed(spark.readStream.format("paged").options(path=path, **options).load(), record)


def ingest_pages(
    spark: SparkSession, root: str, source: str, path: str, record: T.StructType,
    updated_at: str = "updated_at", window: tuple[datetime, datetime] | None = None, **options,
) -> Batch | None:
    """Land the records of the pages behind the source's checkpoint. None when there are none.

    ``updated_at`` is landed as a timestamp, the other fields as ``record`` types them. The checkpoint holds the
    last page's cursor and the newest time landed so far. It moves last, also when the content is known from
    a run that died before it moved. A window reads all pages, keeps ``[start, end)``, drops records without a
    time and moves no checkpoint.
    """
    mark = {} if window else checkpoint(spark, root, source)
    after = str(mark.get("cursor", ""))
    upto = last_cursor(path, after)
    if upto == after:
        return None
    rows = read_paged(spark, path, record, after, upto, **options).drop("page", "position")
    rows = rows.withColumn(updated_at, parse_timestamp(updated_at))
    if window:
        rows = rows.where((F.col(updated_at) >= moment(window[0])) & (F.col(updated_at) < moment(window[1])))
    batch = land_batch(spark, root, source, {source: rows}, move_checkpoint=False)
    if not window:
        # Pages without records have no batch, but their cursor is passed for good.
        newest = [str(x["updated_at"]) for x in (mark, batch.watermark if batch else {}) if x.get("updated_at")]
        new_mark = {"cursor": upto} | ({"updated_at": max(newest, key=datetime.fromisoformat)} if newest else {})
        save_checkpoint(spark, root, source, json.dumps(new_mark, sort_keys=True), batch.batch_id if batch else str(mark.get("batch_id", "")))
    return batch
