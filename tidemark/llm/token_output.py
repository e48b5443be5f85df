"""Token-ID output as Parquet list columns that allow selective reads of tokens and metadata.

Documents are sorted by doc_id over all files. A row holds doc_id, the ids as a list, their number and the
place within its shard (the file's part). Token ids are dictionary encoded, which packs a 50,000-word
vocabulary into 16 bits an id; doc_id, n_tokens and start are delta encoded. Row groups and pages have set
sizes and every file has page indexes, so a reader of some documents or of the metadata alone
skips the rest.

Pieces of text between places where the tokenizer can join nothing repeat often, so each distinct piece
of a run of documents is encoded once, and a worker keeps the ids of a bounded number of pieces that came more
than once for its later runs and tasks; ids are then put together per document.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import kernels
from tidemark.session import work_dir

END = 2
PIECE_BYTES = 8 << 20
GROUP_PIECES = 1000
KNOWN_PIECES = 1 << 18
KNOWN_IDS = 32
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10


@lru_cache(maxsize=2)
def _tokenizer(path: str, specials_are_text: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = specials_are_text
    lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, number in tokenizer.get_vocab().items():
        lengths[number] = len(token)  # a byte-level token has one character a byte
    return tokenizer, lengths


def _solid(data: np.ndarray) -> np.ndarray:
    """Whether each byte certainly ends a character that is no white space."""
    solid = (data > 0x20) & (data < 0x7F)
    tail = (data >= 0x80) & (data < 0xC0)
    # White space beyond ASCII starts with C2, E1, E2 or E3.
    one, two = np.zeros_like(data), np.zeros_like(data)
    one[1:], two[2:] = data[:-1], data[:-2]
    return solid | tail & (one != 0xC2) & ~((two >= 0xE1) & (two <= 0xE3)) & (one >= 0x80)


def piece_bounds(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of pieces: row starts, and each space or line feed after a solid character.

    The tokenizer's pattern has no match with white space after something else, so no token crosses
    such a place, and the text before it has no influence on what follows.
    """
    start = np.zeros(len(data), bool)
    start[1:] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & _solid(data)[:-1]
    start[rows[rows < len(data)]] = True
    return np.flatnonzero(start)


class KnownPieces:
    """The ids of pieces that came more than once, found by the hash of their bytes.

    There are at most ``most`` pieces, of ``KNOWN_IDS`` ids at most; longer ones are encoded again in each run.
    """

    def __init__(self, most: int = KNOWN_PIECES):
        self.most, self.hashes, self.tokens = most, np.empty(0, np.uint64), np.empty(0, np.int32)
        self.begin, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is known."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def learn(self, hashes: np.ndarray, tokens: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        """Keep new pieces while there is room; ``begin`` and ``count`` say where in ``tokens`` their ids are."""
        room, short = self.most - len(self.hashes), count <= KNOWN_IDS
        hashes, begin, count = hashes[short], begin[short], count[short]
        hashes, begin, count = hashes[:room], begin[:room], count[:room]
        if not len(hashes):
            return
        upto = np.cumsum(count)
        own = tokens[np.repeat(begin - upto + count, count) + np.arange(upto[-1])]
        order = np.argsort(np.concatenate([self.hashes, hashes]))
        begin = np.concatenate([self.begin, len(self.tokens) + upto - count])[order]
        count = np.concatenate([self.count, count])[order]
        hashes = np.concatenate([self.hashes, hashes])[order]
        tokens = np.concatenate([self.tokens, own])
        # All at once, as the pieces may outlive a task that fails.
        self.begin, self.count, self.hashes, self.tokens = begin, count, hashes, tokens


@lru_cache(maxsize=2)
def _known_pieces(path: str, specials_are_text: bool) -> KnownPieces:
    """The pieces a worker knows under one tokenizer; ids do not depend on what is known."""
    return KnownPieces()


def encode_column(column: pa.Array, path: str, specials_are_text: bool = False,
                  known: KnownPieces | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of every row, end to end, and their bounds; nothing is added.

    The string of a special token in a text becomes that token, as the library does by default, or is
    encoded as any other text. Texts have to be encoded alike wherever ``known`` is shared.
    """
    tokenizer, lengths = _tokenizer(path, specials_are_text)
    known = known or KnownPieces(0)
    data, bounds = kernels.text_buffers(column)
    data, bounds = data[bounds[0]:bounds[-1]], bounds - bounds[0]
    if not len(data):
        return np.empty(0, np.int32), np.zeros(len(bounds), np.int64)
    starts = piece_bounds(data, bounds)
    ends = np.append(starts[1:], len(data))
    hashes = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(int(np.searchsorted(starts, starts[low] + kernels.BLOCK)), low + 1)
        at, to = int(starts[low]), int(ends[high - 1])
        hashes[low:high] = kernels.hash_spans(data[at:to], starts[low:high] - at, ends[low:high] - at, fold=False)
        low = high
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    at_known, is_known = known.find(distinct)
    new = np.flatnonzero(~is_known)
    # A piece may be joined with its neighbours when it starts with white space and ends with a solid character.
    solid = _solid(data)
    joins = ((data[starts[first[new]]] == 0x20) | (data[starts[first[new]]] == 0x0A)) & solid[ends[first[new]] - 1]
    order = np.concatenate([new[joins], new[~joins]])
    raw, at, to = data.tobytes(), starts[first[order]], ends[first[order]]
    several = int(joins.sum())
    groups = [(low, min(low + GROUP_PIECES, several)) for low in range(0, several, GROUP_PIECES)]
    groups += [(low, low + 1) for low in range(several, len(order))]
    texts = [b"".join(raw[at[i]:to[i]] for i in range(low, high)).decode() for low, high in groups]
    tokens = [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    tokens = np.concatenate([known.tokens, *tokens])
    # Piece boundaries in the new tokens, by the bytes that each token stands for.
    base = len(known.tokens)
    token_ends = np.cumsum(lengths[tokens[base:]])
    piece_ends = np.cumsum(to - at)
    upto = np.searchsorted(token_ends, piece_ends, "left") + 1
    if not np.array_equal(token_ends[upto - 1], piece_ends):
        raise ValueError("a token crosses a piece of text")
    begin, count = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
    begin[is_known], count[is_known] = known.begin[at_known[is_known]], known.count[at_known[is_known]]
    before = np.append(0, upto)[:-1]
    begin[order], count[order] = base + before, upto - before
    again = new[np.bincount(which, minlength=len(distinct))[new] > 1]
    known.learn(distinct[again], tokens, begin[again], count[again])
    counts = count[which]
    total = np.append(0, np.cumsum(counts))
    ids = tokens[np.repeat(begin[which] - total[:-1], counts) + np.arange(total[-1])]
    return ids, total[np.searchsorted(starts, bounds)]


def _encode(path: str, end: int, specials_are_text: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, placed, known = TaskContext.get().partitionId(), 0, _known_pieces(path, specials_are_text)
        for piece in kernels.pieces(batches, "text", PIECE_BYTES):
            ids, bounds = encode_column(piece.column("text"), path, specials_are_text, known)
            rows = piece.num_rows
            ids = np.insert(ids, bounds[1:], end)
            bounds = bounds + np.arange(rows + 1)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.full(rows, shard, np.int32)), pa.array(placed + bounds[:-1], pa.int64()),
                 pa.array(np.diff(bounds), pa.int64()), kernels.lists(ids.astype(np.int32), bounds, pa.int32())],
                ["doc_id", "shard", "start", "n_tokens", "tokens"])
            placed += int(bounds[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, specials_are_text: bool = False) -> None:
    """Write the ids of every text in ascending doc_id order.

    A null text is empty; every document gets the end id. A null doc_id comes first; rows with the
    same doc_id stand side by side, ordered by text. The string of a special token inside a text becomes that
    token unless ``specials_are_text``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encode(tokenizer, end, specials_are_text), "doc_id long, shard int, start long, n_tokens long, tokens array<int>")
    options = {
        "compression": "snappy",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#tokens.list.element": "true",
    }
    writer = encoded.write
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.parquet(path)


def _shard_starts(stored: DataFrame) -> DataFrame:
    """(shard, base): tokens before each shard; one row per file."""
    sums = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document, without reading a token."""
    stored = spark.read.parquet(path)
    return stored.select("doc_id", "shard", "start", "n_tokens").join(_shard_starts(stored), "shard").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, tokens) of the documents from ``low`` to ``high``; pages of others are skipped."""
    stored = spark.read.parquet(path)
    if low is not None:
        stored = stored.where(F.col("doc_id") >= low)
    if high is not None:
        stored = stored.where(F.col("doc_id") <= high)
    return stored.select("doc_id", "tokens")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        flat = tokens.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        at = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
        sums = [zlib.crc32(flat[low:high].tobytes()) for low, high in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("shard"), batch.column("start"), pa.array(np.diff(at), pa.int64()),
             pa.array(sums, pa.int64())], ["doc_id", "shard", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the stored ids themselves."""
    stored = spark.read.parquet(path)
    kind = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"
    read = stored.select("doc_id", "shard", "start", "tokens").mapInArrow(_sums, kind)
    return read.join(_shard_starts(stored), "shard").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def stored_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and return what they hold, a row per document."""
    path = f"{work_dir(spark, 'tokens')}/files"
    write_tokens(docs, path, tokenizer, end)
    return token_digests(spark, path)
