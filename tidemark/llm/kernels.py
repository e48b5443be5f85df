"""Vectorised text kernels: words, word hashes and shingle sets of whole Arrow text columns.

They work on the bytes of a column, a bounded block at a time, so memory follows the block and not
the batch. A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z is folded to a-z where asked.
Hashes have 64 bits; equal words have equal hashes on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SHINGLE = 5

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.Generator(np.random.PCG64(20240601))
_BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[ord("A"):ord("Z") + 1] = _BYTE_VALUES[ord("a"):ord("z") + 1]
_PLACES = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < size:
        table = np.full(max(size, BLOCK + 1), base, np.uint64)
        table[0] = 1
        known = _powers[base] = np.multiply.accumulate(table)
    return known[:size]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits; one to one."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the bounds of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), bounds


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of every span of the bytes."""
    values = (_FOLDED_VALUES if fold else _BYTE_VALUES)[data]
    values *= _power_table(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power_table(_BASE_INVERSE, len(data) + 1)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _blocks(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about BLOCK bytes that end between words."""
    low, last = int(bounds[0]), int(bounds[-1])
    while low < last:
        high = min(low + BLOCK, last)
        if high < last:
            row = int(np.searchsorted(bounds, high, "right")) - 1
            if int(bounds[row]) > low:
                high = int(bounds[row])
            else:
                while high < last and not _SEPARATOR[data[high]]:
                    high += 1
        yield low, high
        low = high


def word_spans(block: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block; no word crosses a break."""
    inside = ~_SEPARATOR[block]
    first, final = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    final[:-1] &= ~inside[1:]
    breaks = breaks[breaks < len(block)]
    first[breaks] = inside[breaks]
    before = breaks[breaks > 0] - 1
    final[before] = inside[before]
    return np.flatnonzero(first), np.flatnonzero(final) + 1


def word_hashes(column: pa.Array | pa.ChunkedArray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a text column, and the bounds of each row's words."""
    data, bounds = text_buffers(column)
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for low, high in _blocks(data, bounds):
        block = data[low:high]
        rows = bounds[np.searchsorted(bounds, low):np.searchsorted(bounds, high, "right")] - low
        starts, ends = word_spans(block, rows)
        hashes.append(hash_spans(block, starts, ends, fold))
        places.append(starts + low)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), bounds)


def shingle_sets(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, end to end, and their bounds.

    A row with one to four words has one shingle, its whole sequence; a row without words has none.
    """
    words, bounds = word_hashes(column)
    counts = np.diff(bounds)
    sets = []
    size = len(words)
    whole = np.empty(0, np.uint64)
    if size >= SHINGLE:
        whole = np.zeros(size - SHINGLE + 1, np.uint64)
        for place in range(SHINGLE):
            whole += words[place:size - SHINGLE + 1 + place] * _PLACES[place]
        whole = mix(whole)
    for row, count in enumerate(counts):
        low = bounds[row]
        if count >= SHINGLE:
            ordered = np.sort(whole[low:low + count - SHINGLE + 1])
            fresh = np.empty(len(ordered), bool)
            fresh[0] = True
            np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
            sets.append(ordered[fresh])
        elif count:
            short = (words[low:low + count] * _PLACES[:count]).sum(dtype=np.uint64)
            sets.append(mix(np.array([short + np.uint64(count)], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    ends = np.cumsum([0] + [len(s) for s in sets])
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), ends


def pieces(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with a bounded amount of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        bounds = text_buffers(column)[1]
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(bounds, bounds[low] + most_bytes, "right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            yield batch.slice(low, high - low)
            low = high


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column over flat values."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
