"""Vectorised kernels over UTF-8 text columns, shared by the operators of this subpackage.

Text is handled as one contiguous byte array per chunk of whole documents plus document offsets,
so that numpy works on megabytes at a time and no kernel loops over words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of whole documents handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20

#: The separators of `[^\x20\x09-\x0D]+` (fixed values of the word definition).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: A random value for each byte keeps the polynomial from being fooled by small byte values.
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, list[np.ndarray]] = {}
#: Powers are kept for the low bits and for the high bits of an exponent apart, so tables stay small.
LOW_BITS = 16


def _power_tables(base: int, most: int) -> list[np.ndarray]:
    """base**0 .. base**(2**LOW_BITS - 1), and base**(k << LOW_BITS) for all k that exponents up to `most` need."""
    tables = _powers.get(base) or [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    for i, (step, need) in enumerate(((base, 1 << LOW_BITS), (pow(base, 1 << LOW_BITS, 1 << 64), (most >> LOW_BITS) + 1))):
        if len(tables[i]) < need:
            with np.errstate(over="ignore"):
                out = np.full(max(need, 256), np.uint64(step), np.uint64)
                out[0] = 1
                np.cumprod(out, out=out)
            tables[i] = out
    _powers[base] = tables
    return tables


def power_at(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64."""
    low, high = _power_tables(base, int(at.max(initial=0)))
    with np.errstate(over="ignore"):
        return low[at & ((1 << LOW_BITS) - 1)] * high[at >> LOW_BITS]


def power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return power_at(base, np.arange(n))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def _gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Joins small batches until their text holds about `size` bytes."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.column(batch.schema.get_field_index(column)).nbytes
        if total >= size:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in parts that hold about `size` bytes of whole documents each."""
    try:
        for batch in _gathered(batches, column, size):
            raw, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
                if at == 0 and off[-1] <= size + size // 2:
                    end = batch.num_rows
                yield batch.slice(at, end - at), raw[off[at] : off[end]], off[at : end + 1] - off[at]
                at = end
    finally:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on between tasks, and idle ones should be small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's own, where it has one
    if trim is not None:
        trim(0)


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each document the number of its first word."""
    word = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    if len(raw):
        edge[1:-1] = word[1:] & ~word[:-1]
        edge[0] = word[0]
        inner = off[:-1][np.diff(off) > 0]
        edge[inner] = word[inner]
    starts = np.flatnonzero(edge)
    stop = np.zeros(len(raw) + 1, bool)
    if len(raw):
        stop[1:-1] = word[:-1] & ~word[1:]
        stop[-1] = word[-1]
        last = off[1:][np.diff(off) > 0]
        stop[last] = word[last - 1]
    return starts, np.flatnonzero(stop), np.searchsorted(starts, off)


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes, or of 64-bit word codes; `span_hash` reads the hash of any span from it."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    low, high = _power_tables(_BASE, len(symbols))
    with np.errstate(over="ignore"):
        for k in range(0, len(symbols), len(low)):
            part = symbols[k : k + len(low)]
            own = out[k + 1 : k + 1 + len(part)]
            np.multiply(_BYTE_CODE[part] if part.dtype == np.uint8 else mix64(part ^ np.uint64(_BASE)), low[: len(part)], out=own)
            own *= high[k >> LOW_BITS]
            own[0] += out[k]
            np.cumsum(own, out=own)
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of symbols[start:end]; equal symbols give equal hashes anywhere."""
    with np.errstate(over="ignore"):
        value = (prefix[ends] - prefix[starts]) * power_at(_BASE_INV, starts)
        return mix64(value + (ends - starts).astype(np.uint64))


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of start..start+length for all pairs."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    if len(shift) and total < 2**31 and -(2**31) < shift.min() and shift.max() + total < 2**31:
        out = np.repeat(shift.astype(np.int32), lengths)
        out += np.arange(total, dtype=np.int32)
        return out
    return np.repeat(shift, lengths) + np.arange(total)


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums over values[off[i]:off[i+1]] as int64, empty segments included."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:], dtype=np.int64)
    return run[off[1:]] - run[off[:-1]]


def list_column(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """A list column from flat values and int offsets."""
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))
