"""numpy kernels over Arrow text columns: bounded slices, ASCII-white-space words, 64-bit word and shingle hashes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the text's UTF-8 form, with A-Z lower-cased where asked for.
Words are identified by a 64-bit hash; two different words of one corpus share it with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: The first 0 to 8 bytes of an integer.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Bytes of text that a kernel works on at once (a longer single text makes a slice of its own).
SLICE_BYTES = 4 << 20
SHINGLE_WORDS = 5
#: glibc's way to give free memory back; None elsewhere.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give the system back what the allocators hold of freed memory: workers outlive their tasks, and idle ones count too."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    y = x >> np.uint64(30)
    y ^= x
    y *= C2
    y ^= y >> np.uint64(27)
    y *= C3
    y ^= y >> np.uint64(31)
    return y


def low40(h: np.ndarray) -> bytes:
    """The low 40 bits of each hash, in five bytes."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from40(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice's texts hold at most `most` bytes, or one text; freed memory goes back after each batch."""
    for batch in batches:
        _, at = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
        release()


def joined(batches: Iterable[pa.RecordBatch], most: int, column: str = "text", rows: int = 65_000) -> Iterator[pa.RecordBatch]:
    """Slices gathered until about `most` bytes of text or `rows` rows are reached."""
    held, size, count = [], 0, 0
    for whole in slices(batches, most, column):
        for part in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
            _, at = flat(part.column(column))
            if held and (size + at[-1] > most or count + part.num_rows > rows):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, count = [], 0, 0
            held.append(part)
            size += int(at[-1])
            count += part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the byte spans of the words, and for each row the index of its first word (n + 1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[0] = after[-1] = True
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    ink = ~space
    starts, ends = np.flatnonzero(ink & before), np.flatnonzero(ink & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * C1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    short = np.flatnonzero(size <= LONG_WORD)
    left = size[short]
    pos = starts[short]
    while len(short):
        take = np.minimum(left, 8)
        chunk = eight[pos] & FIRST[take]
        out[short] = mix(out[short] * C1 + chunk)
        more = left > 8
        short, left, pos = short[more], left[more] - 8, pos[more] + 8
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all rows, first): row i has the words first[i] to first[i + 1]."""
    data, at = flat(column)
    starts, ends, first = words(data, at)
    return span_hashes(LOWER[data] if lower else data, starts, ends), first


def shingle_sets(column: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each row's distinct shingles of `width` words in ascending order of their hashes.

    A row with fewer words has its whole word sequence as its one shingle; a row without words has none.
    """
    h, first = word_hashes(column)
    count = np.diff(first)
    own = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(own)])
    out = np.empty(bounds[-1], np.uint64)
    keys = mix(C1 * (2 * np.arange(width, dtype=np.uint64) + np.uint64(1))) | np.uint64(1)
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        rolled += h[j : j + len(rolled)] * keys[j]
    rolled = mix(rolled)
    keep = np.zeros(bounds[-1], bool)
    for i in np.flatnonzero(own):
        a, b, f = bounds[i], bounds[i + 1], first[i]
        if count[i] >= width:
            out[a:b] = rolled[f : f + b - a]
            out[a:b].sort()
        else:
            out[a] = mix(np.sum(h[f : f + count[i]] * keys[: count[i]], keepdims=True) + count[i : i + 1].astype(np.uint64) * C3)[0]
    if len(out):
        keep[1:] = out[1:] != out[:-1]
        keep[bounds[:-1][own > 0]] = True
    sizes = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(bounds[:-1], len(keep))) if len(own) else own
    sizes = np.where(own > 0, sizes, 0)
    return out[keep], np.concatenate([[0], np.cumsum(sizes)])
