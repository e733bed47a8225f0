"""Elias-Fano coding of monotone sequences, and one level of an n-gram trie, contexts and successors, in one memory-mapped file.

Both are queried as they are coded: a value is the place of its bit in the high part (a select, by a directory of counts)
and a field of the low part; a successor search halves the range of its context.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np


#: Bits of the high part that one entry of a sequence's directory covers.
COVER = 128  # two words
#: Ranges of more values are narrowed to the values with the key's high part before they are halved.
WIDE = 8
#: Queries of a sequence that are answered at once.
QUERIES = 1 << 16
#: Values that are coded at once; a multiple of eight, so that their bits end with a byte.
CHUNK = 1 << 16
#: For each byte and k, the place of its k-th set bit (8 where it has fewer).
PLACE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)
HEAD = struct.Struct("<QQQ")


def encode(values: np.ndarray) -> bytes:
    """A monotone sequence of integers below 2^63: low bits in fields of one width, high bits in unary."""
    v = np.asarray(values, np.uint64)
    n, top = len(v), int(v[-1]) + 1 if len(v) else 1
    low = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
    fields = []
    for i in range(0, n if low else 0, CHUNK):
        bits = (v[i : i + CHUNK, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        fields.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    high = (v >> np.uint64(low)).astype(np.int64)
    unary = np.zeros(-(-(n + (int(high[-1]) if n else 0) + 1) // COVER) * COVER, np.uint8)
    unary[high + np.arange(n)] = 1
    bits = np.packbits(unary, bitorder="little").tobytes()
    return HEAD.pack(n, low, len(unary)) + b"".join(fields) + bytes(8) + bits


class Sequence:
    """Random access and successor search in the coded form; only the directory of ones (a number for each COVER bits) is made."""

    def __init__(self, data):
        self.n, self.low, width = HEAD.unpack_from(data)
        raw = np.frombuffer(data, np.uint8)
        fields = (self.n * self.low + 7) // 8
        self.fields = np.ndarray((fields + 1,), "<u8", raw, HEAD.size, (1,))
        start = HEAD.size + fields + 8
        bits = raw[start : start + width // 8].reshape(-1, COVER // 8)
        self.halves = np.ndarray((width // 64,), "<u8", raw, start, (8,))
        ones = np.concatenate([np.bitwise_count(bits[i : i + QUERIES]).sum(axis=1, dtype=np.int64) for i in range(0, len(bits), QUERIES)])
        kind = np.int32 if width < 1 << 31 else np.int64
        self.ones = np.concatenate([[0], np.cumsum(ones)]).astype(kind)
        last = int(self.get(np.array([self.n - 1]))[0]) if self.n else 0
        self.top = last >> self.low

    def __len__(self) -> int:
        return self.n

    @cached_property
    def zeros(self) -> np.ndarray:
        """The directory of unset bits."""
        return (np.arange(len(self.ones)) * COVER - self.ones).astype(self.ones.dtype)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th (from 0) set or unset bit of the high part."""
        before = self.ones if one else self.zeros
        out = np.empty(len(k), np.int64)
        for i in range(0, len(k), QUERIES):
            want = k[i : i + QUERIES].astype(before.dtype)
            cover = np.searchsorted(before, want, "right") - 1
            rest = (want - before[cover]).astype(np.uint8)
            half = self.halves[cover * 2] if one else ~self.halves[cover * 2]
            first = np.bitwise_count(half)
            second = first <= rest
            rest -= first * second
            half = np.where(second, self.halves[cover * 2 + 1] if one else ~self.halves[cover * 2 + 1], half)
            row = half.view(np.uint8).reshape(-1, 8)
            upto = np.cumsum(np.bitwise_count(row), axis=1, dtype=np.uint8)
            byte = (upto <= rest[:, None]).sum(axis=1)
            each = np.arange(len(want))
            rest = rest - np.where(byte > 0, upto[each, byte - 1], 0)
            out[i : i + QUERIES] = cover * COVER + second * 64 + byte * 8 + PLACE[row[each, byte], rest]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        i = np.asarray(i, np.int64)
        high = (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        bit = i * self.low
        field = (self.fields[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)
        return high | field

    def search(self, lo: np.ndarray, hi: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value from places lo to hi that is at least the key, hi if none is; whether it equals the key)."""
        lo, hi, hit = np.array(lo, np.int64), np.array(hi, np.int64), np.zeros(len(lo), bool)
        wide = np.flatnonzero(hi - lo > WIDE)
        if len(wide):
            begin, end = self._alike(keys[wide])
            begin, end = (np.clip(x, lo[wide], hi[wide]) for x in (begin, end))
            lo[wide], hi[wide] = begin, end
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            at = (lo[open_] + hi[open_]) >> 1
            value = self.get(at)
            hit[open_[value == keys[open_]]] = True
            less = value < keys[open_]
            lo[open_[less]], hi[open_[~less]] = at[less] + 1, at[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo, hit

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether there) of each key in the whole sequence, searched among the values with its high part."""
        keys = np.asarray(keys, np.uint64)
        if not self.n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        return self.search(*self._alike(keys), keys)

    def _alike(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places from and up to which values share a key's high part; both the length for keys beyond the last."""
        high = np.minimum(keys >> np.uint64(self.low), np.uint64(self.top)).astype(np.int64)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1 - high, 0)
        hi = self._select(high, False) - high
        return np.where(keys >> np.uint64(self.low) > np.uint64(self.top), hi, lo), hi


def decode(data) -> np.ndarray:
    """The sequence that encode() coded."""
    coded = Sequence(data)
    return coded.get(np.arange(len(coded)))


#: Codes of quantised logarithms: 0 stands for an absent entry.
CODES = 255
SECTIONS = ("contexts", "backoffs", "vocabulary", "pointers", "successors", "codes")


def quantise(logs: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(codes from 1, least, step): equal steps between the least and the largest logarithm."""
    if not len(logs):
        return np.zeros(0, np.uint8), 0.0, 0.0
    least, step = float(logs.min()), float(logs.max() - logs.min()) / (CODES - 1)
    return (np.rint((logs - least) / step).astype(np.uint8) if step else np.zeros(len(logs), np.uint8)) + np.uint8(1), least, step


def restored(codes: np.ndarray, least: float, step: float) -> np.ndarray:
    """The logarithms of codes from 1."""
    return least + (codes.astype(np.float64) - 1) * step


def build(context: np.ndarray, word: np.ndarray, log_prob: np.ndarray, context_rows: np.ndarray, log_backoff: np.ndarray) -> bytes:
    """A trie of entries (context, word) in ascending order; context_rows are their distinct contexts, with a backoff each."""
    vocabulary, at = np.unique(word, return_inverse=True)
    rank = np.searchsorted(context_rows, context)
    pointers = np.searchsorted(rank, np.arange(len(context_rows) + 1))
    codes, least, step = quantise(log_prob)
    back, back_least, back_step = quantise(log_backoff)
    # A context's successors are word ranks moved up by the context's rank times the size of the vocabulary: one monotone sequence.
    parts = [encode(context_rows), back.tobytes(), encode(vocabulary), encode(pointers), encode(rank.astype(np.uint64) * np.uint64(len(vocabulary)) + at.astype(np.uint64)), codes.tobytes()]
    head = struct.pack("<4d", least, step, back_least, back_step) + struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return head + b"".join(parts)


class Trie:
    """Queries of a trie in a buffer, such as a memory-mapped file: its levels stay coded."""

    def __init__(self, data):
        view = memoryview(data)
        self.scale = struct.unpack_from("<4d", view)
        sizes = struct.unpack_from(f"<{len(SECTIONS)}Q", view, 32)
        at = 32 + 8 * len(sizes)
        part = {}
        for name, n in zip(SECTIONS, sizes, strict=True):
            part[name] = view[at : at + n]
            at += n
        self.contexts, self.vocabulary, self.pointers, self.successors = (Sequence(part[k]) for k in ("contexts", "vocabulary", "pointers", "successors"))
        self.backoffs, self.codes = np.frombuffer(part["backoffs"], np.uint8), np.frombuffer(part["codes"], np.uint8)

    @property
    def resident(self) -> int:
        """Bytes held beside the buffer."""
        return sum(s.ones.nbytes for s in (self.contexts, self.vocabulary, self.pointers, self.successors)) + sum(s.zeros.nbytes for s in (self.contexts, self.vocabulary, self.successors))

    def lookup(self, context: np.ndarray, word: np.ndarray, runs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the entries, codes of the contexts' backoffs), 0 where absent; with runs, each context has that many of the words.

        A word's rank is searched among the successors of its context alone, from the context's pointer to the next one.
        """
        runs = np.ones(len(context), np.int64) if runs is None else runs
        r, known = self.contexts.find(context)
        back, code = np.zeros(len(context), np.uint8), np.zeros(len(word), np.uint8)
        back[known] = self.backoffs[r[known]]
        lo, hi = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        lo[known], hi[known] = (self.pointers.get(r[known] + i).astype(np.int64) for i in (0, 1))
        named, which = np.unique(word, return_inverse=True)
        w, in_vocabulary = (x[which] for x in self.vocabulary.find(named))
        ask = np.flatnonzero(np.repeat(known, runs) & in_vocabulary)
        of = np.repeat(np.arange(len(r)), runs)[ask]
        key = r[of].astype(np.uint64) * np.uint64(len(self.vocabulary)) + w[ask].astype(np.uint64)
        at, hit = self.successors.search(lo[of], hi[of], key)
        code[ask[hit]] = self.codes[at[hit]]
        return code, back

    def prob(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes > 0, 10.0 ** restored(codes, self.scale[0], self.scale[1]), 0.0)
