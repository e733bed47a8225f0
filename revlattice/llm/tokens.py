"""Encoding whole texts with a public tokenizer, each distinct piece of a block once.

Texts are cut where byte-level and word-level pre-tokenizers start a new token whatever stands before: before a space that
a byte of ordinary text follows, between an ASCII letter and a stop, and around a single line feed between such bytes. The
ids of the pieces, one after another, are the ids of the text. Pieces repeat often: a worker keeps the ids of those it has
met, up to a fixed number. Pieces are known by hashes of 64 bits. A text that holds the string of an added token, which the
tokenizer makes one id wherever it stands, is one piece.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from .text import LOWER, flat, span_hashes

#: Pieces whose ids a worker keeps; beyond that it starts anew.
KEPT_PIECES = 1_000_000
#: Pieces encoded by one call.
TOGETHER = 8192
#: Bytes that may follow a space at a cut: printable ASCII and lead bytes of scripts; not those of blanks or marks beyond ASCII.
FOLLOWS = np.zeros(256, bool)
FOLLOWS[0x21:0x7F] = FOLLOWS[0xC3:0xCC] = FOLLOWS[0xCE:0xE0] = FOLLOWS[0xE4:0xF0] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
STOP = np.zeros(256, bool)
STOP[list(b".,;:!?|")] = True
INK = np.zeros(256, bool)
INK[0x21:0x7F] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoder(path: str) -> Encoder:
    """A worker's own, kept from task to task."""
    return Encoder(path)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a piece begins, apart from the rows' starts."""
    out = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        out[:-2] = (data[:-1] == 0x20) & FOLLOWS[data[1:]]
        out[1:-1] |= LETTER[data[:-1]] & STOP[data[1:]]
    if len(data) > 2:
        line = INK[data[:-2]] & (data[1:-1] == 10) & INK[data[2:]]
        out[1:-2] |= line
        out[2:-1] |= line
    return out


class Encoder:
    """encode(column) gives the ids of all rows, one after another, and where each row starts."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        """keys is sorted; the piece of keys[i] has pool[begin[i]:begin[i] + size[i]]."""
        self.keys, self.begin, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @property
    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _with_added(self, data: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """The spans of rows that may hold an added token's string; such a string is one id wherever it stands, so these rows aren't cut."""
        raw, found = None, set()
        for token in self.added:
            raw = LOWER[data].tobytes() if raw is None else raw
            place = raw.find(token)
            while place >= 0:
                row = int(np.searchsorted(at, place, "right")) - 1
                found.add((int(at[row]), int(at[row + 1])))
                place = raw.find(token, max(place + 1, int(at[row + 1]) - len(token) + 1))
        return found

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """keys, none of them known, ascend."""
        pools, sizes = [self.pool], []
        for i in range(0, len(pieces), TOGETHER):
            part = pieces[i : i + TOGETHER]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)  # each as if it were a text
            pools.append(np.array(got.ids, np.uint32))
            sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
        size = np.concatenate(sizes)
        begin = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate(pools)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = (np.insert(kept, place, new) for kept, new in ((self.keys, keys), (self.begin, begin), (self.size, size)))

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): row i has ids[first[i]:first[i + 1]], with the id `end` last where given."""
        data, at = flat(column)
        cut = cuts(data)
        for lo, hi in self._with_added(data, at):
            cut[lo:hi] = False
        cut[at] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        keys, pick, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_PIECES:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        new = self.keys[np.minimum(place, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(starts[pick[new]].tolist(), ends[pick[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
        size, begin = self.size[place][back], self.begin[place][back]
        row = np.searchsorted(starts, at)  # the first piece of each row
        total = np.concatenate([[0], np.cumsum(size)])
        first = total[row]
        ids = self.pool[np.repeat(begin - total[:-1], size) + np.arange(total[-1])] if len(size) else self.pool[:0]
        if end is None:
            return ids, first
        ids = np.insert(ids, first[1:], np.uint32(end))
        return ids, first + np.arange(len(first))
