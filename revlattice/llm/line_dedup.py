"""Fuzzy line dedup: one occurrence of each group of alike lines stays, over all documents.

A line is normalised to its words of letters and digits: A-Z lower-cased, every digit 0, other ASCII bytes blanks. Every
line that isn't blank takes part; one without such words (a rule, a bracket) counts as its own bytes without blanks at the
ends, and has no fuzzy partner. Equal normalised lines are one line with several occurrences. Lines are alike by
the edit similarity of their normalised forms alone. Candidates share a key and have near SimHashes:

* below SEGMENTED characters keys are hashes of segments, which miss no pair;
* below LONG characters, or with few words, BANDS keys of a MinHash over windows of GRAM bytes, ROWS minima each;
* else WORD_BANDS keys of a MinHash over runs of WORD_RUN words, WORD_ROWS minima each.

Pigeonhole blocks of a SimHash alone lose most alike lines (one changed word moves more bits than its blocks forgive), so the
SimHash, over words, only thins out the pairs of a key. Keys travel in five bytes, with two more that tell the lines of a key
apart; only lines that share one with another line are then listed. Connected groups of lines keep their first occurrence in
the order of identifier, row and line. Of two lines whose runs have Jaccard similarity j, a share of (1 - j^ROWS)^BANDS shares
no key: under 1 % for one changed word of ten, more for edits in every word.

Only fingerprints travel for all lines. The texts that verification needs are those of lines with a partner, and only
documents that lose a line meet the list of lines to drop; a Bloom filter of fixed size picks both while documents are read.

Defined results: a null text stays null; rows of equal identifier and text are one row (they keep the same lines); a null
identifier comes before all others; a document may end up with an empty text; an empty table gives an empty result. Other
columns pass through.
"""

from __future__ import annotations

from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linkage import block_pairs, labelled, linked, mixed_keys
from .membership import Membership, members
from .runtime import bounded_batches, bucket_count, materialize
from .text import C1, SPACE, flat, from40, low40, mix, slices, span_hashes, words

SIMILARITY_PERCENT = 90
#: Below so many characters lines have the keys of segments, below LONG those of windows, else those of runs of words.
SEGMENTED, LONG = 30, 100
#: MinHash over the normalised line's windows of GRAM bytes: BANDS keys of ROWS minima each.
GRAM, BANDS, ROWS = 6, 16, 3
#: MinHash over runs of WORD_RUN words. Lines of fewer than FEW_WORDS words have keys of windows, of MANY_WORDS or more none.
WORD_RUN, WORD_BANDS, WORD_ROWS = 3, 14, 2
FEW_WORDS, MANY_WORDS = 6, 12
FACTORS = (mix(np.arange(1, max(BANDS * ROWS, WORD_BANDS * WORD_ROWS) + 1, dtype=np.uint64) * C1) | np.uint64(1)).astype(np.uint32)
#: Windows hashed at once.
CACHED = 1 << 15
#: Lines whose SimHashes differ in more of their 48 bits aren't compared (where the longer one is short, and where it isn't); those of unlike lines differ in about 20 to 24.
SKETCH_BITS = 19, 13
#: Lines of fewer characters have too few words for a SimHash to tell.
SKETCHED = 60
LENGTH = np.uint64(0xFFFF)
#: In larger key groups members are not compared beforehand.
COMPARED = 512
#: Lines of one packed block.
BLOCK_LINES = 65_000
#: Bytes of text whose keys are made, or that are compared, at once.
TEXT_BYTES = 4 << 20
#: Distances up to which a column's band fits the bits of an integer, pairs whose columns are made at once, and most symbols of theirs.
NARROW, NARROW_PAIRS, SYMBOLS = 60, 512, 128
#: Before wide bands are filled, runs of so many characters are counted, by so many bits of a hash; of pairs with so many characters at once.
COUNTED, COUNTED_CHARS = ((1, 6), (4, 9)), 1 << 19
#: The bits of a byte in the bytes of an integer.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()
NORMAL = np.full(256, 0x20, np.uint8)
NORMAL[97:123] = np.arange(97, 123)
NORMAL[65:91] = np.arange(97, 123)
NORMAL[48:58] = 48
NORMAL[128:] = np.arange(128, 256)


def _banded(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, bands: int, rows: int, salt: int) -> list[np.ndarray]:
    """For each band the key of each run of `size` hashes (at least one) from `begin` on: a hash of `rows` minima."""
    before = np.cumsum(size) - size
    least = np.empty((bands * rows, len(size)), np.uint32)
    cuts = np.flatnonzero(np.append(True, np.diff(before // CACHED) > 0))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(size)), strict=True):
        first = before[lo:hi] - before[lo]
        h = hashes[np.repeat(begin[lo:hi] - first, size[lo:hi]) + np.arange(size[lo:hi].sum())]
        for j in range(bands * rows):
            np.minimum.reduceat(h * FACTORS[j], first, out=least[j, lo:hi])
    keys = []
    for band in range(bands):
        key = np.full(len(size), band + salt, np.uint64)
        for j in range(band * rows, band * rows + rows):
            key = mix(key * C1 + least[j])
        keys.append(key)
    return keys


class Lines:
    """The lines of the rows of a text column."""

    def __init__(self, column: pa.Array):
        self.data, at = flat(column)
        breaks = np.flatnonzero(self.data == 10) + 1
        owner = np.searchsorted(at, breaks - 1, "right") - 1
        start = np.concatenate([at[:-1], breaks])
        row = np.concatenate([np.arange(len(at) - 1), owner])
        order = np.lexsort((start, row))
        self.start, self.row = start[order], row[order]
        self.first = np.searchsorted(self.row, np.arange(len(at)))
        self.number = np.arange(len(self.row)) - self.first[self.row]
        last = np.append(self.row[1:] != self.row[:-1], True)
        self.end = np.where(last, at[self.row + 1], np.append(self.start[1:], len(self.data)) - 1)
        self.normal = NORMAL[self.data]
        self.word_start, self.word_end, _ = words(self.normal, at)
        self.word_first = np.searchsorted(self.word_start, self.start)
        self.word_stop = np.searchsorted(self.word_start, self.end)
        some = self.word_stop > self.word_first
        for i in np.flatnonzero(~some & (self.end > self.start)).tolist():  # without words a line counts by what else isn't blank
            some[i] = not SPACE[self.data[self.start[i] : self.end[i]]].all()
        self.counts = np.flatnonzero(some)
        self.worded = (self.word_stop > self.word_first)[self.counts]

    def _raw(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes().strip()

    def _filled(self, of_words: np.ndarray) -> np.ndarray:
        """For the lines that count: what those with words have, or a hash of the line's own bytes."""
        out = np.empty(len(self.counts), np.int64)
        out[self.worded] = of_words
        out[~self.worded] = np.array([xxhash.xxh64_intdigest(self._raw(i), 1) for i in self.counts[~self.worded]], np.uint64).view(np.int64)
        return out

    def _words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines with words: their words' hashes, where each line's begin, how many they are."""
        h = span_hashes(self.normal, self.word_start, self.word_end)
        line = self.counts[self.worded]
        size = (self.word_stop - self.word_first)[line]
        begin = np.cumsum(size) - size
        return h[np.repeat(self.word_first[line] - begin, size) + np.arange(size.sum())], begin, size

    def ids(self) -> np.ndarray:
        """For the lines that count: the hash of the words in order, without words of the line's own bytes."""
        return self._filled(self._ids(*self._words()))

    @staticmethod
    def _ids(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(size):
            return np.zeros(0, np.int64)
        place = (np.arange(len(h)) - np.repeat(begin, size)).astype(np.uint64)
        return mix(np.add.reduceat(mix(h + place * C1), begin) + size.astype(np.uint64)).view(np.int64)

    @staticmethod
    def _prints(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The SimHashes of lines of words."""
        # Votes for eight bits in the bytes of one integer; a run of at most 255 words can't overflow one.
        runs = -(-size // 255)
        first_run = np.cumsum(runs) - runs
        start = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
        data = h.view(np.uint8).reshape(-1, 8)
        votes = np.stack([np.add.reduceat(SPREAD[data[:, i]], start) for i in range(8)], 1).view(np.uint8)
        votes = np.add.reduceat(votes, first_run, axis=0, dtype=np.int64)
        return np.packbits(2 * votes > size[:, None], axis=1).view("<u8").ravel()

    def _packed(self, keep: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(data, begin, end): the bytes to keep of some spans of the normalised text."""
        size = end - begin
        before = np.cumsum(size) - size
        at = np.repeat(begin - before, size) + np.arange(size.sum())
        mine = keep[at]
        place = np.append(0, np.cumsum(mine))
        return self.normal[at[mine]], place[before], place[before + size]

    def keys(self, percent: int = SIMILARITY_PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sketches, lines, keys): of different lines that can have a fuzzy partner, and for each key the place of its line."""
        none = np.zeros(0, np.int64)
        if not self.worded.any():
            return none, none.view(np.uint64), none, none.view(np.uint64)
        h, word, count = self._words()
        ids, pick = np.unique(self._ids(h, word, count), return_index=True)
        sketch = self._prints(h, word, count)[pick] << np.uint64(16)
        line, word, count = self.counts[self.worded][pick], word[pick], count[pick]
        keep = SPACE[self.normal]
        np.logical_not(keep, out=keep)
        keep[1:] |= keep[:-1]  # one blank after a word
        chars = np.cumsum(keep & ((self.normal & 0xC0) != 0x80), dtype=np.int32)
        begin, end = self.word_start[self.word_first[line]], self.word_end[self.word_stop[line] - 1]
        length = (chars[end - 1] - chars[begin] + 1).astype(np.int64)
        use = length >= 100 // max(1, 100 - percent)  # shorter ones are like none but themselves
        ids, sketch, word, count, begin, end, length = (x[use] for x in (ids, sketch, word, count, begin, end, length))
        sketch |= np.minimum(length, int(LENGTH)).astype(np.uint64)
        # Classes overlap, so that lines within the edit similarity have one in common.
        place, keys = [], []
        windows = np.flatnonzero((length >= SEGMENTED * percent // 100) & ((length <= LONG * 100 // percent) | (count < MANY_WORDS)))
        if len(windows):
            data, first, last = self._packed(keep, begin[windows], end[windows])
            eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
            hashes = (mix(eight & np.uint64((1 << 8 * GRAM) - 1)) >> np.uint64(32)).astype(np.uint32)
            keys += (found := _banded(hashes, first, last - first - GRAM + 1, BANDS, ROWS, 0))
            place += [windows] * len(found)
        runs = np.flatnonzero((length >= LONG) & (count >= FEW_WORDS))
        if len(runs):
            rolled = np.zeros(len(h) - WORD_RUN + 1, np.uint64)
            for j in range(WORD_RUN):
                rolled = rolled * C1 + h[j : j + len(rolled)]
            hashes = (mix(rolled) >> np.uint64(32)).astype(np.uint32)
            keys += (found := _banded(hashes, word[runs], count[runs] - WORD_RUN + 1, WORD_BANDS, WORD_ROWS, BANDS))
            place += [runs] * len(found)
        near = np.flatnonzero(length < SEGMENTED)
        data, first, last = self._packed(keep, begin[near], end[near])
        for i, k in zip(near.tolist(), [segment_keys(data[a:b].tobytes().decode(), percent) for a, b in zip(first, last, strict=True)], strict=True):
            place.append(np.full(len(k), i))
            keys.append(np.array(k, np.uint64))
        return ids, sketch, np.concatenate(place or [none]), np.concatenate(keys or [none.view(np.uint64)])

    def text(self, i: int) -> str:
        return (b" ".join(self.normal[self.start[i] : self.end[i]].tobytes().split()) or self._raw(i)).decode()


def segment_keys(text: str, percent: int) -> list[int]:
    """Keys of which two short texts within the edit similarity share one.

    Of t + 1 segments of the shorter text, t edits leave one whole, in the longer one at most t places away. t goes by the longer.
    """
    out, n = set(), len(text)
    for t in range(1, SEGMENTED * (100 - percent) // 100 + 1):
        least = -(-100 * t // (100 - percent))
        longest = min(SEGMENTED - 1, (100 * (t + 1) - 1) // (100 - percent))
        if n > longest or n + t < least:
            continue
        for m in range(n - t if n >= least else n, n + 1):
            cuts = [m * i // (t + 1) for i in range(t + 2)]
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                move = t if n >= least else 0
                for p in range(max(0, lo - move), min(n - (hi - lo), lo + move) + 1):
                    out.add(xxhash.xxh64_intdigest(f"{t} {m} {i} {text[p : p + hi - lo]}"))
    return sorted(out)


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance: bit-parallel columns in whole integers, after common ends are taken off.

    With `most`, any number above it stands for a distance above it, and any up to it for one up to it.
    """
    lo, hi = _ends(a, b)
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    if most is not None:
        if max(len(a), len(b)) <= most:
            return max(len(a), len(b))
        if len(a) == len(b) and (changed := sum(map(ne, a, b))) <= most:
            return changed
        return _banded_distance(*((a, b) if len(a) >= len(b) else (b, a)), most)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1) | 1, fall << 1
        up, down = (fall | ~((eq | down) | rise)) & full, rise & (eq | down) & full
    return distance


def _banded_distance(a: str, b: str, most: int) -> int:
    """The edit distance of a and the shorter b if it is at most `most`, else a number above that: of each column the rows that such a path can meet, as bits of one integer."""
    if len(a) - len(b) > most:
        return most + 1
    high = (most + len(a) - len(b)) // 2  # the topmost bit is the row this far below the column's number
    width = most + 2
    last, where = width - 1, {}
    one = 1 << last - high
    points = np.frombuffer(a.encode("utf-32-le"), "<u4")
    for c in set(a):
        where[c] = int.from_bytes(np.packbits(points == ord(c), bitorder="little").tobytes(), "little") << last - high
    full, top, get = (1 << width) - 1, 1 << last, where.get
    up, down, score, bend = full ^ (one - 1), 0, high, len(a) - high
    spare = most + len(b) - bend
    for i, c in enumerate(b[:bend]):
        same = get(c, 0) >> i & full
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        rise, fall = down | ((diagonal | up) ^ full), diagonal & up
        if not diagonal & top:
            score += 1
            if score > spare:  # each column after the bend takes one off at most
                return most + 1
        diagonal >>= 1
        up, down = fall | ((diagonal | rise) ^ full), rise & diagonal
    for i in range(bend, len(b)):
        same = get(b[i], 0) >> i & full
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        rise, fall = down | ((diagonal | up) ^ full), diagonal & up
        bit = last - 1 - (i - bend)
        score += (rise >> bit & 1) - (fall >> bit & 1)
        if score > most + len(b) - i - 1:
            return most + 1
        diagonal >>= 1
        up, down = fall | ((diagonal | rise) ^ full), rise & diagonal
    return score


def similar(a: str, b: str, percent: int = SIMILARITY_PERCENT) -> bool:
    """Whether the edit distance is small enough against the longer text."""
    return bool(all_similar([a], [b], percent)[0])


def _matrix(texts: list[str], width: int, kind: str) -> np.ndarray:
    """Texts as rows of code points or bytes."""
    code = "ascii" if kind == "u1" else "utf-32-le"
    flat = np.frombuffer("".join(texts).encode(code), kind)
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), width), kind)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _within(pairs: list[tuple[str, str]], room: np.ndarray) -> np.ndarray:
    """Of pairs of texts, the longer first, whether each one's edit distance is at most its room: anti-diagonals of all pairs at once, in a band of the largest room."""
    la, lb = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    kind = "u1" if all(x.isascii() and y.isascii() for x, y in pairs) else "<u4"
    a = np.ascontiguousarray(_matrix([p[0] for p in pairs], int(la.max()), kind).T)
    b = np.ascontiguousarray(_matrix([p[1] for p in pairs], int(lb.max()), kind)[:, ::-1].T)
    n, m = len(a), len(b)
    # A path within the room strays from the diagonals between both ends by half of what the lengths' difference leaves.
    stray = (room - (la - lb)) // 2
    low, high = -int(stray.max()), int((stray + la - lb).max())
    far, alive, out = np.int16(32000), np.arange(len(pairs)), np.zeros(len(pairs), bool)
    # Cell i of an anti-diagonal d is the distance of a[:i] and b[:d - i], and row i + 1 of the arrays; a pair is a column.
    two = np.full((n + 2, len(pairs)), far)
    one = two.copy()
    two[1] = 0
    one[1:3] = 1
    for d in range(1, n + m + 1):
        lo, hi = max(0, d - m, (d + low + 1) // 2), min(n, d, (d + high) // 2)
        if d > 1:
            step = two[lo : hi + 1].copy()  # from a[:i - 1], b[:d - i - 1]
            first, last = max(lo, 1), min(hi, d - 1)  # where both texts have a last character
            if last >= first:
                at = m - (d - first)
                step[first - lo : last - lo + 1] += (a[first - 1 : last] != b[at : at + last - first + 1]).astype(np.int16)
            near = np.minimum(one[lo : hi + 1], one[lo + 1 : hi + 2])
            near += 1
            np.minimum(step, near, out=two[lo + 1 : hi + 2])
            if lo == 0:
                two[1] = d
            if hi == d:
                two[d + 1] = d
            two[lo] = far
            if hi + 2 < n + 2:
                two[hi + 2] = far
            two, one = one, two
        ends = la[alive] + lb[alive] == d
        if ends.any():
            out[alive[ends]] = one[la[alive[ends]] + 1, np.flatnonzero(ends)] <= room[alive[ends]]
        if d % 32 == 0 or ends.any() and d >= n + m - 32:
            least = np.minimum(one[lo + 1 : hi + 2].min(0), two[lo : hi + 2].min(0))
            stays = (la[alive] + lb[alive] > d) & (least <= room[alive])
            if not stays.any():
                break
            if stays.sum() < 0.8 * len(stays):
                alive, a, b, one, two = alive[stays], a[:, stays], b[:, stays], one[:, stays], two[:, stays]
    return out


def _narrow(pairs: list[tuple[str, str]], room: np.ndarray) -> np.ndarray:
    """As _within, for rooms of at most NARROW: a band of 64 rows of a column is the bits of one integer, of all pairs at once."""
    la, lb = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    points = np.frombuffer("".join(p[i] for i in (0, 1) for p in pairs).encode("utf-32-le"), "<u4").astype(np.int64)
    number = np.zeros(int(points.max()) + 1, np.int64)
    number[points] = 1
    symbols = np.flatnonzero(number)
    if len(symbols) > SYMBOLS:
        return _within(pairs, room)
    number[symbols] = np.arange(len(symbols))
    codes = number[points]
    high = (room + la - lb) // 2  # the band's topmost bit is the row this far below the column's number
    # For each symbol the places of the longer texts that hold it, a bit each, so far on that a column's band begins at the column's number.
    row = np.repeat(np.arange(len(pairs)), la)
    place = np.arange(la.sum()) - (np.cumsum(la) - la)[row] + 63 - high[row]
    held = np.zeros((max(int(place.max()), int(lb.max()) + 64) // 64 + 2, len(symbols), len(pairs)), np.uint64)
    np.bitwise_or.at(held.reshape(-1), ((place >> 6) * len(symbols) + codes[: len(row)]) * len(pairs) + row, np.uint64(1) << (place & 63).astype(np.uint64))
    b = np.zeros((int(lb.max()), len(pairs)), np.int64)
    row = np.repeat(np.arange(len(pairs)), lb)
    b[np.arange(lb.sum()) - (np.cumsum(lb) - lb)[row], row] = codes[la.sum() :]
    one, last = np.uint64(1), np.uint64(63)
    up, down = ~np.uint64(0) << (last - high.astype(np.uint64)), np.zeros(len(pairs), np.uint64)
    score, alive, out, bend = high.copy(), np.arange(len(pairs)), np.zeros(len(pairs), bool), la - high
    bends, spare = int(bend.min()), lb - bend  # columns after the bend, each of which takes one off at most
    for i in range(int(lb.max())):
        at = b[i], np.arange(len(lb))
        same = held[i >> 6][at] >> np.uint64(i & 63)
        if i & 63:
            same |= held[(i >> 6) + 1][at] << np.uint64(64 - (i & 63))
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(diagonal | up), diagonal & up
        step = (~diagonal >> last).astype(np.int64)
        if i >= bends:
            bit = np.clip(62 - (i - bend), 0, 62).astype(np.uint64)
            step = np.where(i < bend, step, ((rise >> bit) & one).astype(np.int64) - ((fall >> bit) & one).astype(np.int64))
        score += step
        diagonal >>= one
        up, down = fall | ~(diagonal | rise), diagonal & rise
        ends = lb == i + 1
        done = ends.any()
        if done:
            out[alive[ends]] = score[ends] <= room[ends]
        if done or i % 16 == 15:
            stays = (lb > i + 1) & (score - np.where(i < bend, spare, lb - i - 1) <= room)
            kept = int(stays.sum())
            if not kept:
                break
            if kept < 0.8 * len(stays):
                held, b, up, down, score, alive, bend, spare, room, lb = held[:, :, stays], b[:, stays], up[stays], down[stays], score[stays], alive[stays], bend[stays], spare[stays], room[stays], lb[stays]
                bends = int(bend.min())
    return out


def _ends(a: str, b: str) -> tuple[int, int]:
    """The characters that two texts have in common at their beginning, and at their end beside those."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        half = (lo + hi + 1) // 2
        if a[lo:half] == b[lo:half]:
            lo = half
        else:
            hi = half - 1
    begin, lo, hi = lo, 0, min(len(a), len(b)) - lo
    while lo < hi:
        half = (lo + hi + 1) // 2
        if a[len(a) - half : len(a) - lo] == b[len(b) - half : len(b) - lo]:
            lo = half
        else:
            hi = half - 1
    return begin, lo


def _told_apart(pairs: list[tuple[str, str]], room: np.ndarray) -> np.ndarray:
    """Which pairs' counts of runs of characters differ by more than their rooms explain: an edit takes away, and adds, at most as many runs as one has characters."""
    size = np.array([len(x) for p in pairs for x in p])
    points = np.frombuffer("".join(x for p in pairs for x in p).encode("utf-32-le"), "<u4")
    text, left = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size) - np.arange(len(points))
    out, run, width = np.zeros(len(pairs), bool), np.zeros(len(points), np.uint32), 0
    for q, bits in COUNTED:
        while width < q:
            run = run[: max(0, len(points) - width)] * np.uint32(0x01000193) + points[width:]
            width += 1
        whole = left[: len(run)] >= q
        bins = (run * np.uint32(0x9E3779B1) >> np.uint32(32 - bits))[whole].astype(np.int64) + (text[: len(run)][whole] << bits)
        counts = np.bincount(bins, minlength=len(size) << bits).reshape(len(pairs), 2, 1 << bits)
        more = counts[:, 0] - counts[:, 1]
        up = np.maximum(more, 0).sum(1)
        out |= np.maximum(up, up - more.sum(1)) > q * room
    return out


def all_similar(left: list[str], right: list[str], percent: int = SIMILARITY_PERCENT) -> np.ndarray:
    """similar() of each pair of texts: those that one changed place or changed letters explain at once, most others many at a time."""
    out, open_, rooms, at = np.zeros(len(left), bool), [], [], []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        room = (100 - percent) * max(len(a), len(b)) // 100
        if abs(len(a) - len(b)) > room:
            continue
        if len(a) < len(b):
            a, b = b, a
        lo, hi = _ends(a, b)
        a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
        if len(a) <= room or len(a) == len(b) and sum(map(ne, a, b)) <= room:
            out[i] = True
        elif b:  # what is left of the longer text alone is over the room
            open_.append((a, b))
            rooms.append(room)
            at.append(i)
    narrow = sorted((i for i, room in enumerate(rooms) if room <= NARROW), key=lambda i: len(open_[i][1]))
    for start in range(0, len(narrow), NARROW_PAIRS):
        some = narrow[start : start + NARROW_PAIRS]
        out[[at[i] for i in some]] = _narrow([open_[i] for i in some], np.array([rooms[i] for i in some]))
    wide = np.array([i for i, room in enumerate(rooms) if room > NARROW], np.int64)
    before = np.cumsum([len(open_[i][0]) for i in wide]) // COUNTED_CHARS
    for some in np.split(wide, np.flatnonzero(np.diff(before)) + 1) if len(wide) else ():
        apart = _told_apart([open_[i] for i in some], np.array([rooms[i] for i in some]))
        for i in some[~apart].tolist():
            out[at[i]] = _banded_distance(*open_[i], rooms[i]) <= rooms[i]
    return out


def _line_rows(rows: DataFrame) -> DataFrame:
    """(doc, rid, line, id) of every line that counts."""

    def work(batches):
        for batch in slices(batches):
            lines = Lines(batch.column("text"))
            row = pa.array(lines.row[lines.counts])
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(row), batch.column("rid").take(row), pa.array(lines.number[lines.counts].astype(np.int32)), pa.array(lines.ids())], names=["doc", "rid", "line", "id"])

    return rows.mapInArrow(work, "doc long, rid long, line int, id long")


def _sketch_near(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sketches leave room for edit similarity; 16 low bits are the length."""
    la, lb = (v & LENGTH for v in (x, y))
    most = np.maximum(la, lb).astype(np.int64)
    close = 100 * (most - np.minimum(la, lb).astype(np.int64)) <= (100 - percent) * most
    differ = np.bitwise_count((x ^ y) >> np.uint64(16))
    return close & ((differ <= np.where(most * percent <= LONG * 100, *SKETCH_BITS)) | (most < SKETCHED))


def _shared_keys(rows: DataFrame, percent: int) -> DataFrame:
    """(key, id, sim) of the lines of which another line has the key.

    Blocks of lines send their keys by hash range; each range says to each block which are shared; the blocks' identifiers and
    sketches, sent along once a line, then give the rows.
    """
    buckets = bucket_count(rows.sparkSession)

    def pack(batches):
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        for batch in slices(batches, TEXT_BYTES):
            ids, sketch, line, key = Lines(batch.column("text")).keys(percent)
            for low in range(0, len(ids), BLOCK_LINES):
                block, serial = part << 32 | serial, serial + 1
                mine = (line >= low) & (line < low + BLOCK_LINES)
                k, owner = key[mine], line[mine] - low
                order = np.argsort(k)
                k, owner = k[order], owner[order]
                tag = (mix(k ^ ids.view(np.uint64)[owner + low]) >> np.uint64(48)).astype(np.uint16)
                cuts = np.searchsorted((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                names = ids[low : low + BLOCK_LINES].tobytes() + sketch[low : low + BLOCK_LINES].tobytes()
                home = block % buckets
                out = [(b, block, low40(k[lo:hi]), tag[lo:hi].tobytes(), owner[lo:hi].astype(np.uint16).tobytes(), names if b == home else None) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo or b == home]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "block", "hashes", "tags", "owners", "names"])

    def share(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        size = [len(o) // 2 for o in got["owners"]]
        h, tag, owner = from40(b"".join(got["hashes"])), np.frombuffer(b"".join(got["tags"]), np.uint16), np.frombuffer(b"".join(got["owners"]), np.uint16)
        both = h << np.uint64(16) | tag
        order = np.argsort(both)
        both = both[order]
        start = np.flatnonzero(np.append(True, both[1:] >> np.uint64(16) != both[:-1] >> np.uint64(16))[: len(both)])
        stop = np.append(start[1:], len(both))
        shared = np.zeros(len(both), bool)
        shared[order] = np.repeat(both[start] != both[stop - 1], stop - start) if len(both) else False
        out, at = [], 0
        for n, bucket, block, names in zip(size, got["bucket"], got["block"], got["names"], strict=True):
            mine = shared[at : at + n]
            if mine.any() or names is not None:
                out.append((block, bucket, low40(h[at : at + n][mine]), owner[at : at + n][mine].tobytes(), names))
            at += n
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["block", "bucket", "hashes", "owners", "names"])

    def name(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        names = np.frombuffer(next(x for x in got["names"] if x is not None), np.int64).reshape(2, -1)
        own = np.frombuffer(b"".join(got["owners"]), np.uint16).astype(np.int64)
        high = np.repeat(np.array(got["bucket"], np.uint64) << np.uint64(40), [len(o) // 2 for o in got["owners"]])
        return pa.table({"key": (from40(b"".join(got["hashes"])) | high).view(np.int64), "id": names[0][own], "sim": names[1][own]})

    packed = rows.select("text").mapInArrow(pack, "bucket int, block long, hashes binary, tags binary, owners binary, names binary")
    shared = packed.groupBy("bucket").applyInArrow(share, "block long, bucket int, hashes binary, owners binary, names binary")
    return shared.groupBy("block").applyInArrow(name, "key long, id long, sim long")


def _near_keys(rows: DataFrame, percent: int) -> DataFrame:
    """(key, id, sim): the keys of lines that share one with another line of a near sketch (in large key groups: with any)."""
    buckets = bucket_count(rows.sparkSession)

    def near(table: pa.Table) -> pa.Table:
        item = np.stack([np.asarray(table.column(c)).view(np.uint64) for c in ("key", "id", "sim")], 1)
        item = item[np.lexsort((item[:, 1], item[:, 0]))]
        item = item[np.append(True, (item[1:, :2] != item[:-1, :2]).any(1))[: len(item)]]
        key, _, sketch = (np.ascontiguousarray(c) for c in item.T)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        size = np.diff(np.append(start, len(key)))
        size = np.repeat(size, size)
        keep = size > COMPARED
        left = np.flatnonzero((size > 1) & ~keep)
        shift = 1
        while len(left):
            left = left[left + shift < len(key)]
            left = left[key[left + shift] == key[left]]
            hit = left[_sketch_near(sketch[left], sketch[left + shift], percent)]
            keep[hit] = keep[hit + shift] = True
            shift += 1
        out = item[keep].view(np.int64)
        return pa.table({"key": out[:, 0], "id": out[:, 1], "sim": out[:, 2]})

    return _shared_keys(rows, percent).groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInArrow(near, "key long, id long, sim long")


def _texts(rows: DataFrame, members: Membership) -> DataFrame:
    """(id, text): the normalised text of lines that may be members, once each."""
    sent = rows.sparkSession.sparkContext.broadcast(members)

    def work(batches):
        for batch in slices(batches):
            lines = Lines(batch.column("text"))
            ids, pick = np.unique(lines.ids(), return_index=True)
            use = sent.value.may_hold(ids) if len(ids) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array([lines.text(i) for i in lines.counts[pick[use]]], pa.string())], names=["id", "text"])

    return rows.mapInArrow(work, "id long, text string").dropDuplicates(["id"])


def _room(percent: int) -> Column:
    """_sketch_near of the columns sa and sb."""
    la, lb = (F.col(c).bitwiseAND(int(LENGTH)) for c in ("sa", "sb"))
    most = F.greatest(la, lb)
    differ = F.bit_count(F.shiftrightunsigned(F.col("sa").bitwiseXOR(F.col("sb")), 16))
    few = differ <= F.when(most * percent <= LONG * 100, SKETCH_BITS[0]).otherwise(SKETCH_BITS[1])
    return (100 * (most - F.least(la, lb)) <= (100 - percent) * most) & (few | (most < SKETCHED))


def _stars(keys: DataFrame, percent: int) -> DataFrame:
    """(a, b): the least item of each key and every other item of that key whose sketch is near, each pair once."""
    least = keys.groupBy("key").agg(F.min(F.struct("id", "sim")).alias("least"), F.max("id").alias("most")).where("least.id < most")
    least = least.select("key", F.col("least.id").alias("a"), F.col("least.sim").alias("sa"))
    pairs = keys.select("key", F.col("id").alias("b"), F.col("sim").alias("sb")).join(least, "key")
    return pairs.where(F.col("a") != F.col("b")).where(_room(percent)).select("a", "b").distinct()


def _alike(payload: DataFrame, percent: int):
    """verify for linkage."""

    def check(batches):
        for batch in slices(batches, TEXT_BYTES, "ta"):
            ok = pa.array(all_similar(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (payload.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")

    return verify


def lines_to_drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(rid, lines): for each row that loses any, by the hash of its identifier and text, the numbers of those lines."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    every = materialize(_line_rows(rows), "lines")
    place = F.struct("doc", "rid", "line")
    keys = materialize(_near_keys(rows, percent), "line-keys")
    of_line = keys.groupBy("id").agg(F.collect_list("key").alias("keys"))
    payload = materialize(_texts(rows, Membership.of(keys, "id")).join(of_line, "id"), "line-texts")
    near = lambda a, b: _sketch_near(a[:, 0].view(np.uint64), b[:, 0].view(np.uint64), percent)
    mixed = lambda roots: mixed_keys(labelled(keys, roots))
    alike = lambda a, b: all_similar(a, b, percent)
    last = lambda items, _: block_pairs(items.join(payload, "id"), ["sim"], near, alike, "text", "keys")
    roots = linked(_stars(keys, percent), None, mixed, _alike(payload, percent), last)
    distinct = every.groupBy("id").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))  # lies by id as the join wants it
    named = distinct.join(roots.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").where("n > 1 or root is not null")
    named = materialize(named.withColumn("root", F.coalesce("root", "id")), "repeated-lines")
    stays = named.groupBy("root").agg(F.min("place").alias("stays"))
    repeated = named.select("id", "root").join(stays, "root").select("id", "stays")
    lost = every.join(repeated.hint("merge"), "id").where(~place.eqNullSafe(F.col("stays"))).select("rid", "line").distinct()
    return materialize(lost.groupBy("rid").agg(F.sort_array(F.collect_list("line")).alias("lines")), "lost-lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """docs with the text of each row without its repeated lines, and the column n_dropped (in place of one of that name)."""
    lost = lines_to_drop(docs, id_col, text_col, percent)
    sent = docs.sparkSession.sparkContext.broadcast(Membership.of(lost, "rid"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(id_col, text_col).alias("key"))
    flagged = keyed.withColumn("may", F.arrow_udf(lambda key: members(sent, key), "boolean")("key"))
    whole = flagged.where("not may").select("row", F.col(f"row.`{text_col}`").alias("text"), F.lit(0).cast("long").alias("n_dropped"))
    split = flagged.where("may").join(lost.hint("merge"), F.col("key") == F.col("rid"), "left").select("row", F.col(f"row.`{text_col}`").alias("text"), "lines")

    def cut(batches):
        for batch in batches:
            texts, gone = batch.column("text").to_pylist(), batch.column("lines").to_pylist()
            kept = [t if not g else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in d) for t, g in zip(texts, gone, strict=True) for d in [set(g or ())]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, batch.column("text").type), pa.array([len(g or ()) for g in gone], pa.int64())], names=["row", "text", "n_dropped"])

    both = whole.unionByName(split.mapInArrow(cut, whole.schema))
    return both.select(*(F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns if c != "n_dropped"), "n_dropped")
