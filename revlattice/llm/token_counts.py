"""Token counts of a unigram tokenizer without making tokens: Aho-Corasick and a Viterbi pass that carries score and count.

The vocabulary is the ordinary pieces of a public sentencepiece file with the scores of that file, read as a unigram model
with byte fallback. A space becomes the word mark, a text that doesn't begin with one gets a mark in front, and words begin
at marks; no piece has a mark inside, so a text's count is the sum of its words' counts and each distinct word of a block is
counted once. An automaton over UTF-8 bytes (states in one table, matches chained from longest to shortest) gives at each
position the pieces that end there. The pass keeps, for all words at once, the best score and its number of pieces.

Tie rules, as the public unigram implementation has them: at each end pieces are tried from the earliest start, the longest
first, and a later one must be strictly better; a character without a piece of its own may be unknown, at the least score of
the vocabulary less 10, tried last, and then counts its bytes. Scores add up in 64-bit floats.

Defined results: a null or empty text has no tokens; rows of the same or no identifier count each; an empty table gives an
empty result. Other columns than the identifier and the text are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_batches
from .text import flat, joined, span_hashes

BLOCK_BYTES = 8 << 20
#: Fixed values of the public unigram implementation and of sentencepiece files.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
#: Longer words are walked one by one.
LONG_WORD = 256
#: Words of a pass together.
GROUP = 50_000


def pieces_of(path: str) -> dict[str, float]:
    """The ordinary pieces of a sentencepiece file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and MARK not in piece[1:]:
            out[piece] = model.get_score(i)
    return out


class Automaton:
    """The pieces as an Aho-Corasick automaton in arrays, and the counting pass."""

    def __init__(self, pieces: dict[str, float]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, float]] = {}
        for piece, score in pieces.items():
            at, data = 0, piece.replace(MARK, " ").encode()
            for b in data:
                if (to := children[at].get(b)) is None:
                    to = children[at][b] = len(children)
                    children.append({})
                at = to
            ends[at] = (len(data), score)
        n = len(children)
        used = sorted({b for c in children for b in c})
        self.column = np.zeros(256, np.int64)  # 0: in no piece
        self.column[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        table = np.zeros((n, width), np.int32)
        self.length, self.score = np.zeros(n, np.int64), np.zeros(n)
        self.longest = np.full(n, -1, np.int32)  # the state of the longest piece that ends here
        self.shorter = np.full(n, -1, np.int32)  # of a piece's state: that of the next shorter one
        fail, queue = np.zeros(n, np.int64), [0]
        column = self.column.tolist()
        for at in queue:  # breadth first: a state's row starts as that of its longest proper suffix
            f = int(fail[at])
            if at:
                table[at] = table[f]
            if at in ends:
                self.length[at], self.score[at] = ends[at]
                self.longest[at], self.shorter[at] = at, self.longest[f] if at else -1
            elif at:
                self.longest[at] = self.longest[f]
            for b, to in children[at].items():
                fail[to] = table[at, column[b]] if at else 0
                table[at, column[b]] = to
                queue.append(to)
        self.table, self.width = table.ravel(), width
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.reach = int(self.length.max(initial=1))

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of pieces of each word (a byte span of whole characters)."""
        size = ends - starts
        out = np.zeros(len(starts), np.int64)
        order = np.argsort(size, kind="stable")
        stop = int(np.searchsorted(size[order], LONG_WORD, "right"))
        for a in range(0, stop, GROUP):
            rows = order[a : min(a + GROUP, stop)]
            out[rows] = self._together(data, starts[rows], size[rows])
        for i in order[stop:]:
            out[i] = self._alone(data[starts[i] : ends[i]])
        return out

    def _together(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """size is ascending: words leave in front as they end."""
        n, most = len(start), int(size[-1])
        best, count = np.zeros((most + 1, n)), np.zeros((most + 1, n), np.int64)
        best[1:] = -np.inf
        state, whole = np.zeros(n, np.int64), np.zeros(n, np.int64)  # whole: bytes of the character so far
        for t in range(1, most + 1):
            live = np.arange(int(np.searchsorted(size, t)), n)
            byte = data[start[live] + t - 1]
            state[live] = self.table[state[live] * self.width + self.column[byte]]
            whole[live] = np.where((byte & 0xC0) == 0x80, whole[live] + 1, 1)
            last = live[size[live] == t]
            more = live[size[live] > t]
            ends = np.concatenate([last, more[(data[start[more] + t] & 0xC0) != 0x80]])
            alone = np.zeros(n, bool)  # whether the character has a piece of its own
            rows, piece = ends, self.longest[state[ends]]
            while True:
                some = piece >= 0
                if not some.any():
                    break
                rows, piece = rows[some], piece[some]
                length = self.length[piece]
                alone[rows] |= length == whole[rows]
                score = best[t - length, rows] + self.score[piece]
                better = score > best[t, rows]
                r = rows[better]
                best[t, r] = score[better]
                count[t, r] = count[t - length[better], r] + 1
                piece = self.shorter[piece]
            rows = ends[~alone[ends]]
            score = best[t - whole[rows], rows] + self.unknown
            better = score > best[t, rows]
            r = rows[better]
            best[t, r] = score[better]
            count[t, r] = count[t - whole[r], r] + whole[r]
        return count[size, np.arange(n)]

    def _alone(self, word: np.ndarray) -> int:
        """One long word."""
        columns, head = self.column[word].tolist(), ((word & 0xC0) != 0x80).tolist() + [True]
        best, count, state, whole = [0.0] * (len(columns) + 1), [0] * (len(columns) + 1), 0, 0
        for t, c in enumerate(columns, 1):
            state = int(self.table[state * self.width + c])
            whole = 1 if head[t - 1] else whole + 1
            if not head[t]:
                continue
            top, number, single, piece = -np.inf, 0, False, int(self.longest[state])
            while piece >= 0:
                n = int(self.length[piece])
                single |= n == whole
                if (s := best[t - n] + float(self.score[piece])) > top:
                    top, number = s, count[t - n] + 1
                piece = int(self.shorter[piece])
            if not single and (s := best[t - whole] + self.unknown) > top:
                top, number = s, count[t - whole] + whole
            best[t], count[t] = top, number
        return count[-1]

    def count_rows(self, column: pa.Array) -> np.ndarray:
        """The number of pieces of each text."""
        column = pc.replace_substring(column, MARK, " ")  # the mark itself in a text counts as a space
        data, at = flat(column)
        size = np.diff(at)
        bare = np.flatnonzero(size > 0)
        bare = bare[data[at[bare]] != 0x20]
        data = np.insert(data, at[bare], np.uint8(0x20))
        at = at + np.searchsorted(bare, np.arange(len(at)))
        mark = np.zeros(len(data) + 1, bool)
        mark[:-1] = data == 0x20
        starts = np.flatnonzero(mark)
        ends = np.append(starts[1:], len(data))
        _, pick, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        number = self.count(data, starts[pick], ends[pick])[back] if len(starts) else starts
        return np.diff(np.concatenate([[0], np.cumsum(number)])[np.searchsorted(starts, at)])


@functools.cache
def automaton(path: str) -> Automaton:
    """A worker builds it once."""
    return Automaton(pieces_of(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each row. path: a sentencepiece file on every machine."""
    bounded_batches(docs.sparkSession)

    def work(batches):
        for batch in joined(batches, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(automaton(path).count_rows(batch.column("text")))], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_tokens long")
