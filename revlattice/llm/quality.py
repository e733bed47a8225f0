"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed with numpy over Arrow batches. A bounded sample of labelled rows is binned by
quantiles; each tree of fixed depth is grown level by level from histograms of gradients. The trees are flattened into
arrays (feature, threshold, leaf value) that numpy walks for all rows and trees at once.

Defined results: a null or empty text has statistics of zero and gets a score like any other; rows with the same or no
identifier are scored each; without labels of both kinds every score is the share of label 1 (0.5 without any label); an
empty table gives an empty result. Identifier, language, source and labels are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_batches, materialize
from .text import C2, SPACE, flat, mix, slices, span_hashes, words

#: Labelled rows that a fit uses at most (about: they are taken by a hash of the identifier).
#: Bytes of text whose statistics are made at once: they take some 30 times that (a longer single text makes a slice of its own).
STATISTICS_BYTES = 1 << 20
SAMPLE_ROWS = 20_000
HOLD_OUT = 5
CUT = 0.3
TREES, DEPTH, RATE, BINS, RIDGE, LEAST_ROWS = 60, 4, 0.15, 64, 1.0, 10


def _kinds() -> np.ndarray:
    b = np.arange(256)
    letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    upper, digit = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    stop = np.isin(b, list(b".,;:'\""))
    mark = np.isin(b, list(b"!?"))
    other = ~(letter | digit | SPACE | stop | mark)
    return np.stack([letter, upper, digit, SPACE, stop, mark, other, b == 10, b == ord("|"), (b >= 128) & (b < 192)], 1).astype(np.float64)


KINDS = _kinds()
NAMES = (
    "log_bytes", "letters", "uppercase", "digits", "blanks", "stops", "marks", "others", "pipes", "beyond_ascii", "byte_entropy",
    "log_words", "mean_word", "deviation_word", "longest_word", "short_words", "distinct_words", "top_word", "distinct_pairs", "repeats_before",
    "log_lines", "mean_line", "longest_line", "distinct_lines", "words_end_in_symbol", "worst_window_symbols", "worst_window_uppercase",
)
WINDOW = 256


def _by_row(values: np.ndarray, first: np.ndarray, ufunc=np.add) -> np.ndarray:
    """ufunc over values[first[i]:first[i + 1]], 0 where that is empty."""
    out = np.zeros(len(first) - 1, np.float64)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = ufunc.reduceat(values, first[:-1][some])
    return out


def _distinct(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of values per row: how many are distinct, and how often the most frequent occurs."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)])
    run = np.diff(np.append(start, len(h)))
    top = np.zeros(rows)
    np.maximum.at(top, row[start], run)
    return np.bincount(row[start], minlength=rows).astype(np.float64), top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics, in the order of NAMES, for each text."""
    data, at = flat(column)
    n = len(at) - 1
    size = np.diff(at).astype(np.float64)
    per = np.maximum(size, 1)[:, None]
    owner = np.repeat(np.arange(n), np.diff(at))
    hist = np.bincount(owner * 256 + data, minlength=256 * n).reshape(n, 256).astype(np.float64)
    kinds = hist @ KINDS
    share = hist / per
    entropy = -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum(1)
    starts, ends, first = words(data, at)
    h = span_hashes(data, starts, ends)
    count = np.diff(first)
    word_row = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(np.float64)
    per_word = np.maximum(count, 1)
    mean = _by_row(length, first) / per_word
    spread = np.sqrt(np.maximum(_by_row(length * length, first) / per_word - mean * mean, 0))
    distinct, top = _distinct(h, word_row, n)
    pair = mix(h[:-1] * C2 + h[1:]) if len(h) else h
    inside = word_row[1:] == word_row[:-1] if len(h) else np.zeros(0, bool)
    pairs, _ = _distinct(pair[inside], word_row[1:][inside], n)
    before = _by_row(np.append(False, (h[1:] == h[:-1]) & inside).astype(np.float64)[: len(h)], first)
    new_line = np.flatnonzero(data == 10)
    line_first = np.unique(np.concatenate([at[:-1][size > 0], new_line + 1]))
    line_first = line_first[line_first < len(data)]
    line_end = np.append(line_first[1:], len(data))
    line_row = owner[line_first] if len(line_first) else line_first
    line_bounds = np.searchsorted(line_first, at)
    lines, _ = _distinct(span_hashes(data, line_first, line_end), line_row, n)
    line_count = np.diff(line_bounds)
    line_length = (line_end - line_first).astype(np.float64)
    symbol = KINDS[data, 6] + KINDS[data, 5]
    last = symbol[ends - 1] if len(ends) else np.zeros(0)
    # The worst window of a text: junk may fill only a part of it.
    cut = np.unique(np.concatenate([at[:-1][size > 0], *[np.arange(a, b, WINDOW) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]])).astype(np.int64)
    wide = np.diff(np.append(cut, len(data))).astype(np.float64)
    bounds = np.searchsorted(cut, at)
    worst = [_by_row(np.add.reduceat(v, cut) / np.maximum(wide, WINDOW / 4), bounds, np.maximum) if len(cut) else np.zeros(n) for v in (symbol, KINDS[data, 1])]
    columns = [
        np.log1p(size), *(kinds[:, i] / per[:, 0] for i in (0, 1, 2, 3, 4, 5, 6, 8, 9)), entropy,
        np.log1p(count), mean, spread, _by_row(length, first, np.maximum), _by_row((length <= 3).astype(np.float64), first) / per_word, distinct / per_word, top / per_word, pairs / per_word, before / per_word,
        np.log1p(line_count), _by_row(line_length, line_bounds) / np.maximum(line_count, 1), _by_row(line_length, line_bounds, np.maximum), lines / np.maximum(line_count, 1), _by_row(last, first) / per_word, *worst,
    ]
    return np.stack(columns, 1).astype(np.float32)


class Trees:
    """Flattened boosted trees: trees of one depth, nodes of a level after those of the level above."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        t = np.arange(len(self.feature))
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048]
            r, at = np.arange(len(part))[:, None], np.zeros((len(part), len(t)), np.int64)
            for _ in range(DEPTH if len(t) else 0):
                at = 2 * at + 1 + (part[r, self.feature[t, at]] > self.threshold[t, at])
            if len(t):
                total[a : a + 2048] += self.leaf[t, at - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the rows x with labels y of 0 and 1."""
    n, width = x.shape[0], len(NAMES)
    none = np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1), np.float32), np.zeros((0, 2**DEPTH))
    share = float(y.mean()) if n else 0.5
    if not n or not 0 < share < 1:
        return Trees(float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -13, 13)), *none)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")).astype(np.float32) for f in range(width)]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1)  # bin b: x <= edges[b]
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    column = np.arange(width) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, hess = p - y, p * (1 - p)
        node, feature, threshold = np.zeros(n, np.int64), np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf, np.float32)
        for level in range(DEPTH):
            at, nodes = node - (2**level - 1), 2**level
            cell = (at[:, None] * (width * BINS) + column + bins).ravel()
            sums = [np.bincount(cell, np.repeat(w, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2) for w in (g, hess, np.ones(n))]
            (gl, hl, nl), (ga, ha, na) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(nl < LEAST_ROWS) | (na - nl < LEAST_ROWS)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for i in np.flatnonzero(gain.reshape(nodes, -1).max(1) > 1e-9):
                f, b = divmod(int(best[i]), BINS)
                if b < len(edges[f]):
                    feature[2**level - 1 + i], threshold[2**level - 1 + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - (2**DEPTH - 1)
        leaf = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, hess, 2**DEPTH) + RIDGE)
        margin += leaf[at]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(base, np.stack(features), np.stack(thresholds), np.stack(leaves))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % HOLD_OUT == 0


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of each row."""

    def work(batches):
        for batch in slices(batches, STATISTICS_BYTES):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, x array<float>")


def sampled(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, y): the labels (doc_id, quality) outside the hold-out, a sample of about sample_rows of them at most."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    total = known.count()
    if total > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample_rows / total * (1 << 30)))
    return known


def train(stats: DataFrame, known: DataFrame) -> Trees:
    """From the statistics of documents and a sample of labels."""
    rows = stats.join(known, "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, len(NAMES)) if rows.num_rows else np.zeros((0, len(NAMES)), np.float32)
    return fit(x, np.asarray(rows.column("y")))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    bounded_batches(docs.sparkSession)
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(train(stats, sampled(labels)))

    def work(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score at least `cut`; statistics are made of the sampled labelled rows, then of every row as it is scored."""
    bounded_batches(docs.sparkSession)
    known = materialize(sampled(labels), "sampled-labels")  # a bounded number of rows
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    model = docs.sparkSession.sparkContext.broadcast(train(document_statistics(asked), known))

    def work(batches):
        for batch in slices(batches, STATISTICS_BYTES, column=text_col):
            good = model.value.score(statistics(batch.column(text_col))) >= cut
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(work, docs.schema)
