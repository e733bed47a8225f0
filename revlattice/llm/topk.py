"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size; a block is broadcast and every partition scores all its vectors against it.
A first pass finds each query's range of scores. Further passes count scores in equal bins of the range that is left, and
the summed counts say in which bin the k-th largest score lies, until that bin is one score wide or holds few scores. The
last pass keeps what reaches that bin, at most k rows for each query and task, ties to smaller identifiers.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without identifier;
a query meets only vectors of its own length; rows with the query's identifier are not its candidates; repeated candidate
rows count each; repeated identical query rows count once; scores beyond 64 bits saturate; no queries give no rows.
Other columns than the identifier and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
TOP = 10
#: Queries of a block: with their vectors and counts, all that is broadcast or sent to the driver at once.
BLOCK = 2048
BINS = 512
#: A bin with so few scores is not refined further.
FEW = 64
#: Queries whose partial results travel together.
CHUNK = 16
#: Candidates scored at once.
ROWS = 1024
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def vectors(batch: pa.RecordBatch, id_col: str, vector_col: str, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(identifiers, matrix of floor(scale * x)) for each length of vectors in the batch; as floats that hold integers."""
    column, ids = batch.column(vector_col), batch.column(id_col)
    ok = np.asarray(column.is_valid()) & np.asarray(ids.is_valid())
    column, ids = column.filter(pa.array(ok)), np.asarray(ids.filter(pa.array(ok))).astype(np.int64)
    size = np.asarray(column.value_lengths()).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    values = column.flatten()
    flat = np.floor(scale * np.asarray(values.fill_null(float("nan"))).astype(np.float64))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = bad[at[1:]] == bad[at[:-1]]
    for d in np.unique(size[good]):
        rows = np.flatnonzero(good & (size == d))
        yield ids[rows], flat[at[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact, saturated to 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(exact(q) @ exact(c).T, LOW, HIGH).astype(np.int64)


class Queries:
    """A block of queries: for each length of vectors their positions and matrix."""

    def __init__(self, ids: np.ndarray, groups: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.ids, self.groups = ids, groups

    @classmethod
    def of(cls, table: pa.Table, id_col: str, vector_col: str, scale: int) -> Queries:
        ids, groups = [], {}
        for batch in table.combine_chunks().to_batches():
            for i, m in vectors(batch, id_col, vector_col, scale):
                start = sum(map(len, ids))
                ids.append(i)
                pos, have = groups.get(m.shape[1], (np.zeros(0, np.int64), np.zeros((0, m.shape[1]))))
                groups[m.shape[1]] = np.concatenate([pos, start + np.arange(len(i))]), np.concatenate([have, m])
        return cls(np.concatenate(ids) if ids else np.zeros(0, np.int64), groups)

    def scores(self, batches, id_col: str, vector_col: str, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(positions of queries, identifiers of candidates, scores, which of them count)."""
        for batch in batches:
            for ids, m in vectors(batch, id_col, vector_col, scale):
                if (group := self.groups.get(m.shape[1])) is None:
                    continue
                for a in range(0, len(ids), ROWS):
                    part = ids[a : a + ROWS]
                    yield group[0], part, inner(group[1], m[a : a + ROWS]), self.ids[group[0]][:, None] != part[None, :]


def _chunks(rows: np.ndarray, n: int) -> pa.RecordBatch:
    """Rows of integers, the first the query's position, packed by chunk of queries."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    cuts = np.searchsorted(rows[:, 0], np.arange(0, n + CHUNK, CHUNK))
    full = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([rows[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())], names=["chunk", "rows"])


def _unpacked(table: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("rows").to_pylist()), np.int64).reshape(-1, width)


def _best(rows: np.ndarray, k: int) -> np.ndarray:
    """Of rows (query, score, id) each query's first k by score downwards, then id."""
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))] if rows[:, 1].min(initial=0) > LOW else rows[np.lexsort((rows[:, 2], -(rows[:, 1].astype(object)), rows[:, 0]))]
    first = np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[np.arange(len(rows)) - first < k]


def _search_block(candidates: DataFrame, q: Queries, k: int, id_col: str, vector_col: str, scale: int) -> DataFrame:
    spark, n = candidates.sparkSession, len(q.ids)
    sent = spark.sparkContext.broadcast(q)

    def ranges(batches):
        lo, hi, count = np.full(n, HIGH), np.full(n, LOW), np.zeros(n, np.int64)
        for pos, _, s, on in sent.value.scores(batches, id_col, vector_col, scale):
            lo[pos] = np.minimum(lo[pos], np.where(on, s, HIGH).min(1))
            hi[pos] = np.maximum(hi[pos], np.where(on, s, LOW).max(1))
            count[pos] += on.sum(1)
        some = np.flatnonzero(count)
        yield _chunks(np.stack([some, lo[some], hi[some], count[some]], 1), n)

    def total_ranges(table: pa.Table) -> pa.Table:
        rows = _unpacked(table, 4)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        q, first = np.unique(rows[:, 0], return_index=True)
        out = np.stack([q, np.minimum.reduceat(rows[:, 1], first), np.maximum.reduceat(rows[:, 2], first), np.add.reduceat(rows[:, 3], first)], 1)
        return pa.table({"rows": pa.array([out.tobytes()], pa.binary())})

    packed = "chunk int, rows binary"
    gathered = lambda df, f: _unpacked(df.groupBy("chunk").applyInArrow(f, "rows binary").toArrow(), 4)
    lo, hi, need, inside = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    found = gathered(candidates.mapInArrow(ranges, packed), total_ranges)
    lo[found[:, 0]], hi[found[:, 0]], inside[found[:, 0]] = found[:, 1], found[:, 2], found[:, 3]
    need[:] = np.minimum(k, inside)
    while (todo := (inside > np.maximum(need, 0) + FEW) & (hi > lo)).any():
        width = np.where(todo, ((hi.astype(object) - lo) // BINS + 1), 1).astype(np.int64)
        state = spark.sparkContext.broadcast((lo, hi, width, todo, need))

        def histogram(batches):
            lo, hi, width, todo, _ = state.value
            counts = np.zeros((n, BINS), np.int64)
            for pos, _, s, on in sent.value.scores(batches, id_col, vector_col, scale):
                on = on & todo[pos][:, None] & (s >= lo[pos][:, None]) & (s <= hi[pos][:, None])
                r, c = np.nonzero(on)
                p = pos[r]
                np.add.at(counts, (p, (s[r, c] - lo[p]).astype(np.uint64) // width[p].astype(np.uint64)), 1)
            p, b = np.nonzero(counts)
            yield _chunks(np.stack([p, b, counts[p, b]], 1), n)

        def locate(table: pa.Table) -> pa.Table:
            need = state.value[4]
            rows = _unpacked(table, 3)
            rows = rows[np.lexsort((-rows[:, 1], rows[:, 0]))]
            out = []
            for q in np.unique(rows[:, 0]):
                own = rows[rows[:, 0] == q]
                bins, first = np.unique(-own[:, 1], return_index=True)
                counts = np.add.reduceat(own[:, 2], first)
                i = int(np.searchsorted(np.cumsum(counts), need[q]))
                out.append((q, -bins[i], counts[:i].sum(), counts[i]))
            return pa.table({"rows": pa.array([np.array(out, np.int64).tobytes()], pa.binary())})

        found = gathered(candidates.mapInArrow(histogram, packed), locate)
        p = found[:, 0]
        lo[p] += found[:, 1] * width[p]
        hi[p] = np.minimum(hi[p], lo[p] + (width[p] - 1))
        need[p] -= found[:, 2]
        inside[p] = found[:, 3]
        state.unpersist()
    bound = spark.sparkContext.broadcast(lo)

    def reach(batches):
        held, size = [], 0
        for pos, ids, s, on in sent.value.scores(batches, id_col, vector_col, scale):
            r, c = np.nonzero(on & (s >= bound.value[pos][:, None]))
            held.append(np.stack([pos[r], s[r, c], ids[c]], 1))
            size += len(r)
            if size > 4 * k * n + 100_000:
                held = [_best(np.concatenate(held), k)]
                size = len(held[0])
        if size:
            yield _chunks(_best(np.concatenate(held), k), n)

    def rank(table: pa.Table) -> pa.Table:
        rows = _best(_unpacked(table, 3), k)
        place = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0]) + 1
        return pa.table({"query_id": sent.value.ids[rows[:, 0]], "rank": place.astype(np.int32), "id": rows[:, 2], "score": rows[:, 1]})

    return candidates.mapInArrow(reach, packed).groupBy("chunk").applyInArrow(rank, "query_id long, rank int, id long, score long")


def exact_topk(table: DataFrame, is_query, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): for each row that is_query (a condition) selects, its k best of all other rows."""
    candidates = table.select(id_col, vector_col)
    queries = candidates.where(is_query).where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).distinct()
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(id_col, vector_col), F.lit(blocks)) == b)
        q = Queries.of(own.toArrow(), id_col, vector_col, scale)
        if len(q.ids):
            part = _search_block(candidates, q, k, id_col, vector_col, scale)
            out = part if out is None else out.unionByName(part)
    return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long") if out is None else out
