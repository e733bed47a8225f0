"""A Bloom filter of fixed size over 64-bit keys of a table: what is broadcast doesn't grow with the data.

With more keys than it has room for, the filter lets more rows pass; the join behind it stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import C1, C2, mix

BITS = 1 << 26  # 8 MB
RANGES = 64


class Membership:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def probes(keys: np.ndarray) -> np.ndarray:
        k = keys.astype(np.int64).view(np.uint64)
        return np.concatenate([mix(k + C1), mix(k ^ C2)]) % np.uint64(BITS)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = self.probes(keys)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).reshape(2, -1).all(0)

    @classmethod
    def of(cls, table: DataFrame, column: str) -> Membership:
        """Of the column's values (longs), null left out. Tasks send the positions of set bits by range of the filter; a range's bits are one row."""
        span = BITS // RANGES

        def probe(batches):
            for batch in batches:
                at = np.unique(cls.probes(np.asarray(batch.column(0).drop_null())).astype(np.int64))
                cuts = np.searchsorted(at, np.arange(RANGES + 1) * span)
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([(at[cuts[r] : cuts[r + 1]] - r * span).astype(np.uint32).tobytes() for r in full], pa.binary())], names=["part", "at"])

        def union(group: pa.Table) -> pa.Table:
            bits = np.zeros(span, np.uint8)
            for at in group.column("at").to_pylist():
                bits[np.frombuffer(at, np.uint32)] = 1
            return pa.table({"part": group.column("part")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        out = np.zeros(BITS // 8, np.uint8)
        rows = table.select(column).mapInArrow(probe, "part int, at binary").groupBy("part").applyInArrow(union, "part int, bits binary")
        for r in rows.collect():
            out[r.part * span // 8 : (r.part + 1) * span // 8] = np.frombuffer(r.bits, np.uint8)
        return cls(out)


def members(sent, keys: pa.Array) -> pa.Array:
    """For an Arrow UDF, whose workers need no pandas: whether each of an array of longs (null counts as 0) may be a member of the broadcast filter."""
    return pa.array(sent.value.may_hold(np.asarray(keys.fill_null(0))))


def kept(batches, sent, column: str):
    """In mapInArrow: the batches' rows whose column (long, null left out) may be a member of the broadcast filter."""
    for batch in batches:
        keys = batch.column(column)
        yield batch.filter(pa.array(sent.value.may_hold(np.asarray(keys.fill_null(0))) & np.asarray(keys.is_valid())))
