"""Exact dedup by a log-structured merge index of text digests.

Each task fills memtables (digest -> identifiers seen, their extreme, their number) and flushes them as sorted digest runs
with a Bloom filter, cut by digest range. Compaction of a range merges its runs, smaller ones first; the filter of the
larger run tells which digests of the smaller need a search in it. An entry keeps one identifier, the one that stays, and
the number of rows. Rows whose digest hits an entry of several rows are verified byte for byte against the row that stays.

Defined results: a null text counts as empty; a null identifier is below all others and stays only if all of its group are
null; repeated identifiers count as separate rows, of which exactly one is marked kept, also where all identifiers of a text
are null; an empty table gives an empty result.
Columns other than the identifier and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bucket_count, materialize
from .text import C1, C2, mix

DIGEST = 32
#: Rows that a memtable takes before it is flushed.
MEMTABLE_ROWS = 200_000
#: A group of copies is dealt over several keys once it holds this share of all rows.
HEAVY_SHARE = 1 / 1000
#: Stands for a null identifier.
LOWEST = np.iinfo(np.int64).min
RUNS = "bucket int, run long, entries long, digests binary, ids binary, counts binary, filter binary"


class Bloom:
    """A Bloom filter over 32-byte digests, about ten bits and four probes an entry."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def probes(digests: np.ndarray, size: int) -> Iterator[np.ndarray]:
        q = digests.view("<u8").reshape(-1, 4)
        for i in range(4):
            yield mix(q[:, i] + C1) % np.uint64(size)

    @classmethod
    def of(cls, digests: np.ndarray) -> Bloom:
        bits = np.zeros(max(64, 10 * len(digests)), bool)
        for at in cls.probes(digests, len(bits)):
            bits[at] = True
        return cls(bits)

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        out = np.ones(len(digests), bool)
        for at in self.probes(digests, len(self.bits)):
            out &= self.bits[at]
        return out

    def dump(self) -> bytes:
        return len(self.bits).to_bytes(8, "little") + np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, data: bytes) -> Bloom:
        n = int.from_bytes(data[:8], "little")
        return cls(np.unpackbits(np.frombuffer(data, np.uint8, offset=8), count=n).astype(bool))


class Run:
    """Entries of distinct digests in ascending order: the identifier that stays and the number of rows."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, bloom: Bloom | None = None):
        self.digests, self.ids, self.counts = digests, ids, counts
        self.bloom = bloom or Bloom.of(digests)

    @classmethod
    def flush(cls, digests: np.ndarray, ids: np.ndarray, keep_largest: bool) -> Run:
        """A memtable's rows, in any order and with repeats, as a run."""
        order = np.argsort(digests, kind="stable")
        digests, ids = digests[order], ids[order]
        first = np.flatnonzero(np.append(True, digests[1:] != digests[:-1])[: len(digests)])
        pick = np.maximum if keep_largest else np.minimum
        return cls(digests[first], pick.reduceat(ids, first) if len(first) else ids, np.diff(np.append(first, len(digests))))

    def merged(self, other: Run, keep_largest: bool) -> Run:
        """Both runs as one."""
        big, small = (self, other) if len(self.digests) >= len(other.digests) else (other, self)
        maybe = np.flatnonzero(big.bloom.may_hold(small.digests))
        at = np.minimum(np.searchsorted(big.digests, small.digests[maybe]), max(0, len(big.digests) - 1))
        hit = big.digests[at] == small.digests[maybe] if len(big.digests) else np.zeros(0, bool)
        mine, theirs = at[hit], maybe[hit]
        pick = np.maximum if keep_largest else np.minimum
        ids, counts = big.ids.copy(), big.counts.copy()
        ids[mine] = pick(ids[mine], small.ids[theirs])
        counts[mine] += small.counts[theirs]
        new = np.ones(len(small.digests), bool)
        new[theirs] = False
        where = np.searchsorted(big.digests, small.digests[new])
        return Run(np.insert(big.digests, where, small.digests[new]), np.insert(ids, where, small.ids[new]), np.insert(counts, where, small.counts[new]))


def compact(runs: Iterable[Run], keep_largest: bool) -> Run | None:
    """Size-tiered: the two smallest runs are merged until one is left."""
    import heapq

    heap = [(len(r.digests), i, r) for i, r in enumerate(runs)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        n += 1
        heapq.heappush(heap, (len((m := a.merged(b, keep_largest)).digests), n, m))
    return heap[0][2] if heap else None


def _digests(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), f"S{DIGEST}") if len(column) else np.zeros(0, f"S{DIGEST}")


def build_index(digested: DataFrame, buckets: int, keep_largest: bool = False) -> DataFrame:
    """The compacted index of rows (digest binary of 32 bytes, id long): (digest, keep_id, group_size), one row a digest of several rows."""

    def flush(batches):
        from pyspark import TaskContext

        part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0

        def runs():
            nonlocal serial
            digests = np.concatenate([d for d, _ in held])
            whole = Run.flush(digests, np.concatenate([i for _, i in held]), keep_largest)
            raw = whole.digests.view(np.uint8).reshape(-1, DIGEST)
            where = (raw[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])) * buckets >> 32
            cuts = np.searchsorted(where, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[b], cuts[b + 1])
                rows.append((int(b), part << 32 | serial, s.stop - s.start, whole.digests[s].tobytes(), whole.ids[s].tobytes(), whole.counts[s].tobytes(), Bloom.of(whole.digests[s]).dump()))
            serial += 1
            names = [c.split()[0] for c in RUNS.split(", ")]
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds, strict=True)], names=names)

        for batch in batches:
            ids = np.asarray(batch.column("id").fill_null(int(LOWEST)))
            held.append((_digests(batch.column("digest")), ids.astype(np.int64)))
            size += batch.num_rows
            if size >= MEMTABLE_ROWS:
                yield runs()
                held, size = [], 0
        if size:
            yield runs()

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        runs = [Run(np.frombuffer(d, f"S{DIGEST}"), np.frombuffer(i, np.int64), np.frombuffer(c, np.int64), Bloom.load(f)) for d, i, c, f in zip(rows["digests"], rows["ids"], rows["counts"], rows["filter"], strict=True)]
        out = compact(runs, keep_largest)
        several = np.flatnonzero(out.counts > 1)
        ids = out.ids[several]
        return pa.table({"digest": pa.array(_raw(out.digests[several]), pa.binary()), "keep_id": pa.array(ids, mask=ids == LOWEST), "group_size": pa.array(out.counts[several])})

    runs = digested.select("digest", "id").mapInArrow(flush, RUNS)
    return runs.groupBy("bucket").applyInArrow(merge, "digest binary, keep_id long, group_size long")


def _raw(digests: np.ndarray) -> list[bytes]:
    data = digests.tobytes()  # an element's own trailing zero bytes would be lost
    return [data[i : i + DIGEST] for i in range(0, len(data), DIGEST)]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_largest: bool = False, digest=None) -> DataFrame:
    """One row per row of docs: (id, keep_id, group_size, kept, digest); of equal texts one identifier stays.

    digest: a function from a text column to a binary column of 32 bytes, SHA-256 unless given.
    """
    digest = digest or (lambda c: F.unhex(F.sha2(c, 256)))
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    keys = rows.select("id", "digest")
    hits = materialize(build_index(keys, bucket_count(spark), keep_largest), "dedup-hits")
    unit = max(1, int(docs.count() * HEAVY_SHARE))
    # At most 1 / HEAVY_SHARE groups are heavy: a fixed bound on what is broadcast.
    # The others are always joined by a shuffle, so that the plan is the same at every size.
    heavy, light = F.broadcast(hits.where(F.col("group_size") >= unit)), hits.where(F.col("group_size") < unit).hint("merge")
    copies = materialize(rows.join(heavy, "digest").unionByName(rows.join(light, "digest")), "dedup-copies")
    alone = keys.join(heavy, "digest", "left_anti").join(light, "digest", "left_anti")
    checked = materialize(_verified(copies, unit), "dedup-verified")
    if not checked.where(~F.col("same")).isEmpty():
        checked = _regrouped(copies, checked, keep_largest)
    alone = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    checked = checked.withColumn("kept", stays)
    # Of several rows with the identifier that stays, one is kept: equal in identifier and text, they differ by place alone.
    place = ["digest", "keep_id", "variant"]
    several = materialize(checked.where(stays).groupBy(*place).agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "dedup-repeated")
    if not several.isEmpty():
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in place]
        checked = checked.alias("x").join(several.alias("y"), same[0] & same[1] & same[2], "left").withColumn("kept", F.col("kept") & (F.col("least").isNull() | (F.col("least") == F.col("place"))))
        checked = checked.select("id", F.col("x.keep_id").alias("keep_id"), "group_size", "kept", F.col("x.digest").alias("digest"))
    return alone.unionByName(checked.select("id", "keep_id", "group_size", "kept", "digest"))


def _verified(copies: DataFrame, unit: int) -> DataFrame:
    """The rows with a hit, without text: whether each text has the bytes of the one that stays. A large group is dealt over a key for each `unit` of its rows."""
    salts = F.ceil(F.col("group_size") / F.lit(unit)).cast("int")
    stay = copies.where(F.col("id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"])
    stay = stay.select("digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("text").alias("stays"))
    dealt = copies.withColumn("salt", F.pmod(F.hash("id"), salts))
    return dealt.join(stay, ["digest", "salt"]).select("id", "digest", "keep_id", "group_size", (F.col("text") == F.col("stays")).alias("same"), F.monotonically_increasing_id().alias("place"), F.lit(0).cast("long").alias("variant"))


def _regrouped(copies: DataFrame, checked: DataFrame, keep_largest: bool) -> DataFrame:
    """For different texts of one digest: the groups of those digests anew, by the texts themselves."""
    clash = checked.where(~F.col("same")).select("digest").distinct()
    agg = F.max if keep_largest else F.min
    again = copies.join(clash, "digest", "left_semi")
    pick = agg("id") if keep_largest else F.when(F.count("id") == F.count(F.lit(1)), agg("id"))
    groups = again.groupBy("digest", "text").agg(pick.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = again.select("id", "digest", "text").join(groups, ["digest", "text"])
    again = materialize(again.select("id", "digest", "keep_id", "group_size", F.monotonically_increasing_id().alias("place"), F.xxhash64("text").alias("variant")), "dedup-regrouped")
    return checked.join(clash, "digest", "left_anti").drop("same").unionByName(again)
