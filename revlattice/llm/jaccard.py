"""N-gram Jaccard join of documents by PartEnum signatures.

A document's set holds its distinct shingles of five words. Sets are put into bands of sizes so that two sets of a likeness
of at least the threshold lie in the same or in neighbouring bands. For the pairs whose smaller set lies in band t, at most
k(t) shingles lie in just one of the two sets. The domain of shingles is partitioned (by hash) into n1 parts of three
subparts, with n1 so large that some part of any such pair holds at most one of those shingles; then two of its subparts
agree. A signature is what a set holds in two subparts of a part, so any such pair shares one of the 3 * n1 signatures.
Signatures of nothing would be shared by unlike sets: they are left out, and a set whose parts are so thinly filled that
the argument then fails also enumerates single shingles as parts of their own, which any pair of such sets shares.

Exact steps make that small. Documents of equal sets are one set. A shingle that no other set has counts against any pair,
so a set with more than a quarter of such shingles has no partner; they are counted over a fixed 3/8 of the domain, in
blocks packed by hash range. Pairs of one signature are looked at through parity sketches, of which the bits that differ are
never more than the shingles that differ, and, since these tell nothing of large sets, through a bit of each of 256 minima,
with a margin that one in 10^11 pairs of the threshold exceeds (alike pairs above it far fewer). linkage.py leaves out pairs of one component; every link used is verified on whole
sets. For the last round the items of all open signatures with one least-hashed item are a union, which holds every pair of
these signatures, and a pair is looked at only in the union of the least key that both items have: once, however many
signatures it shares. A set's unions are at most as many as its signatures. Bloom filters of fixed size pick the documents and sets that a step needs while they are read.

Hashes of 64 bits stand for shingles and for sets; the count of shared shingles is exact up to their collisions.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; rows with the same
identifier are one document whose rows' links add up, and each row is returned; a row with a null identifier is returned
with a null component and takes no part; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linkage import TILE, block_pairs, labelled, linked
from .membership import Membership, kept
from .membership import members as may_be
from .runtime import bounded_batches, bucket_count, materialize
from .text import C1, C2, C3, SHINGLE_WORDS, from40, joined, low40, mix, shingle_sets, slices

THRESHOLD_PERCENT = 75
#: Text of the blocks that the first step packs.
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 65_000
SHARED = 0xFFFF
#: Bytes of shingles that signatures are made of, or that are compared, at once (a larger single set makes a slice of its own).
SET_BYTES = 2 << 20
#: Parts whose signatures the first round of linkage uses.
FIRST_PARTS = 3
#: Length of a parity sketch.
SKETCH_LONGS = 4
#: Length of a sketch of a bit of each of 64 * BIT_LONGS minima, and the most of these that differ between sets of the
#: threshold: an eighth differs, 32 of 256, with a standard deviation of 5.3; one such pair in 10^11 has more than 72.
BIT_LONGS = 4
MOST_BITS = 72
BIT_FACTORS = mix(np.arange(1, 64 * BIT_LONGS + 1, dtype=np.uint64) * C2).astype(np.uint32) | np.uint32(1)
#: More parts than a pair's differing shingles need, since some are thinly filled.
SPARE = 1.2


@functools.cache
def bands(percent: int, most: int) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, k, n1) of each band up to the size `most`."""
    out, lo = [], 1
    while lo <= most:
        hi = max(lo, lo * 100 // percent)
        both = hi + hi * 100 // percent
        k = both - 2 * -(-percent * both // (100 + percent))
        out.append((lo, hi, k, max(1, int(np.ceil((k // 2 + 1) * SPARE)))))
        lo = hi + 1
    return out


def signatures(h: np.ndarray, first: np.ndarray, percent: int, parts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, owners): the PartEnum signatures of each set h[first[i]:first[i + 1]]; only of the first `parts` parts of each set's own band where given."""
    size = np.diff(first)
    table = bands(percent, int(size.max(initial=1)))
    own = np.searchsorted([b[0] for b in table], size, "right") - 1
    sigs, owners = [], []
    for lower in (0, 1) if parts is None else (0,):
        for t in range(len(table)):
            _, _, k, n1 = table[t]
            rows = np.flatnonzero((own == t + lower) & (size > 0))
            if not k or not len(rows):
                continue
            count, salt = size[rows], np.array([C1, C2]) * np.uint64(t + 1)
            row = np.repeat(np.arange(len(rows)), count)
            x = h[np.repeat(first[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(row))]
            place = mix(x + salt[0])
            cell = (place % np.uint64(3 * n1)).astype(np.int64)
            at = row * (3 * n1) + cell
            held = np.bincount(at, minlength=len(rows) * 3 * n1).reshape(-1, n1, 3)
            value = np.zeros(len(rows) * 3 * n1, np.uint64)
            np.add.at(value, at, mix(x ^ C3))
            value = value.reshape(-1, n1, 3)
            # The three choices of two subparts: all but subpart c.
            rest = held.sum(2, keepdims=True) - held
            name = (np.uint64(t) << np.uint64(40)) + np.arange(3 * n1, dtype=np.uint64).reshape(1, n1, 3)
            sig = mix(mix(value.sum(2, keepdims=True, dtype=np.uint64) - value) + mix(name + C2))
            use = rest > 0
            if parts is not None:
                use[:, parts:] = False
            r, p, c = np.nonzero(use)
            sigs.append(sig[r, p, c])
            owners.append(rows[r])
            thin = ((held > 0).sum(2) >= 2).sum(1) <= k // 2
            if parts is None and thin.any():
                mine = thin[row]
                sigs.append(mix(x[mine] + salt[1]))
                owners.append(rows[row[mine]])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("doc_id")
    return np.asarray(column.fill_null(0)).astype(np.int64), np.asarray(column.is_valid())


def candidates(docs: DataFrame, chosen, percent: int, width: int) -> DataFrame:
    """(doc_id) of each row that `chosen` (a broadcast filter of identifiers) lets pass and of which few enough shingles are its alone."""
    buckets = bucket_count(docs.sparkSession)

    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for serial, batch in enumerate(joined(kept(batches, chosen, "doc_id"), BLOCK_BYTES, rows=BLOCK_ROWS)):
            h, first = shingle_sets(batch.column("text"), width)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            mine = (h & np.uint64(7)) < np.uint64(3)
            h, owner = h[mine], owner[mine].astype(np.uint16)
            order = np.argsort(h)
            h, owner = h[order], owner[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            many = np.diff(np.append(start, len(h))) > 1
            h, owner = h[start], np.where(many, SHARED, owner[start]).astype(np.uint16)
            cuts = np.searchsorted((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
            low = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            ids, valid = _ids(batch)
            block = part << 32 | serial
            rows = {b: (b, block, low[cuts[b] : cuts[b + 1]].tobytes(), owner[cuts[b] : cuts[b + 1]].tobytes(), None) for b in np.flatnonzero(np.diff(cuts)).tolist()}
            home = block % buckets
            rows[home] = (*rows.get(home, (home, block, b"", b"", None))[:4], ids.tobytes() + np.diff(first).astype(np.int64).tobytes() + valid.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows.values()), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "hashes", "owners", "docs"])

    def count(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        sizes = [len(o) // 2 for o in got["owners"]]
        raw = np.zeros((sum(sizes), 8), np.uint8)
        raw[:, :5] = np.frombuffer(b"".join(got["hashes"]), np.uint8).reshape(-1, 5)
        h = raw.view("<u8").ravel()
        owner = np.frombuffer(b"".join(got["owners"]), np.uint16)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        alone = np.ones(len(h), bool)
        alone[order[1:][same]] = False
        alone[order[:-1][same]] = False
        alone &= owner != SHARED
        out, at = [], 0
        for n, block, docs in zip(sizes, got["block"], got["docs"], strict=True):
            own = owner[at : at + n][alone[at : at + n]]
            at += n
            if len(own) or docs is not None:
                out.append((block, np.bincount(own).astype(np.uint32).tobytes(), docs))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.binary(), pa.binary())], names=["block", "counts", "docs"])

    def judge(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        docs = next(d for d in got["docs"] if d is not None)
        n = len(docs) // 17
        ids, size, valid = np.frombuffer(docs, np.int64, n), np.frombuffer(docs, np.int64, n, 8 * n), np.frombuffer(docs, bool, n, 16 * n)
        alone = np.zeros(n, np.int64)
        for c in got["counts"]:
            c = np.frombuffer(c, np.uint32)
            alone[: len(c)] += c
        may_differ = size - -(-percent * size // 100)
        return pa.table({"doc_id": ids[(size > 0) & valid & (alone <= may_differ)]})

    packed = docs.select("doc_id", "text").mapInArrow(pack, "bucket int, block long, hashes binary, owners binary, docs binary")
    counted = packed.groupBy("bucket").applyInArrow(count, "block long, counts binary, docs binary")
    return counted.groupBy("block").applyInArrow(judge, "doc_id long")


def _set_ids(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose set isn't empty, hashes of their sets)."""
    some = np.flatnonzero(np.diff(first))
    whole = np.add.reduceat(mix(h ^ C2), first[some]) if len(some) else np.zeros(0, np.uint64)
    return some, mix(whole + np.diff(first)[some].astype(np.uint64) * C1).view(np.int64)


def _members(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, id) of each row: id is a hash of its set, null for the empty one."""

    def work(batches):
        for batch in slices(batches):
            h, first = shingle_sets(batch.column("text"), width)
            some, ids = _set_ids(h, first)
            every, none = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
            every[some], none[some] = ids, False
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(every, mask=none)], names=["doc_id", "n_shingles", "id"])

    return docs.mapInArrow(work, "doc_id long, n_shingles long, id long")


SKETCH = ", ".join(f"s{i} long" for i in range(SKETCH_LONGS + BIT_LONGS))


INFO = ["n", *(f"s{i}" for i in range(SKETCH_LONGS + BIT_LONGS))]


def _sketches(h: np.ndarray, first: np.ndarray, some: np.ndarray) -> list[np.ndarray]:
    """Parities of each set's shingles by SKETCH_LONGS * 64 classes of their hash, then a bit of each of 64 * BIT_LONGS minima."""
    if not len(some):
        return [np.zeros(0, np.int64)] * (SKETCH_LONGS + BIT_LONGS)
    bits = np.uint64(1) << (h & np.uint64(63))
    at = (h >> np.uint64(6)) % np.uint64(SKETCH_LONGS)
    out = [np.bitwise_xor.reduceat(np.where(at == i, bits, np.uint64(0)), first[some]) for i in range(SKETCH_LONGS)]
    short = (h >> np.uint64(32)).astype(np.uint32)
    for i in range(BIT_LONGS):
        word = np.zeros(len(some), np.uint64)
        for j in range(64):
            factor = BIT_FACTORS[64 * i + j]
            least = np.minimum.reduceat((short ^ (factor >> np.uint32(3))) * factor, first[some])
            word |= (mix(least.astype(np.uint64) + C1) & np.uint64(1)) << np.uint64(j)
        out.append(word)
    return [x.view(np.int64) for x in out]


def _sets_of(docs: DataFrame, wanted, width: int) -> DataFrame:
    """(id, n, sketch, shingles) of the sets of documents that `wanted` (a broadcast filter of identifiers) lets pass; a set may come twice."""

    def make(batches):
        for batch in slices(kept(batches, wanted, "doc_id")):
            h, first = shingle_sets(batch.column("text"), width)
            some, ids = _set_ids(h, first)
            data, sketches = h.tobytes(), _sketches(h, first, some)
            blobs = pa.array([data[8 * first[i] : 8 * first[i + 1]] for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(first)[some].astype(np.int32)), *map(pa.array, sketches), blobs], names=["id", "n", *INFO[1:], "shingles"])

    return docs.mapInArrow(make, f"id long, n int, {SKETCH}, shingles binary")


def _flat_sets(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blobs = batch.column("shingles").to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint64), np.concatenate([[0], np.cumsum([len(b) // 8 for b in blobs])]).astype(np.int64), np.asarray(batch.column("id"))


def _signature_groups(sets: DataFrame, percent: int, parts: int | None, emit, schema: str) -> DataFrame:
    """Signatures in packed blocks by hash range; emit(signatures, ids, components) gives the columns of a range's table, from arrays in the order of signature, id."""
    buckets = bucket_count(sets.sparkSession, 1)  # few, since a set's identifier goes to each that has one of its signatures
    names = [c.split()[0] for c in schema.split(", ")]

    def pack(batches):
        for whole in slices(batches, SET_BYTES, "shingles"):
            for batch in (whole.slice(i, BLOCK_ROWS) for i in range(0, whole.num_rows, BLOCK_ROWS)):
                h, first, ids = _flat_sets(batch)
                comp = np.asarray(batch.column("comp"))
                sig, owner = signatures(h, first, percent, parts)
                bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sig, owner = sig[order], owner[order]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts)).tolist()
                rows = []
                for b in full:
                    own, back = np.unique(owner[cuts[b] : cuts[b + 1]], return_inverse=True)
                    rows.append((b, low40(sig[cuts[b] : cuts[b + 1]]), back.astype(np.uint16).tobytes(), ids[own].tobytes(), comp[own].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "sigs", "owners", "ids", "comps"])

    def group(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        sig = from40(b"".join(got["sigs"])) | np.uint64(got["bucket"][0] << 40)
        ids, comp, base = np.frombuffer(b"".join(got["ids"]), np.int64), np.frombuffer(b"".join(got["comps"]), np.int64), 0
        owner = np.empty(len(sig), np.int64)
        at = 0
        for o, i in zip(got["owners"], got["ids"], strict=True):
            o = np.frombuffer(o, np.uint16)
            owner[at : at + len(o)] = o.astype(np.int64) + base
            at += len(o)
            base += len(i) // 8
        order = np.argsort(sig)
        same = sig[order[1:]] == sig[order[:-1]]
        inside = np.append(same, False) | np.append(False, same) if len(order) else np.zeros(0, bool)
        order = order[inside]
        sig, ids, comp = sig[order], ids[owner[order]], comp[owner[order]]
        order = np.lexsort((ids, sig))
        return pa.table([pa.array(c) for c in emit(sig[order], ids[order], comp[order])], names=names)

    packed = sets.select("id", "comp", "shingles").mapInArrow(pack, "bucket int, sigs binary, owners binary, ids binary, comps binary")
    return packed.groupBy("bucket").applyInArrow(group, schema)


def _stars(sig: np.ndarray, ids: np.ndarray, comp: np.ndarray):
    first = np.searchsorted(sig, sig)
    pairs = np.unique(np.stack([ids[first], ids], 1)[ids[first] != ids], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _open_stars(sig: np.ndarray, ids: np.ndarray, comp: np.ndarray):
    """As _stars, of items that lie in another component than the least."""
    first = np.searchsorted(sig, sig)
    pairs = np.unique(np.stack([ids[first], ids], 1)[comp[first] != comp], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _open_unions(sig: np.ndarray, ids: np.ndarray, comp: np.ndarray):
    """(key, members): the items of signatures whose items lie in several components; key is the least hash of such an item, and the items of all signatures of one key are a union."""
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
    size = np.diff(np.append(start, len(sig)))
    use = np.repeat(mixed, size)
    key = np.repeat(np.minimum.reduceat(mix(ids.view(np.uint64) ^ C3), start), size)[use].view(np.int64)
    rows = np.unique(np.stack([key, ids[use]], 1), axis=0)
    start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])[: len(rows)])
    stop, data = np.append(start[1:], len(rows)).astype(np.int64), rows[:, 1].tobytes()
    return rows[start, 0], pa.array([data[8 * i : 8 * j] for i, j in zip(start.tolist(), stop.tolist(), strict=False)], pa.binary())


def _listed(lists: DataFrame) -> DataFrame:
    """(key, id): the members of lists."""

    def spread(batches):
        for batch in slices(batches, SET_BYTES, "members"):
            blobs = batch.column("members").to_pylist()
            key = np.repeat(np.asarray(batch.column("key")), [len(b) // 8 for b in blobs])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.frombuffer(b"".join(blobs), np.int64))], names=["key", "id"])

    return lists.mapInArrow(spread, "key long, id long")


def _can_be(percent: int):
    """Of pairs with sizes na, nb and sketches a0.., b0..: whether the shingles that differ can be few enough."""
    both = F.col("na") + F.col("nb")
    room = both - 2 * F.ceil(both * F.lit(percent) / F.lit(100 + percent))
    one = lambda i: F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")))
    differ = functools.reduce(lambda x, y: x + y, map(one, range(SKETCH_LONGS)))
    bits = functools.reduce(lambda x, y: x + y, map(one, range(SKETCH_LONGS, SKETCH_LONGS + BIT_LONGS)))
    return (differ <= room) & (bits <= _most_bits(percent)) & (F.abs(F.col("na") - F.col("nb")) <= room)


def _most_bits(percent: int) -> int:
    """MOST_BITS for other thresholds: 7.5 standard deviations above the mean."""
    share, n = (100 - percent) / 200, 64 * BIT_LONGS
    return MOST_BITS if percent == THRESHOLD_PERCENT else int(np.ceil(n * share + 7.5 * np.sqrt(n * share * (1 - share))))


def _side(info: DataFrame, side: str) -> DataFrame:
    """Sizes and sketches of the sets, with the columns' names for one side of a pair."""
    return info.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), *(F.col(f"s{i}").alias(f"{side}{i}") for i in range(SKETCH_LONGS + BIT_LONGS)))


def _near(percent: int):
    """_can_be for block_pairs."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a[:, 0] + b[:, 0]
        room = both + 2 * (-percent * both // (100 + percent))
        count = np.bitwise_count((a[:, 1:] ^ b[:, 1:]).view(np.uint64))
        differ, bits = count[:, :SKETCH_LONGS].sum(1, dtype=np.int64), count[:, SKETCH_LONGS:].sum(1, dtype=np.int64)
        return (differ <= room) & (bits <= _most_bits(percent)) & (np.abs(a[:, 0] - b[:, 0]) <= room)

    return near


def _alike(sets: DataFrame, info: DataFrame, percent: int):
    """verify for linkage: the pairs of sets of at least the threshold."""

    def check(batches):
        for batch in slices(batches, SET_BYTES, "sa"):
            a, b = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                n = (len(x) + len(y)) // 8
                both = np.sort(np.frombuffer(x + y, np.uint64), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok[i] = 100 * common >= percent * (n - common)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        near = materialize(pairs.join(_side(info, "a"), "a").join(_side(info, "b"), "b").where(_can_be(percent)).select("a", "b"), "near-pairs")
        needed = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id")))
        sent = sets.sparkSession.sparkContext.broadcast(Membership.of(needed, "id"))
        some = sets.select("id", "shingles").mapInArrow(lambda batches: kept(batches, sent, "id"), "id long, shingles binary")
        sa, sb = some.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), some.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        return near.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")

    return verify


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    send = docs.sparkSession.sparkContext.broadcast
    rows = materialize(_members(docs, width), "members")
    members = rows.where("doc_id is not null and id is not null").select("doc_id", "id")
    chosen = materialize(members.groupBy("id").agg(F.min("doc_id").alias("least")), "chosen")
    near = materialize(candidates(docs, send(Membership.of(chosen, "least")), percent, width), "candidates")
    sets = materialize(_sets_of(docs, send(Membership.of(near, "doc_id")), width), "sets")
    first = _signature_groups(sets.select("id", "shingles", F.col("id").alias("comp")), percent, FIRST_PARTS, _stars, "a long, b long").distinct()

    info = materialize(sets.select("id", F.col("n").cast("long").alias("n"), *INFO[1:]).distinct(), "set-sketches")

    def over_all(roots: DataFrame, emit, schema: str) -> DataFrame:
        return _signature_groups(labelled(sets.select("id", "shingles"), roots), percent, None, emit, schema)

    def open_items(roots: DataFrame) -> DataFrame:
        items = materialize(_listed(over_all(roots, _open_unions, "key long, members binary")).distinct(), "open-items")
        tiled = items.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > TILE)
        keys = items.groupBy("id").agg(F.collect_list("key").alias("keys"))
        return items.join(tiled, "key", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(1))).join(labelled(info, roots).join(keys, "id"), "id")

    verify = _alike(sets, info, percent)
    last = lambda items, tried: verify(block_pairs(items, INFO, _near(percent), keys="keys").join(tried, ["a", "b"], "left_anti"))
    roots = linked(first, lambda r: over_all(r, _open_stars, "a long, b long").distinct(), open_items, verify, last)
    twice = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    if not twice.isEmpty():
        from .components import components

        several = members.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("id").alias("b"))
        roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(several))
    named = labelled(chosen, roots)
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_set = named.join(least, "comp").select("id", "component_id")
    of_doc = members.join(of_set, "id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return rows.join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, but of each component only those of its least identifier.

    Texts travel only for rows that a Bloom filter of fixed size takes for one that goes.
    """
    found = jaccard_components(docs, id_col, text_col, percent, width)
    gone = materialize(found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct(), "near-copies")
    sent = docs.sparkSession.sparkContext.broadcast(Membership.of(gone, "gone"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("key"))
    flagged = keyed.withColumn("may", F.arrow_udf(lambda ids: may_be(sent, ids), "boolean")(F.coalesce("key", F.lit(0).cast("long"))))
    rest = flagged.where("may").join(gone.hint("merge"), F.col("key") == F.col("gone"), "left_anti")
    return flagged.where("not may").unionByName(rest).select("row.*")
