"""Connected groups of items under a verified likeness, from candidate keys, without all pairs of a key's items.

Items that share a key are candidates. A first round checks every item only against the least item of each of its keys.
Keys whose items then lie in one component need nothing more. For the others a second round repeats that over all keys, and
a third checks the pairs that still lie in two components: no link that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import bucket_count, materialize
from .text import release

#: Items of a key that are compared at once; the items of a larger key are dealt to tiles of about that size.
TILE = 2048
#: Pairs that are verified at once.
AT_ONCE = 2048


def labelled(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """The keys' items with their component so far."""
    named = roots.select(F.col("node").alias("id"), F.col("root").alias("comp"))
    return keys.join(named, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def mixed_keys(keys: DataFrame) -> DataFrame:
    """Of labelled keys those whose items lie in several components, with n, the number of their rows."""
    open_keys = keys.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n_rows")).where("lo < hi")
    return keys.join(open_keys.select("key", "n_rows"), "key")


def block_pairs(
    items: DataFrame, info: list[str], near: Callable[[np.ndarray, np.ndarray], np.ndarray], alike: Callable[[list, list], np.ndarray] | None = None, payload: str | None = None, keys: str | None = None
) -> DataFrame:
    """(a, b): pairs of a key's items that lie in two components and that near lets pass, each pair once.

    items: (key, id, comp, n_rows, then the long columns `info`); near: from two arrays of info, a row for each pair, to a
    mask. A task compares whole blocks, so that no row is made for a pair that near refuses. The items of a key of over TILE
    rows are dealt to tiles; each pair of tiles is a block of its own, wherever it lands.

    With keys (a column of all keys of an item) a pair is looked at only under the least key that both items have. With alike
    (a mask from two lists of the column `payload`) the pairs are verified there too, and not once links of the block have
    made the two components one.
    """
    buckets = bucket_count(items.sparkSession)
    more = [c for c in (payload, keys) if c]
    tiles = F.ceil(F.col("n_rows") / TILE).cast("int")
    own = F.pmod(F.xxhash64("id"), tiles).cast("int").alias("own")
    dealt = items.select("key", "id", "comp", *info, *more, own, F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(block.alias("block"), "key", "id", "comp", F.col("own").cast("long").alias("own"), (F.col("own") == F.col("other")).cast("long").alias("alone"), *info, *more)

    def compare(table: pa.Table) -> pa.Table:
        block, key, ids, comp, own, alone, *rest = (np.asarray(table.column(c)) for c in ("block", "key", "id", "comp", "own", "alone", *info))
        order = np.lexsort((ids, own, block))
        block, key, ids, comp, own, alone = (x[order] for x in (block, key, ids, comp, own, alone))
        rest = np.stack([c[order] for c in rest], 1) if rest else np.zeros((len(ids), 0), np.int64)
        held = table.column(payload).take(pa.array(order)).to_pylist() if alike else None
        lists = table.column(keys).combine_chunks().take(pa.array(order)) if keys else None
        cuts, every = (np.asarray(lists.offsets), np.asarray(lists.values)) if keys else (None, None)
        named = cache(lambda x: frozenset(every[cuts[x] : cuts[x + 1]].tolist()))  # of items that a near pair has
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        def verified(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            open_ = comp[i] != comp[j]
            i, j = i[open_], j[open_]
            ok = alike([held[x] for x in i], [held[x] for x in j])
            i, j = i[ok], j[ok]
            for x, y in zip(comp[i].tolist(), comp[j].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(i):
                names, at = np.unique(comp, return_inverse=True)
                comp[:] = np.array([find(c) for c in names.tolist()])[at]
            return i, j

        left, shift, found, wait, waits = np.arange(len(block)), 1, [], [], 0
        while len(left):
            left = left[left + shift < len(block)]
            left = left[block[left + shift] == block[left]]
            i = left[(comp[left] != comp[left + shift]) & ((own[left] != own[left + shift]) | (alone[left] == 1))]
            i = i[near(rest[i], rest[i + shift])] if len(i) else i
            if keys and len(i):
                i = i[np.array([min(named(x) & named(x + shift)) == key[x] for x in i.tolist()])]
            if len(i):
                wait.append((i, i + shift))
                waits += len(i)
            shift += 1
            if wait and (waits >= AT_ONCE or not len(left)):
                i, j = (np.concatenate(x) for x in zip(*wait, strict=True))
                wait, waits = [], 0
                if alike:
                    i, j = verified(i, j)
                found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        release()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy(F.pmod("block", F.lit(buckets)).alias("bucket")).applyInArrow(compare, "a long, b long").distinct()


def linked(first_pairs: DataFrame, open_pairs: Callable[[DataFrame], DataFrame] | None, open_keys: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], last: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of every item that is linked to another.

    first_pairs: (a, b) of the first round. open_pairs: from the components so far to the pairs of the second, over the keys
    whose items lie in several; None where the first round had all keys. open_keys: from the components after that to such keys, in a form of the caller's. verify: keeps
    the pairs (a, b) that are alike. last: from those keys and the pairs tried so far to the links between components.
    """
    tried = materialize(first_pairs, "pairs")
    links = materialize(verify(tried), "links")
    roots = components(links)
    if open_pairs:
        again = materialize(open_pairs(roots).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = materialize(verify(again), "links")
        tried = tried.unionByName(again)
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
    mixed = materialize(open_keys(roots), "open-keys")
    found = materialize(last(mixed, tried), "links")
    return roots if found.isEmpty() else components(links.unionByName(found))
