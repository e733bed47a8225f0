"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; a small flow network routes each
pattern's tokens to the quotas of its sources, where the e-th repetition of a pattern's tokens costs more than the one
before (convex costs), so that repetition is spread evenly and used only where a quota needs it. Each pattern then takes
whole passes over its documents and, for the rest, documents in the order of a seeded hash, up to a boundary that
distributed histograms of that hash locate; one more document, that of the size nearest to what is then missing, fills up.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are taken
as often as their pattern's whole passes; rows whose identifier, source and text are all the same fall together on one side
of the boundary; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20240817
#: Bins of the hash that one pass over the sizes refines by, as a power of two.
BIN_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def min_cost_flow(arcs: list[tuple[int, int, int, int]], nodes: int, source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a maximal flow of least cost, by successive shortest paths with potentials. Costs are not negative."""
    to, cap, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    potential = [0] * nodes
    while True:
        far, via, heap = [None] * nodes, [-1] * nodes, [(0, source)]
        far[source] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                if cap[e] > 0:
                    n = d + cost[e] + potential[a] - potential[to[e]]
                    if far[to[e]] is None or n < far[to[e]]:
                        far[to[e]], via[to[e]] = n, e
                        heapq.heappush(heap, (n, to[e]))
        if far[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        potential = [p + (f if f is not None else 0) for p, f in zip(potential, far, strict=True)]
        push, at = None, sink
        while at != source:
            e = via[at]
            push, at = cap[e] if push is None else min(push, cap[e]), to[e ^ 1]
        at = sink
        while at != source:
            e = via[at]
            cap[e] -= push
            cap[e ^ 1] += push
            at = to[e ^ 1]


def routed(patterns: dict[tuple, int], quotas: dict[object, int], most: int) -> dict[tuple, dict[object, int]]:
    """Tokens that each pattern (a tuple of sources, with its total size) gives to each source's quota, each pattern at most `most` times over. The e-th repetition costs e squared."""
    names, keys = list(quotas), list(patterns)
    sink, arcs, give = 1 + len(keys) + len(names), [], []
    for i, p in enumerate(keys):
        arcs += [(0, 1 + i, patterns[p], e * e) for e in range(1, most + 1)]
    for i, p in enumerate(keys):
        for s in p:
            give.append((len(arcs), p, s))
            arcs.append((1 + i, 1 + len(keys) + names.index(s), most * patterns[p], 0))
    arcs += [(1 + len(keys) + j, sink, quotas[s], 0) for j, s in enumerate(names)]
    flow = min_cost_flow(arcs, sink + 1, 0, sink)
    out: dict[tuple, dict[object, int]] = {p: {} for p in keys}
    for k, p, s in give:
        out[p][s] = flow[k]
    return out


def capped_targets(sizes: dict[object, int], weights: dict[object, float], most: int = MAX_REPEATS) -> dict[object, float]:
    """Shares of the total size by weight; what lies above `most` times a source's size is shared out again by weight."""
    left, free, out = float(sum(sizes.values())), dict(weights), {}
    while free:
        total = sum(free.values())
        share = {s: left * w / total for s, w in free.items()}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            del free[s]
    return out


def source_order(names) -> list:
    """By code point, null last."""
    return sorted(names, key=lambda s: (s is None, s or ""))


def sized(docs: DataFrame, sources: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, size, h) of each document: pattern is the sorted array of its sources, h a seeded hash, not negative."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), sources.alias("pattern"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), seeded_hash(id_col, text_col).alias("h"))


def seeded_hash(id_col: str, text_col: str) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), 1)


def _boundaries(rows: DataFrame, want: dict[tuple, int]) -> dict[tuple, tuple[int, int]]:
    """For each pattern the largest bound so that documents with h below it hold at most want[pattern] tokens, and what they hold; by refining histograms of h."""
    spark = rows.sparkSession
    state = {p: (0, 63, 0) for p in want}  # lower bound, free bits above it, tokens below it
    while any(bits for _, bits, _ in state.values()):
        table = spark.createDataFrame([(list(p), lo, max(0, bits - BIN_BITS), hi) for p, (lo, bits, _) in state.items() if bits for hi in [lo + (1 << bits) - 1]], "pattern array<string>, lo long, shift int, hi long")
        near = rows.join(F.broadcast(table), "pattern").where("h between lo and hi")
        bins = near.groupBy("pattern", F.expr("shiftright(h - lo, shift)").alias("bin")).agg(F.sum("size").alias("tokens")).collect()
        by: dict[tuple, list] = {}
        for r in bins:
            by.setdefault(tuple(r.pattern), []).append((r.bin, r.tokens))
        for p, (lo, bits, below) in state.items():
            if not bits:
                continue
            left, shift, cut = want[p] - below, max(0, bits - BIN_BITS), None
            for b, tokens in sorted(by.get(p, [])):
                if tokens > left:
                    cut = b
                    break
                left -= tokens
            if cut is None:
                state[p] = (lo + (1 << bits), 0, want[p] - left)
            else:
                state[p] = (lo + (cut << shift), shift, want[p] - left)
    return {p: (lo, below) for p, (lo, _, below) in state.items()}


def mix_plan(docs: DataFrame, quotas: Callable[[dict[tuple, int]], dict[object, float]], sources: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): (id, pattern, size, h) of each document, and for each pattern (passes, below, filler).

    quotas: from the total size of each pattern to the tokens wanted of each source. The patterns are expected to be few
    (their totals and the flow network are held by the driver); documents never are. sources: the sorted array of the
    sources that a document belongs to; [source] unless given.
    """
    spark = docs.sparkSession
    rows = materialize(sized(docs, _sources(sources), id_col, text_col), "mix-sizes")
    totals = {tuple(r.pattern): r.total for r in rows.groupBy("pattern").agg(F.sum("size").alias("total")).collect()}
    flow = routed(totals, {s: round(q) for s, q in quotas(totals).items()}, most)
    take = {p: sum(flow[p].values()) for p in totals}
    passes = {p: min(most, take[p] // n) if (n := totals[p]) else 1 for p in totals}
    part = {p: rest for p in totals if (rest := take[p] - passes[p] * totals[p]) > 0}
    bound = {p: (0, 0) for p in totals} | (_boundaries(rows, part) if part else {})
    filler: dict[tuple, int] = {}
    if part:
        gaps = spark.createDataFrame([(list(p), bound[p][0], part[p] - bound[p][1]) for p in part], "pattern array<string>, lo long, gap long")
        near = rows.join(F.broadcast(gaps), "pattern").where("h >= lo").groupBy("pattern", "h", "gap").agg(F.sum("size").alias("tokens"))
        near = near.groupBy("pattern", "gap").agg(F.min(F.struct(F.abs(F.col("tokens") - F.col("gap")).alias("off"), F.col("h").alias("h"))).alias("best"))
        filler = {tuple(r.pattern): r.best.h for r in near.collect() if r.best.off < r.gap}
    plan = spark.createDataFrame([(list(p), passes[p], bound[p][0], filler.get(p, -1)) for p in totals], "pattern array<string>, passes long, below long, filler long")
    return rows, plan


def _sources(sources: F.Column | None) -> F.Column:
    return F.array("source") if sources is None else sources


def with_repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with pattern and h) and how often the mix takes each. The plan has a row for each pattern."""
    chosen = (F.col("h") < F.col("below")) | (F.col("h") == F.col("filler"))
    return rows.join(F.broadcast(plan), "pattern").withColumn("repeats", F.col("passes") + chosen.cast("long")).drop("passes", "below", "filler")


def mix_sources(docs: DataFrame, quotas: Callable[[dict[tuple, int]], dict[object, float]], sources: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_REPEATS) -> DataFrame:
    """One row per document: (id, pattern, size, h, repeats): how often the mix takes it; see mix_plan."""
    return with_repeats(*mix_plan(docs, quotas, sources, id_col, text_col, most)).select("id", "pattern", "size", "h", "repeats")


def mixture(docs: DataFrame, quotas: Callable[[dict[tuple, int]], dict[object, float]], sources: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: the rows of docs, with all their columns, each as often as the mix takes it. Texts don't travel."""
    _, plan = mix_plan(docs, quotas, sources, id_col, text_col, most)
    whole = docs.select(F.struct(*docs.columns).alias("row"), _sources(sources).alias("pattern"), seeded_hash(id_col, text_col).alias("h"))
    taken = with_repeats(whole, plan).where("repeats > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("row.*")


def quotas_by_weight(weights: tuple[float, ...] = WEIGHTS, most: int = MAX_REPEATS, held: dict | None = None) -> Callable[[dict[tuple, int]], dict[object, float]]:
    """For documents of one source each: the sources in order weigh `weights`, repeating, and share the total size. held gets sizes and targets."""

    def quotas(totals: dict[tuple, int]) -> dict[object, float]:
        sizes = {p[0]: n for p, n in totals.items()}
        targets = capped_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(source_order(sizes))}, most)
        if held is not None:
            held.update(sizes=sizes, targets=targets)
        return targets

    return quotas
