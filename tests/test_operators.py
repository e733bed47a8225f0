"""Operators on small cases, with the results written out."""

import pytest
from pyspark.sql import functions as F

from revlattice import operators as ops
from revlattice.operators import reach


def revs(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "rev long")


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "child long, parent long")


def bag(df):
    return sorted(r.rev for r in df.collect())


def newest(df):
    return [r.rev for r in ops.rows(ops.newest_first(df))]


def test_constant_and_scan(spark):
    assert newest(ops.constant(spark, [2, 5, 3])) == [5, 3, 2]
    assert newest(ops.constant(spark, [])) == []
    assert newest(ops.scan(revs(spark, 5, 4, 3, 2, 1), "rev", 4, 2)) == [4, 3, 2]
    assert bag(ops.scan(revs(spark, 5, 4, 3, 2, 1), "rev", 4)) == [4, 5]


def test_set_operators(spark):
    a, b = revs(spark, 5, 3, 1), revs(spark, 4, 3, 2)
    assert newest(ops.union(a, b)) == [5, 4, 3, 2, 1]
    assert newest(ops.intersection(revs(spark, 5, 4, 3, 1), revs(spark, 6, 4, 3, 2))) == [4, 3]
    assert newest(ops.difference(revs(spark, 5, 4, 3, 2, 1), revs(spark, 6, 4, 2))) == [5, 3, 1]
    assert bag(ops.difference(revs(spark, 5, 5), revs(spark, 5))) == []
    assert bag(ops.union(revs(spark, 1, 1), revs(spark, 1))) == [1]
    assert bag(ops.intersection(revs(spark, 1, 1, 2), revs(spark, 1, 1))) == [1]


def test_relational(spark):
    left = spark.createDataFrame([(3, "a"), (2, "b"), (2, "c"), (1, "d")], "key long, lv string")
    right = spark.createDataFrame([(2, 10), (2, 20), (1, 30), (0, 40)], "key long, rv long")
    got = sorted(tuple(r) for r in ops.merge_join(left, right).collect())
    assert got == [(1, "d", 30), (2, "b", 10), (2, "b", 20), (2, "c", 10), (2, "c", 20)]
    five = revs(spark, 5, 4, 3, 2, 1)
    assert newest(ops.keep(five, "rev % 2 = 0")) == [4, 2]
    assert sorted(r.x for r in ops.project(five, (F.col("rev") % 2).alias("x")).collect()) == [0, 0, 1, 1, 1]
    assert [r.rev for r in ops.reverse(ops.newest_first(revs(spark, 5, 3, 1))).collect()] == [1, 3, 5]
    assert sorted(r.rev for r in ops.relational.mapped(five, lambda x: x.assign(rev=x.rev * 2), "rev long").collect()) == [2, 4, 6, 8, 10]


def test_value_range():
    v = ops.ValueRange
    assert v.of(3).hull(v.of(7)) == v(3, 7)
    assert v(1, 5).intersect(v(4, 9)) == v(4, 5)
    assert v(1, 2).intersect(v(4, 9)).is_empty
    assert v.nothing().hull(v(1, 2)) == v(1, 2)
    assert v(3, 4).open_above() == v(3) and v(3, 4).open_below() == v(None, 4)
    assert v(None, 4).hull(v(2, None)) == v()


@pytest.mark.parametrize("local", [True, False])
def test_closure(spark, local):
    # One edge breaks the order of revisions; the seeds don't reach it.
    e = edges(spark, (1, 0), (2, 1), (3, 2), (4, 5))
    assert newest(ops.closure(revs(spark, 3), e, local=local)) == [3, 2, 1, 0]
    assert bag(ops.closure(revs(spark, 3, 3), edges(spark, (3, 2)), local=local)) == [2, 3]
    assert bag(ops.closure(revs(spark), e, local=local)) == []
    e = edges(spark, (5, 4), (5, 1), (4, 3))
    assert bag(ops.intersection(ops.closure(revs(spark, 5), e, local=local), revs(spark, 3, 1))) == [1, 3]
    assert bag(ops.descendants(revs(spark, 1), e, local=local or None)) == [1, 5]


def test_deep_chain(spark):
    e = spark.range(1, 2001).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    assert newest(ops.ancestors(revs(spark, 2000), e)) == list(range(2000, -1, -1))


def test_rounds_beyond_literals(spark, monkeypatch):
    monkeypatch.setattr(reach, "LITERALS", 3)
    monkeypatch.setattr(reach, "GATHER", 2)
    e = edges(spark, *[(i, i // 2) for i in range(1, 64)], *[(i, i // 3) for i in range(2, 64)])
    want = [i for i in range(64) if i >= 5 and _reaches(i, 5)]
    assert bag(ops.descendants(revs(spark, 5), e, local=None)) == want
    assert bag(ops.closure(revs(spark, *range(1, 9)), e, "parent", "child", False)) == list(range(1, 64))


def _reaches(i, goal):
    return i == goal or i > goal and (_reaches(i // 2, goal) or _reaches(i // 3, goal))


@pytest.mark.parametrize("most", [reach.LOCAL_EDGES, 0])
def test_dag_range(spark, monkeypatch, most):
    monkeypatch.setattr(reach, "LOCAL_EDGES", most)
    e = edges(spark, (2, 1), (3, 2), (4, 2), (5, 3), (5, 4), (9, 8))
    assert bag(ops.dag_range(revs(spark, 2), revs(spark, 5), e)) == [2, 3, 4, 5]
    assert bag(ops.dag_range(revs(spark, 1, 3), revs(spark, 4), edges(spark, (2, 1), (4, 2), (4, 3)))) == [1, 2, 3, 4]
    assert bag(ops.dag_range(revs(spark, 5), revs(spark, 2), edges(spark, (5, 4), (3, 2)))) == []
    assert bag(ops.dag_range(revs(spark), revs(spark, 2), e)) == []
    assert bag(ops.dag_range(revs(spark, 1), revs(spark, 5, 3), edges(spark, (2, 1), (5, 1), (3, 2)))) == [1, 2, 3, 5]
    assert bag(ops.dag_range(revs(spark, 4), revs(spark, 4), e)) == [4]


def test_heads_and_roots(spark):
    e = edges(spark, (6, 5), (5, 4), (5, 3), (4, 2))
    assert newest(ops.heads(revs(spark, 5, 4, 3, 2, 1), e)) == [5, 1]
    assert bag(ops.roots(revs(spark, 5, 4, 3, 2, 1), e)) == [1, 2, 3]
    chain = edges(spark, (5, 4), (4, 2))
    assert bag(ops.heads(revs(spark, 5, 2), chain)) == [2, 5]
    assert bag(ops.heads(revs(spark, 5, 2), chain, transitive=True)) == [5]
    assert bag(ops.roots(revs(spark, 5, 2), chain, transitive=True)) == [2]
    assert sorted(tuple(r) for r in ops.parents_of(revs(spark, 5, 1), e).collect()) == [(5, 3), (5, 4)]


@pytest.mark.parametrize("local", [True, None])
def test_bounded_walks(spark, local):
    chain = edges(spark, (1, 0), (2, 1))
    once = ops.descendants(revs(spark, 0), chain, 0, 1, local)
    assert bag(ops.descendants(once, chain, 1, 1, local)) == bag(ops.descendants(revs(spark, 0), chain, 1, 2, local)) == [1, 2]
    assert bag(ops.descendants(revs(spark, 0), chain, 3, 2, local)) == []
    assert bag(ops.ancestors(revs(spark, 2), chain, 1, None, local)) == [0, 1]
    assert bag(ops.ancestors(revs(spark, 2), chain, 5, None, local)) == []


def test_index_is_sorted_in_ranges(spark):
    parts = ops.index(edges(spark, *[(i * 7 % 100, 0) for i in range(1, 60)]), "child", partitions=3).rdd.glom().collect()
    flat = [r.child for p in parts for r in p]
    assert flat == sorted(flat)
