"""Queries end to end: a worked example, random graphs against plain reachability, the registered queries' shape."""

import random

import pytest

from revlattice.plans import All, Constant, Difference, Down, Expr, Filter, Heads, Intersection, Nothing, Range, Union, Up
from revlattice.plans.expr import author, description
from revlattice.sources import RevGraph, read_graph, write_graph

BOOK = [(1, 0), (2, 0), (3, 0), (4, 1), (4, 2), (5, 2), (5, 3), (6, 3), (7, 4), (7, 5), (8, 5), (8, 6), (9, 7), (9, 8), (10, 8)]


def graph(spark, n, pairs, commits=None):
    frame = commits and spark.createDataFrame(commits, "rev long, author_name string, author_email string, description string")
    return RevGraph(spark.createDataFrame([(i,) for i in range(n)], "rev long"), spark.createDataFrame(pairs, "child long, parent long"), frame, validate=True)


@pytest.mark.parametrize(
    "text,want",
    [
        ("5", {5}), ("2 | 6", {2, 6}), ("(2|6) & (7|6)", {6}), ("(2|6) ~ 6", {2}), ("::7", {0, 1, 2, 3, 4, 5, 7}), ("2::", {2, 4, 5, 7, 8, 9, 10}), ("::(1|5)", {0, 1, 2, 3, 5}), ("(1|5)::", {1, 4, 5, 7, 8, 9, 10}), ("2::7", {2, 4, 5, 7}),
        ("heads(all())", {9, 10}), ("9--", {4, 5, 6}), ("0++", {4, 5, 6}), ("0:: & 0+ & ::9", {1, 2, 3}), ("~(0::8)", {1, 4, 7, 9, 10} - {1}), ("none()", set()), ("ancestors(9, 2)", {9, 7, 8}),
    ],
)
def test_worked_example(spark, text, want):
    if text == "~(0::8)":
        want = set(range(11)) - {0, 2, 3, 5, 6, 8}
    assert set(graph(spark, 11, BOOK).revisions(text)) == want


def test_order_of_results(spark):
    g = graph(spark, 4, [(1, 0)])
    assert g.revisions("3") == [3]
    assert g.revisions("3|2") == [3, 2]
    plain = Union((Constant((3,)), Constant((2,))))
    assert sorted(r.rev for r in g.evaluate(plain, optimized=False).collect()) == [2, 3]


def test_metadata(spark):
    commits = [(0, "Justin", "j@x.org", "first"), (1, "Hamlet", "ham@justin.net", "Second thing"), (2, None, "j@x.org", None)]
    g = graph(spark, 3, [(1, 0), (2, 1)], commits)
    assert g.revisions('author("Justin")') == [0]
    assert g.revisions('author(substring-i:"justin")') == [1, 0]
    assert g.revisions('author_email(exact:"j@x.org")') == [2, 0]
    assert g.revisions('description(exact-i:"second THING")') == [1]
    assert g.revisions('all() ~ description("first")') == [2, 1]
    assert g.revisions('::2 & author("j@") & description("irs")') == [0]
    assert graph(spark, 2, [(1, 0)]).revisions('author("x")') == []


def test_bad_graphs_are_refused(spark):
    with pytest.raises(ValueError):
        graph(spark, 3, [(1, 2)])
    with pytest.raises(ValueError):
        RevGraph(spark.createDataFrame([(1,), (1,)], "rev long"), spark.createDataFrame([(1, 0)], "child long, parent long"), validate=True)


def test_written_graph_reads_back(spark, tmp_path):
    g = graph(spark, 11, BOOK)
    write_graph(g, str(tmp_path))
    assert read_graph(spark, str(tmp_path)).revisions("2::7") == [7, 5, 4, 2]


class Plain:
    """Sets by definition, in Python."""

    def __init__(self, n, pairs, names):
        self.n, self.pairs, self.names = n, pairs, names

    def step(self, s, up):
        return {c if up else p for c, p in self.pairs if (p if up else c) in s}

    def walk(self, s, up, lo, hi):
        out, level = set(), set(s)
        for k in range(self.n + lo + 1 if hi is None else hi + 1):
            if k >= lo:
                out |= level
            level = self.step(level, up)
        return out

    def run(self, e):
        match e:
            case Nothing():
                return set()
            case All():
                return set(range(self.n))
            case Constant(r):
                return set(r)
            case Up(x, lo, hi):
                return self.walk(self.run(x), True, lo, hi)
            case Down(x, lo, hi):
                return self.walk(self.run(x), False, lo, hi)
            case Range(a, b):
                return self.walk(self.run(a), True, 0, None) & self.walk(self.run(b), False, 0, None)
            case Union(xs):
                return set().union(*map(self.run, xs))
            case Intersection(xs):
                return set(range(self.n)).intersection(*map(self.run, xs)) if xs else set(range(self.n))
            case Difference(a, b):
                return self.run(a) - self.run(b)
            case Heads(x, _):
                s = self.run(x)
                return s - self.step(s, False)
            case Filter(x, ps):
                return {r for r in self.run(x) if all(p.text in self.names[r] for p in ps)}


def random_expr(r, n, depth):
    if depth == 0:
        return r.choice([All(), Expr.constant(r.sample(range(n), r.randint(0, min(3, n)))), Expr.constant([r.randrange(n)])])
    x = lambda: random_expr(r, n, depth - 1)
    lo = r.choice([0, 0, 0, 1, 2])
    hi = r.choice([None, None, lo, lo + 1, lo + 2, lo - 1])
    if hi is not None and hi < 0:
        hi = 0
    return r.choice([
        lambda: x().up(lo, hi), lambda: x().down(lo, hi), lambda: Range(x(), x()), lambda: Union((x(), x(), x())), lambda: Intersection((x(), x())), lambda: Intersection((x().up(), x().down(), x())),
        lambda: Difference(x(), x()), lambda: Heads(x()), lambda: x().filter([author(r.choice("ab"))]), lambda: Union((x().filter([author("a")]), x().filter([author("a"), author("b")]))),
    ])()


def test_random_rewrites_keep_the_meaning():
    """In Python alone: thousands of trees, all rules."""
    r = random.Random(7)
    for _ in range(3000):
        n = r.randint(2, 9)
        pairs = list({(c, r.randrange(c)) for c in range(1, n) for _ in range(r.randint(0, 2))})
        plain = Plain(n, pairs, {i: r.choice(["a", "b", "ab", ""]) for i in range(n)})
        e = random_expr(r, n, r.randint(1, 3))
        assert plain.run(e.optimize()) == plain.run(e), e


def test_random_queries(spark):
    r = random.Random(11)
    n = 14
    pairs = sorted({(c, r.randrange(c)) for c in range(1, n) for _ in range(2)})
    names = {i: r.choice(["a", "b", "ab", ""]) for i in range(n)}
    g = graph(spark, n, pairs, [(i, names[i], names[i], description("").text) for i in range(n)])
    g.revs, g.edges, g.commits = (d.cache() for d in (g.revs, g.edges, g.commits))
    plain = Plain(n, pairs, names)
    for _ in range(25):
        e = random_expr(r, n, 2)
        got = [x.rev for x in g.evaluate(e).collect()]
        assert sorted(got) == sorted(plain.run(e)), e
