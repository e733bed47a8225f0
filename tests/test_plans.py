"""Trees, rewrites and the text form; no Spark needed."""

import pytest

from revlattice.plans import All, Constant, Difference, Down, Expr, Filter, Heads, Intersection, Nothing, Range, Rules, Union, Up, optimize, parse, to_revset
from revlattice.plans import language as L
from revlattice.plans.expr import Predicate, author, description

BASIC = Rules.basic()


def c(*revs):
    return Expr.constant(revs)


# The printed form of trees.
def revs(*numbers):
    return f"constant([{', '.join(f'Rev({n})' for n in numbers)}])"


def shown(name, *inputs):
    return "\n".join([f"{name}(", *("  " + i.replace("\n", "\n  ") + "," for i in inputs), ")"])


def step(tree, text):
    return f"{tree}\n  .{text}"


FOLDED_WALKS = [
    (parse("ancestors(ancestors(40, 3), 4)"), step(revs(40), "down(0, 5)")),
    (parse("up(up(12, 2, 5), 1, *)"), step(revs(12), "up(3, *)")),
    (parse("::(::17-)"), step(revs(17), "down(1, *)")),
    (c(8).down(2, 2).down(3, 9).down(1, 1), step(revs(8), "down(6, 12)")),
    (c(21, 4).up(1, 3).down(1, 3), step(step(revs(4, 21), "up(1, 3)"), "down(1, 3)")),
]
MADE_RANGES = [
    (parse("::90 & 33::"), shown("range", revs(33), revs(90))),
    (parse("(5 | 6):: & ::(70 | 71)"), shown("range", revs(5, 6), revs(70, 71))),
    (c(11).up().intersection(c(64).down()).filter([description("fix")]), step(shown("range", revs(11), revs(64)), 'filter([Description("fix")])')),
    (parse("up(11, 0, 8) & ::64"), shown("intersection", step(revs(11), "up(0, 8)"), step(revs(64), "down(0, *)"))),
]
CONSTANT_ALGEBRA = [
    (parse("(14 | 3 | 9) & (9 | 14 | 2)"), revs(9, 14)),
    (parse("(14 | 3) & (3 | 50)"), revs(3)),
    (parse("25 | (31 | 25) | none()"), revs(25, 31)),
    (parse("6 & 7 & all()"), "none()"),
    (c(55, 10, 55), revs(10, 55)),
    (All().union(c(77)), "all()"),
    (Union(()), "none()"),
    (Intersection(()), "all()"),
    (All(), "all()"),
]
SHARED_FILTERS = [
    (parse('12:: & author("Ines") & description("merge")'), step(step(revs(12), "up(0, *)"), 'filter([Author("Ines"), Description("merge")])')),
    (parse('(41 & author("Ola")) | (19 & author("Ola")) | (7 & author("Ola"))'), step(revs(7, 19, 41), 'filter([Author("Ola")])')),
    (c(30).filter([]), revs(30)),
    (c(30).filter([author("Ines")]).filter([description("x")]), step(revs(30), 'filter([Description("x"), Author("Ines")])')),
]
TREES = [*FOLDED_WALKS, *MADE_RANGES, *CONSTANT_ALGEBRA, *SHARED_FILTERS]


@pytest.mark.parametrize("expr,tree", TREES)
def test_trees_of_basic_rules(expr, tree):
    assert optimize(expr, BASIC).tree() == tree


def test_rules_can_be_left_out():
    assert optimize(c(0).up().up(), Rules.basic(fold_up_up=False)).tree() == "constant([Rev(0)])\n  .up(0, *)\n  .up(0, *)"
    nested = Union((Union((c(0).up(), c(1).down())), c(2).up(1, 1)))
    assert len(optimize(nested, Rules.basic()).inputs) == 3
    assert len(optimize(nested, Rules.basic(flatten_union=False)).inputs) == 2


def test_range_takes_only_its_two_terms():
    e = optimize(Intersection((c(0).up(), c(0).up(1, 1), c(9).down())), BASIC)
    assert isinstance(e, Intersection) and set(e.inputs) == {c(0).up(1, 1), Range(c(0), c(9))}
    e = optimize(Intersection((c(0).up(), c(1).up(), c(9).down())), BASIC)
    assert not any(isinstance(i, Range) for i in e.inputs)


def test_further_rules():
    assert optimize(Nothing().up()) == Nothing()
    assert optimize(c(1).up(3, 2)) == Nothing()
    assert optimize(Range(c(), c(1))) == Nothing()
    assert optimize(c(1).up(0, 0)) == c(1)
    assert optimize(All().down(0, 4)) == All()
    assert optimize(c(1).down().union(c(2).down())) == c(1, 2).down()
    assert optimize(c(1).down(0, 3).union(c(2).down(0, 3))) == c(1, 2).down(0, 3)
    assert optimize(c(1).down(0, 3).union(c(2).down())) != c(1, 2).down()
    assert optimize(c(1, 2).difference(c(2))) == c(1)
    assert optimize(c(1).up().difference(c(1).up())) == Nothing()
    assert optimize(c(1).up().intersection(c(1).up())) == c(1).up()
    assert optimize(c().filter([author("x")])) == Nothing()
    assert optimize(c(1).up(2, 1).up(0, None)) == Nothing()


def test_text_forms():
    assert parse("5") == c(5)
    assert parse("a" if False else "::5") == Down(c(5))
    assert parse("5::") == Up(c(5))
    assert parse("5::7") == Range(c(5), c(7))
    assert parse("::") == All()
    assert parse("5-") == Down(c(5), 1, 1)
    assert parse("5--+") == Up(Down(Down(c(5), 1, 1), 1, 1), 1, 1)
    assert parse("::5-") == Down(Down(c(5), 1, 1))
    assert parse("1 | 2 & 3") == Union((c(1), Intersection((c(2), c(3)))))
    assert parse("1 & 2 ~ 3 & 4") == Intersection((Difference(Intersection((c(1), c(2))), c(3)), c(4)))
    assert parse("~1 & 2") == Intersection((Difference(All(), c(1)), c(2)))
    assert parse("heads(1::)") == Heads(Up(c(1)))
    assert parse("ancestors(1, 3)") == Down(c(1), 0, 2)
    assert parse("descendants(1)") == Up(c(1))
    assert parse("parents(1) | children(2)") == Union((Down(c(1), 1, 1), Up(c(2), 1, 1)))
    assert parse("none() | all()") == Union((Nothing(), All()))
    assert parse(r'author(exact-i:"a\"b")') == Filter(All(), (Predicate("author", 'a"b', "exact-i"),))
    assert parse("description('x')") == Filter(All(), (description("x"),))
    assert parse("author_name(foo)") == Filter(All(), (Predicate("author_name", "foo"),))


@pytest.mark.parametrize(
    "text,error",
    [
        ("4294967296", L.InvalidLiteral), ("main", L.UnsupportedCommitRef), ("@", L.UnsupportedCommitRef), ("1..2", L.UnsupportedExpression), ("..2", L.UnsupportedExpression), ("latest(1)", L.UnsupportedExpression), ("roots(1)", L.UnsupportedExpression),
        ("files(1)", L.UnsupportedFilter), ("author_date(x)", L.UnsupportedFilter), ('author(glob:"x*")', L.UnsupportedStringPattern), ('description(regex:"x")', L.UnsupportedStringPattern),
        ("1 |", L.SyntaxProblem), ("(1", L.SyntaxProblem), ("1 2", L.SyntaxProblem), ("", L.SyntaxProblem), ("1::2::3", L.SyntaxProblem), ("1 $ 2", L.SyntaxProblem), (f"ancestors(1, {2**64})", L.GenerationOutOfRange), ("ancestors(1, 0)", L.GenerationOutOfRange), ("descendants(3, 0)", L.GenerationOutOfRange),
    ],
)
def test_errors(text, error):
    with pytest.raises(error):
        parse(text)


TEXTS = [
    "1", "1 | 2", "1 & 2 & 3", "1 & (2 & 3)", "1 | (2 | 3)", "1 ~ 2 ~ 3", "1 ~ (2 ~ 3)", "(1 | 2) & 3", "::1", "1::", "(1 | 2)::", "::(1::)", "1::2", "(1::2)::3", "1-", "(1::)-", "::1-+", "~1", "~(1 | 2)", "1 & ~2", "heads(1::)", "none()", "all()",
    "ancestors(1, 3)", "up(1, 2, *)", "down(1 | 2, 2, 5)", 'author("a")', '1 & author(exact:"é\\n\\"")', 'description("x y") | author_email("z")', 'heads(1 & author("q")) ~ ::2',
]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    tree = parse(text)
    assert parse(to_revset(tree)) == tree


@pytest.mark.parametrize("expr", [c(1, 2).up(), c(1).filter([author("a"), description("b")]), Intersection((c(1), c(2).up(), c(3).down())), Heads(c(1).up(), True), Union((c(1),)), Intersection(())])
def test_round_trip_of_built_trees_keeps_meaning(expr):
    if isinstance(expr, Heads):
        assert to_revset(expr) == "1:: ~ down(1::, 1, *)"
    else:
        assert optimize(parse(to_revset(expr))) == optimize(expr)
