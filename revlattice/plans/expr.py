"""The logical tree of a query over sets of revisions. Nodes are immutable and compare by structure."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

MOST_REV = 2**32 - 1


@dataclass(frozen=True)
class Predicate:
    """A condition on a revision's metadata. field: author (name or e-mail), author_name, author_email or description."""

    field: str
    text: str
    kind: str = "substring"

    FIELDS = ("author", "author_name", "author_email", "description")
    KINDS = ("exact", "exact-i", "substring", "substring-i")

    def __post_init__(self):
        if self.field not in self.FIELDS or self.kind not in self.KINDS:
            raise ValueError(f"no predicate {self.field} {self.kind}")

    def __str__(self) -> str:
        name = self.field.title().replace("_", "")
        return f"{name}({'' if self.kind == 'substring' else self.kind + ':'}{json.dumps(self.text, ensure_ascii=False)})"


def author(text: str, kind: str = "substring") -> Predicate:
    return Predicate("author", text, kind)


def description(text: str, kind: str = "substring") -> Predicate:
    return Predicate("description", text, kind)


class Expr:
    """Common to all nodes: the fluent builders and the printed tree."""

    @staticmethod
    def constant(revs) -> Constant:
        return Constant(tuple(int(r) for r in revs))

    def up(self, lo: int = 0, hi: int | None = None) -> Up:
        return Up(self, lo, hi)

    def down(self, lo: int = 0, hi: int | None = None) -> Down:
        return Down(self, lo, hi)

    def union(self, other: Expr) -> Union:
        return Union((self, other))

    def intersection(self, other: Expr) -> Intersection:
        return Intersection((self, other))

    def difference(self, other: Expr) -> Difference:
        return Difference(self, other)

    def heads(self, transitive: bool = False) -> Heads:
        return Heads(self, transitive)

    def filter(self, predicates) -> Filter:
        return Filter(self, tuple(predicates))

    @staticmethod
    def union_all(inputs) -> Union:
        return Union(tuple(inputs))

    @staticmethod
    def intersection_all(inputs) -> Intersection:
        return Intersection(tuple(inputs))

    @staticmethod
    def range(roots: Expr, heads: Expr) -> Range:
        return Range(roots, heads)

    def optimize(self, rules=None) -> Expr:
        from .rules import Rules, optimize

        return optimize(self, rules or Rules())

    def children(self) -> tuple[Expr, ...]:
        out: list[Expr] = []
        for f in fields(self):
            value = getattr(self, f.name)
            out += [value] if isinstance(value, Expr) else [x for x in value if isinstance(x, Expr)] if isinstance(value, tuple) else []
        return tuple(out)

    def tree(self) -> str:
        """Calls with an argument a block; what is applied to a node follows it on a line of its own."""
        return "\n".join(self._lines())

    def _lines(self) -> list[str]:
        raise NotImplementedError


def _call(name: str, parts: tuple[Expr, ...]) -> list[str]:
    out = [f"{name}("]
    for p in parts:
        lines = p._lines()
        out += ["  " + x for x in lines[:-1]] + [f"  {lines[-1]},"]
    return [*out, ")"]


def _bound(n: int | None) -> str:
    return "*" if n is None else str(n)


@dataclass(frozen=True)
class Nothing(Expr):
    def _lines(self):
        return ["none()"]


@dataclass(frozen=True)
class All(Expr):
    def _lines(self):
        return ["all()"]


@dataclass(frozen=True)
class Constant(Expr):
    revs: tuple[int, ...]

    def _lines(self):
        return [f"constant([{', '.join(f'Rev({r})' for r in self.revs)}])"]


@dataclass(frozen=True)
class Up(Expr):
    """What a walk of lo to hi edges from parent to child leads to (hi None: any number from lo)."""

    input: Expr
    lo: int = 0
    hi: int | None = None

    def _lines(self):
        return [*self.input._lines(), f"  .up({self.lo}, {_bound(self.hi)})"]


@dataclass(frozen=True)
class Down(Expr):
    """The same from child to parent."""

    input: Expr
    lo: int = 0
    hi: int | None = None

    def _lines(self):
        return [*self.input._lines(), f"  .down({self.lo}, {_bound(self.hi)})"]


@dataclass(frozen=True)
class Range(Expr):
    roots: Expr
    heads: Expr

    def _lines(self):
        return _call("range", (self.roots, self.heads))


@dataclass(frozen=True)
class Union(Expr):
    inputs: tuple[Expr, ...]

    def _lines(self):
        return _call("union", self.inputs)


@dataclass(frozen=True)
class Intersection(Expr):
    inputs: tuple[Expr, ...]

    def _lines(self):
        return _call("intersection", self.inputs)


@dataclass(frozen=True)
class Difference(Expr):
    left: Expr
    right: Expr

    def _lines(self):
        return _call("difference", (self.left, self.right))


@dataclass(frozen=True)
class Heads(Expr):
    input: Expr
    transitive: bool = False

    def _lines(self):
        return [*self.input._lines(), "  .heads(transitive)" if self.transitive else "  .heads()"]


@dataclass(frozen=True)
class Filter(Expr):
    input: Expr
    predicates: tuple[Predicate, ...]

    def _lines(self):
        return [*self.input._lines(), f"  .filter([{', '.join(map(str, self.predicates))}])"]
