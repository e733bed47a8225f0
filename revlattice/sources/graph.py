"""A graph of revisions: its members, edges and metadata, and queries on it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reach import Adjacency, adjacency
from ..plans.compile import compile_expr
from ..plans.expr import Expr
from ..plans.language import parse
from ..plans.rules import Rules

COMMITS = ("author_name", "author_email", "description")


class RevGraph:
    """revs (rev), edges (child, parent) with parent < child, commits (rev, author_name, author_email, description)."""

    def __init__(self, revs: DataFrame, edges: DataFrame, commits: DataFrame | None = None, validate: bool = False):
        self.spark = revs.sparkSession
        self.revs = revs.select(F.col("rev").cast("long").alias("rev"))
        self.edges = edges.select(F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent"))
        if commits is None:
            self.commits = self.revs.select("rev", *(F.lit(None).cast("string").alias(c) for c in COMMITS))
        else:
            self.commits = commits.select(F.col("rev").cast("long").alias("rev"), *COMMITS)
        if validate:
            self.validate()

    def validate(self) -> None:
        """Raises unless members are unique, no key is null and every parent is below its child."""
        if not self.edges.where("parent >= child or parent is null or child is null").isEmpty():
            raise ValueError("an edge's parent must be below its child")
        if not self.revs.groupBy("rev").count().where("count > 1 or rev is null").isEmpty():
            raise ValueError("revisions must be unique and not null")

    @cached_property
    def parents_at_hand(self) -> Adjacency | None:
        """child -> parent, where the edges are few enough for the driver."""
        return adjacency(self.edges, "child", "parent")

    @cached_property
    def children_at_hand(self) -> Adjacency | None:
        down = self.parents_at_hand
        return down and Adjacency(down.target, down.source)

    def evaluate(self, expr: Expr, rules: Rules | None = None, optimized: bool = True) -> DataFrame:
        """The set that an expression denotes, as a DataFrame."""
        return compile_expr(self, expr.optimize(rules) if optimized else expr)

    def query(self, text: str, rules: Rules | None = None) -> DataFrame:
        """The set that a query text denotes."""
        return self.evaluate(parse(text), rules)

    def revisions(self, text: str) -> list[int]:
        """A query's revisions, newest first."""
        return [r.rev for r in self.query(text).orderBy(F.col("rev").desc()).collect()]

    def explain(self, text: str, rules: Rules | None = None) -> str:
        """The rewritten tree of a query."""
        return parse(text).optimize(rules).tree()
