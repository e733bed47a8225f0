"""String patterns and metadata predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import Predicate


def matches(column: Column, text: str, kind: str = "substring") -> Column:
    """exact, substring, and either of them without regard to case (with -i). A null column doesn't match."""
    whole = kind.removesuffix("-i") == "exact"
    if kind.endswith("-i"):
        column, text = F.lower(column), F.lower(F.lit(text))
    return F.coalesce(column == text if whole else column.contains(text), F.lit(False))


def condition(predicate: Predicate) -> Column:
    """A predicate over the columns author_name, author_email and description."""
    names = ("author_name", "author_email") if predicate.field == "author" else (predicate.field,)
    out = matches(F.col(names[0]), predicate.text, predicate.kind)
    for name in names[1:]:
        out = out | matches(F.col(name), predicate.text, predicate.kind)
    return out
