"""Queries as trees: building, text form, rewriting, compiling to DataFrames."""

from .expr import All, Constant, Difference, Down, Expr, Filter, Heads, Intersection, Nothing, Predicate, Range, Union, Up
from .language import parse, to_revset
from .rules import Rules, optimize

__all__ = ["All", "Constant", "Difference", "Down", "Expr", "Filter", "Heads", "Intersection", "Nothing", "Predicate", "Range", "Rules", "Union", "Up", "optimize", "parse", "to_revset"]
