"""Scalar functions: string patterns over metadata columns."""

from .patterns import condition, matches

__all__ = ["condition", "matches"]
