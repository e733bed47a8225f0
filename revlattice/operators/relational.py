"""Scans, joins, projection, selection and order over arbitrary relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ValueRange:
    """Inclusive bounds of a key; None is open, and a range whose low end is above its high end holds nothing."""

    low: int | None = None
    high: int | None = None

    @classmethod
    def nothing(cls) -> ValueRange:
        return cls(1, 0)

    @classmethod
    def of(cls, value: int) -> ValueRange:
        return cls(value, value)

    @property
    def is_empty(self) -> bool:
        return self.low is not None and self.high is not None and self.low > self.high

    def hull(self, other: ValueRange) -> ValueRange:
        """The least range that holds both."""
        if self.is_empty or other.is_empty:
            return other if self.is_empty else self
        low = None if self.low is None or other.low is None else min(self.low, other.low)
        high = None if self.high is None or other.high is None else max(self.high, other.high)
        return ValueRange(low, high)

    def intersect(self, other: ValueRange) -> ValueRange:
        lows, highs = ([x for x in pair if x is not None] for pair in ((self.low, other.low), (self.high, other.high)))
        return ValueRange(max(lows, default=None), min(highs, default=None))

    def open_above(self) -> ValueRange:
        return ValueRange(self.low, None)

    def open_below(self) -> ValueRange:
        return ValueRange(None, self.high)

    def condition(self, column: str) -> Column:
        """Comparisons with literals, which reach the scan."""
        out = F.lit(not self.is_empty)
        if not self.is_empty:
            out = out if self.low is None else out & (F.col(column) >= self.low)
            out = out if self.high is None else out & (F.col(column) <= self.high)
        return out


def scan(df: DataFrame, column: str = "rev", start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows whose key lies between start and end, both included, in either order of the two."""
    if start is not None and end is not None and start > end:
        start, end = end, start
    return df.where(ValueRange(start, end).condition(column))


def constrain(df: DataFrame, column: str, bounds: ValueRange) -> DataFrame:
    """Of pairs, those whose first component `column` lies in the bounds."""
    return df.where(bounds.condition(column))


def merge_join(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """Inner equi-join, many to many, bag semantics; Spark is asked for a sort-merge join, which spills and splits skewed keys."""
    return left.join(right.hint("merge"), key)


def project(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Each row mapped; duplicates stay."""
    return df.select(*columns)


def keep(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows that satisfy the condition (null counts as not)."""
    return df.where(condition)


def newest_first(df: DataFrame, column: str = "rev") -> DataFrame:
    return df.orderBy(F.col(column).desc())


def oldest_first(df: DataFrame, column: str = "rev") -> DataFrame:
    return df.orderBy(F.col(column).asc())


def reverse(df: DataFrame, column: str = "rev", newest: bool = True) -> DataFrame:
    """The order opposite to the one that df has (newest first, unless told otherwise)."""
    return oldest_first(df, column) if newest else newest_first(df, column)


def rows(df: DataFrame) -> Iterator[Row]:
    """The sink: rows one after another, a partition at a time on the driver."""
    return df.toLocalIterator()


def mapped(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """For functions that no column expression covers: f maps a pandas frame of a batch to another."""
    return df.mapInPandas(lambda frames: (f(x) for x in frames), schema)
