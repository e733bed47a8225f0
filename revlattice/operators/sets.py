"""Literal sets and set algebra. All results are sets: no duplicates, whatever the inputs hold."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

REV = "rev long"


def constant(spark: SparkSession, revs: Iterable[int]) -> DataFrame:
    """A literal set."""
    return spark.createDataFrame([(int(r),) for r in sorted(set(revs))], REV)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REV)


def index(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """A relation laid out for range scans: dealt by ranges of the keys and sorted within them, so that written files prune."""
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def union(*sets: DataFrame) -> DataFrame:
    """One aggregation over all arms, however many."""
    return reduce(DataFrame.unionByName, sets).distinct()


def intersection(first: DataFrame, *others: DataFrame) -> DataFrame:
    """A chain of semi joins on one key: the first set is dealt once, and made distinct once."""
    return reduce(lambda a, b: a.join(b, "rev", "left_semi"), others, first).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "rev", "left_anti").distinct()

