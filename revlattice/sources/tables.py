"""Graphs in tables: read and written as parquet, or derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import index
from .graph import RevGraph


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_graph(spark: SparkSession, folder: str) -> RevGraph:
    """What write_graph() wrote."""
    return RevGraph(*(read_table(spark, folder, name) for name in ("revs", "edges", "commits")))


def write_graph(graph: RevGraph, folder: str, partitions: int | None = None) -> None:
    """Tables dealt by ranges and sorted, so that a scan's bounds prune files and row groups."""
    for name, df, keys in (("revs", graph.revs, ["rev"]), ("edges", graph.edges, ["child", "parent"]), ("commits", graph.commits, ["rev"])):
        index(df, *keys, partitions=partitions).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def order_graph(spark: SparkSession, folder: str) -> RevGraph:
    """Order keys as revisions: the parents of a key k above 0 are k div 2 and k div 3; customers are authors."""
    orders, customer = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    key = F.col("o_orderkey").cast("long")
    halves, thirds = F.floor(key / 2).cast("long"), F.floor(key / 3).cast("long")
    # k div 2 and k div 3 are the same only where both are 0: no shuffle is needed to drop repeats.
    parents = F.explode(F.when(halves == thirds, F.array(halves)).otherwise(F.array(halves, thirds)))
    edges = orders.where(key >= 1).select(key.alias("child"), parents.alias("parent"))
    named = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    commits = named.select(
        key.alias("rev"), F.col("c_name").alias("author_name"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("author_email"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("description")
    )
    return RevGraph(orders.select(key.alias("rev")), edges, commits)
