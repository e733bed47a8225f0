"""What the operators share: a folder that all executors see, tables written there, partition counts, exchange of packed blocks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which an execution that has ended removes the files of its shuffles.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir (a temporary folder where that is unset in local mode, as in tests; elsewhere that is refused)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(shared_dir, "local", None)
        if root is None:
            root = shared_dir.local = "file://" + tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/llm-{sc.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of executors.

    The files of the shuffles that led to it go once it is written, and not only when the driver's collector finds them unused.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession, per_partition: int = 4) -> int:
    """Buckets of a packed exchange: several to a shuffle partition, so that hashing them to partitions stays even."""
    return per_partition * shuffle_partitions(spark)


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's batches to Python workers hold at most about BATCH_BYTES (or one row); Spark's own bound is 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
