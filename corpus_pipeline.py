"""A corpus pipeline from raw documents to packed sequences: each stage calls one operator and works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlattice.llm.jaccard import one_of_each
from revlattice.llm.line_dedup import dedup_lines
from revlattice.llm.mixing import mixture, quotas_by_weight
from revlattice.llm.packing import pack_documents
from revlattice.llm.quality import keep_good
from revlattice.llm.runtime import shared_dir
from revlattice.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that loses all its text goes."""
    out = dedup_lines(docs)
    lost = F.col("n_dropped") > 0
    out = out.where(~lost | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    return mixture(docs, quotas_by_weight())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end=1)


STAGES = [("quality", quality), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: SQL has neither the trained trees nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
