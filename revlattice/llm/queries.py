"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .jaccard import jaccard_components
from .line_dedup import dedup_lines
from .lm import lm_scores
from .mixing import mix_sources, quotas_by_weight
from .packing import pack_documents
from .quality import quality_scores
from .token_counts import token_counts
from .token_files import read_documents, write_token_files
from .tokens import tokenizer_path
from .topk import exact_topk


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the size of its shingle set and its component under links of at least 75 %."""
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes of it."""
    held: dict = {}
    mixed = mix_sources(_read(spark, sf_dir, "documents"), quotas_by_weight(held=held))
    rows = [([s], n, float(held["targets"][s])) for s, n in held["sizes"].items()]
    sources = spark.createDataFrame(rows, "pattern array<string>, source_size long, target double")
    taken = (F.col("size") * F.col("repeats")).alias("taken")
    return mixed.join(F.broadcast(sources), "pattern").select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken, F.col("pattern")[0].alias("source"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place and ids, read back from bit-packed files of all documents in ascending order of doc_id."""
    files = write_token_files(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end=0)
    return read_documents(spark, files)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score under a bigram model of the training documents, with an add-one unigram score beside it."""
    return lm_scores(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without the lines of which an alike one stays elsewhere."""
    out = dedup_lines(_read(spark, sf_dir, "documents"))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return out.select("doc_id", "n_dropped", (lines * (F.col("text") != "").cast("long")).alias("n_lines"), "text")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=1)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the identifier that stays of its group of equal texts."""
    out = exact_dedup(_read(spark, sf_dir, "documents"), keep_largest=True)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score."""
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every vector whose identifier is divisible by 100."""
    found = exact_topk(_read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of unigram tokens."""
    return token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_mix_sources, op3_token_files, op4_lm_scores, op5_line_dedup, op6_pack, op7_exact_dedup, op8_quality, op9_topk, op10_token_counts)}

ORACLE_SQL = {
    "op1_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), l AS (
            SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
        ), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (
            SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen
        ), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
