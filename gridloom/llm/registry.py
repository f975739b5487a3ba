"""The corpus operators' queries, with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import documents, held_out


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.html import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.topk import top_k

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows.filter(F.col("vec_id") % 50 == 0), rows, k=5, scale=256)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 5
"""


def op3_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.sentencepiece_scan import encoded_parts, summary

    path = public_tokenizers.path("piece_bpe_32k.model")
    return summary(encoded_parts(documents(spark, sf_dir), path), path)


def op4_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.repair_store import read_store, write_store

    return read_store(write_store(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import langid

    docs = documents(spark, sf_dir)
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import toxicity

    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths; source / a hundred of doc_ids / doc_id stands in for a tree of files."""
    from gridloom.llm.licenses import scan

    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan(documents(spark, sf_dir).select("doc_id", path.alias("path"), "text"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.simhash import fp_hex, near_duplicates

    found = near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)
    return found.select("doc_id", fp_hex().alias("fingerprint"), "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id) = 1 AS kept,
  sha256(body) AS text_sha256
FROM n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL, "op9_exact_dedup": OP9_SQL}
