"""The queries of the operators, thin digests over their results. One query per operator and no limits."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assaylane.llm import (
    bpe, collocations, counting, decontaminate, importance, near, ngram_join, packing, ppm, quality, repeats, secrets, topk,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(read(spark, folder, "documents"), BYTE_BPE)


@query("op3_decontaminate")
def decontaminated(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digests(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 20
"""


@query("op5_top_k", TOP_K_SQL)
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(read(spark, folder, "embeddings"), k=20, every=20)


@query("op7_packed_tokens")
def packed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_tokens(read(spark, folder, "documents"), BYTE_BPE, vocabulary=50_256)


@query("op9_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.count_tokens(read(spark, folder, "documents"), WORD_BPE, limit=2_048)


@query("op4_language")
def language(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.predict_documents(read(spark, folder, "documents"))


@query("op10_near_duplicates")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(read(spark, folder, "documents"))


@query("op8_secrets")
def secrets_found(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(read(spark, folder, "documents"))


@query("op6_repeated_passages")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.repeated_passages(read(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op2_quality")
def quality_kept(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op11_collocations", collocations.COLLOCATIONS_SQL)
def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))


@query("op12_importance")
def importance_drawn(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op13_ngram_join")
def ngram_components(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, folder, "documents"))
