"""A training corpus in stages: language, near duplicates, benchmark passages, secrets, token ids.

Every stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``. SQL cannot express the stages, so ``ORACLE_SQL``
is None and the tests compare with brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylane.llm import bpe, decontaminate, near, ppm, secrets
from assaylane.llm.bitmaps import bitmap_of, may_hold
from assaylane.llm.common import content_key
from assaylane.session import materialize

LEAST_SCORE = 0.5
_PLACE = "__row_place"


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with made-up names, which clash with no result of an operator, and the made-up name of each column."""
    names = [f"column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters, and those that no language fits better than all
    others together, go."""
    model = ppm.fit(docs.where(~ppm.held_out(F.col("doc_id"))))
    named, names = _renamed(docs)
    told = ppm.predict(named, model, text=names["text"], keep=tuple(named.columns))
    told = told.where((F.col("lang_pred") != ppm.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return told.select(*named.columns).toDF(*docs.columns)


def _located(docs: DataFrame) -> DataFrame:
    """``docs`` with a number that tells its stored rows apart however often they are read."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    try:
        return docs.withColumn(_PLACE, place)
    except AnalysisException:  # not read from Parquet files
        return materialize(docs).withColumn(_PLACE, place)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the least id; of repeated rows one. Rows without an id go by their text.

    What goes is looked up by the place of a row; texts that stay do not move, but for a few that a bitmap of the
    places cannot tell apart."""
    located = _located(docs)
    named = located.select(near.document_id("doc_id", "text").alias("made_id"), F.col("text").alias("text"), F.col(_PLACE).alias("place"))
    kept = near.near_duplicates(named, key="made_id").where("made_id = class_id").select("made_id").distinct()
    rows = materialize(named.select("made_id", *content_key(F.col("text").cast("string")), "place"))
    one = rows.join(kept, "made_id", "left_semi").groupBy("made_id", "k1", "k2").agg(F.min("place").alias("place"))
    stay = materialize(one.select(F.col("place").alias(_PLACE)))
    gone = rows.select(F.col("place").alias(_PLACE)).join(stay, _PLACE, "left_anti")
    may_go = may_hold(bitmap_of(gone, _PLACE))(F.col(_PLACE))
    sure, open_ = located.where(~may_go), located.where(may_go).join(stay, _PLACE, "left_semi")
    return sure.select(*docs.columns).union(open_.select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    named, names = _renamed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(named, items, text=names["text"], keep=tuple(named.columns))
    return found.where("n_hit = 0").select(*named.columns).toDF(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.encode(docs, path, keep=("doc_id", "lang", "source"), with_decoded=True)
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("redacted", redacted),
    ("encoded", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
