"""Stored models and run records."""

from __future__ import annotations

import json
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from datetime import datetime
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylane.plans.ensembles import Ensemble, config_from
from assaylane.sources import versions
from assaylane.sources.files import write_table

INFO_SCHEMA = "section string, key string, value string"


def save_model(
    model: Ensemble, path: str, meta: dict | None = None, tables: Mapping[str, DataFrame] | None = None, parallelism: int = 4
) -> None:
    """Store the MLlib models, a one-row record (features, medians, configuration, history, ``meta``) and further
    tables beside them, as one new version of ``path``."""
    spark = SparkSession.getActiveSession()
    record = {
        "features": model.features,
        "medians": model.medians,
        "algo": model.config.algo,
        "config": asdict(model.config),
        "history": model.history,
        "meta": meta or {},
    }
    text = spark.createDataFrame([(json.dumps(record, ensure_ascii=False),)], "record string")

    def write(folder: str) -> None:
        """All parts at once, as each is a few small jobs."""
        parts = [
            lambda: PipelineModel(model.models).write().save(f"{folder}/models"),
            lambda: write_table(text.coalesce(1), f"{folder}/record"),
            *(partial(write_table, table, f"{folder}/{name}") for name, table in (tables or {}).items()),
        ]
        run = inheritable_thread_target(spark)(lambda part: part())
        with ThreadPoolExecutor(parallelism) as pool:
            list(pool.map(run, parts))

    versions.replace(spark, path, write)


def has_model(spark: SparkSession, path: str) -> bool:
    return versions.is_versioned(spark, path)


def _version(spark: SparkSession, path: str) -> str:
    folder = versions.current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no stored model at {path}")
    return folder


def load_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{_version(spark, path)}/record").first()["record"])


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table stored beside the model: ``info``, ``splits``, ``roc_points``, ``pr_points``, ``confusion``, ..."""
    return spark.read.parquet(f"{_version(spark, path)}/{name}")


def load_model(spark: SparkSession, path: str) -> Ensemble:
    folder = _version(spark, path)
    record = json.loads(spark.read.parquet(f"{folder}/record").first()["record"])
    config = config_from(record["algo"], record["config"])
    models = PipelineModel.load(f"{folder}/models").stages
    return Ensemble(record["features"], record["medians"], models, config, record["history"])


def top_importances(model: Ensemble, k: int = 20) -> DataFrame:
    """Most important features first, ties in feature order."""
    spark = SparkSession.getActiveSession()
    rows = [(i, name, value) for i, (name, value) in enumerate(model.importances())]
    frame = spark.createDataFrame(rows, "position int, feature string, importance double")
    return frame.orderBy(F.desc("importance"), "position").limit(k).select("feature", "importance")


def run_info(
    model: Ensemble,
    data_hash: str,
    metrics: dict[str, dict],
    cv: dict | None = None,
    date: str | None = None,
) -> DataFrame:
    """Record of a run as ``section, key, value``: general facts, metrics, top-20 importances."""
    spark = SparkSession.getActiveSession()
    rows = [
        ("run", "date", date or datetime.now().strftime("%Y-%m-%d %H:%M:%S")),
        ("run", "seed", str(model.config.seed)),
        ("run", "data_hash", data_hash),
        ("run", "n_features", str(len(model.features))),
        ("run", "n_trees", str(model.n_trees)),
        ("run", "config", json.dumps(asdict(model.config), ensure_ascii=False)),
    ]
    rows += [("cv", k, str(v)) for k, v in (cv or {}).items()]
    rows += [(f"metrics_{name}", k, str(v)) for name, values in metrics.items() for k, v in values.items()]
    importances = top_importances(model).select(
        F.lit("top20_importances").alias("section"),
        F.col("feature").alias("key"),
        F.format_string("%.6f", "importance").alias("value"),
    )
    return spark.createDataFrame(rows, INFO_SCHEMA).unionByName(importances)
