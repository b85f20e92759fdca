"""Hyper-parameter search and its rankings."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylane import fixed
from assaylane.functions.seeds import seed_hash
from assaylane.operators.columns import col
from assaylane.operators.impute import fit_median
from assaylane.plans.ensembles import MAX_DEPTH, Ensemble, assemble, config_from, fit_once, training_table
from assaylane.plans.train import Y, Prepared, evaluate_splits

METRICS = ("roc_auc", "pr_auc", "f1", "precision", "recall")


def sample_configs(spark: SparkSession, space: Mapping[str, Sequence], n: int, seed: int = fixed.SEED) -> DataFrame:
    """``n`` different parameter sets of a grid, drawn by seeded hash: ``position, cfg`` (JSON text).

    Depths that grow the same trees are one: no limit and ``MAX_DEPTH`` or more. The grid is numbered, not built: a
    number is read as one digit per parameter.
    """
    space = {k: distinct_values(k, values) for k, values in space.items()}
    parts, stride = [], 1
    for name, values in reversed(space.items()):
        digit = F.pmod(F.floor(F.col("id") / F.lit(stride)), F.lit(len(values))).cast("int")
        texts = F.array(*[F.lit(json.dumps(v)) for v in values])
        parts.insert(0, F.concat(F.lit(f"{json.dumps(name)}: "), F.get(texts, digit)))
        stride *= len(values)
    cfg = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    grid = spark.range(stride).select(cfg.alias("cfg")).withColumn("_hash", seed_hash("cfg", seed=seed))
    drawn = grid.orderBy("_hash", "cfg").limit(n).collect()
    return spark.createDataFrame([(i, r["cfg"]) for i, r in enumerate(drawn)], "position int, cfg string")


def distinct_values(name: str, values: Sequence) -> list:
    """The values of a parameter that make a difference."""
    if name != "max_depth":
        return list(values)
    return list(dict.fromkeys(None if v is None or v >= MAX_DEPTH else v for v in values))


def run_trials(
    prepared: Prepared, algo: str, configs: Sequence[dict], seed: int = fixed.SEED, parallelism: int = 2
) -> list[tuple]:
    """Fit every configuration and score all splits; trials run side by side as separate Spark jobs.

    They share one written table of training vectors. Only numbers are kept of each trial, not the fitted trees.
    """
    table, features = prepared.table, prepared.features
    train = table.where("split = 'train'")
    medians = fit_median(train, features)
    vectors = training_table(assemble(train, features, medians, [Y]), config_from(algo, {}), Y)

    def trial(values: dict) -> tuple:
        cfg = config_from(algo, {**values, "seed": seed})
        models = fit_once(vectors, cfg, Y)
        scores = evaluate_splits(Ensemble(features, medians, models, cfg), table)
        numbers = [scores.get(s, {}).get(m) for s in ("train", "val", "test") for m in METRICS]
        return (algo, json.dumps(values), *numbers)

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(table.sparkSession)(trial), configs))


def search(
    prepared: Prepared,
    algos: Sequence[str] = ("rf", "gbt"),
    trials: int = 5,
    seed: int = fixed.SEED,
    spaces: Mapping[str, Mapping[str, Sequence]] | None = None,
    parallelism: int = 2,
) -> DataFrame:
    """Random search: one row per trial with its configuration and the metrics of all three splits."""
    spark = prepared.table.sparkSession
    spaces = spaces or {"rf": fixed.FOREST_SPACE_EXTENDED, "gbt": fixed.BOOSTED_SPACE_EXTENDED}
    rows = []
    for algo in algos:
        drawn = sample_configs(spark, spaces[algo], trials, seed).orderBy("position").collect()
        rows += run_trials(prepared, algo, [json.loads(r["cfg"]) for r in drawn], seed, parallelism)
    numbers = ", ".join(f"{s}_{m} double" for s in ("train", "val", "test") for m in METRICS)
    return spark.createDataFrame(rows, f"algo string, cfg string, {numbers}")


def random_search(prepared: Prepared, algo: str = "rf", n: int = 10, seed: int = fixed.SEED, **options) -> DataFrame:
    """The short search over one algorithm: configurations by validation AUC, then F1."""
    spaces = {"rf": fixed.FOREST_SPACE, "gbt": fixed.BOOSTED_SPACE}
    board = search(prepared, [algo], n, seed, options.pop("spaces", spaces), **options)
    ordered = board.orderBy(F.desc_nulls_last("val_roc_auc"), F.desc("val_f1"), "cfg")
    return ordered.select("algo", "cfg", col("val_roc_auc").alias("roc_auc"), col("val_f1").alias("f1"))


def leaderboard(board: DataFrame, auc: str = "roc_auc", f1: str = "f1", k: int = 5, tie: str = "cfg") -> DataFrame:
    """Best ``k`` rows by AUC, then F1."""
    return board.orderBy(F.desc_nulls_last(auc), F.desc_nulls_last(f1), col(tie)).limit(k)


def compare(board: DataFrame, by: str = "val", k: int = 3, tie: str = "cfg") -> DataFrame:
    """Best ``k`` trials by the ``val`` or ``test`` scores, or by the smallest train-test ``gap`` in AUC."""
    if by == "gap":
        gap = F.abs(col("train_roc_auc") - col("test_roc_auc"))
        return board.orderBy(F.asc_nulls_last(gap), F.desc_nulls_last("test_roc_auc"), col(tie)).limit(k)
    if by not in ("val", "test"):
        raise ValueError("by is 'val', 'test' or 'gap'")
    return leaderboard(board, f"{by}_roc_auc", f"{by}_f1", k, tie)
