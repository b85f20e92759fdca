"""Training: label, split, cross-validate, fit, evaluate, store."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylane import fixed
from assaylane.operators.columns import coerce_numeric, col, feature_columns, pick_id
from assaylane.operators.impute import fit_median
from assaylane.operators.labels import label_by_fraction
from assaylane.operators.metrics import cv_summary, evaluate, pr_curve, roc_curve
from assaylane.operators.split import split_ids, stratified_folds, stratified_split
from assaylane.plans.ensembles import (
    Config,
    Ensemble,
    ForestConfig,
    assemble,
    config_from,
    fit,
    fit_once,
    training_table,
)
from assaylane.plans.store import has_model, load_model, load_record, load_table, run_info, save_model
from assaylane.session import materialize
from assaylane.sources.files import table_fingerprint
from assaylane.sources.rows import with_row_index

CV_TREES = 800
BASE_FOREST = ForestConfig(n_estimators=2500, patience=15)
Y = "activo"


@dataclass
class Prepared:
    """Labelled, split training data."""

    table: DataFrame
    features: list[str]
    key: str  # names rows for seeded choices
    id_col: str  # names them in the stored split


@dataclass
class Trained:
    model: Ensemble
    metrics: dict[str, dict]
    splits: DataFrame
    cv: dict | None = None
    info: DataFrame | None = None
    loaded: bool = False


def label_and_split(
    df: DataFrame,
    value: str = "Standard Value",
    key: str = fixed.ROW_INDEX,
    fraction: float = 0.5,
    train: float = 0.75,
    val: float = 0.15,
    seed: int = fixed.SEED,
    forbidden: tuple = tuple(fixed.NOT_FEATURES),
) -> Prepared:
    """Drop rows without a value, label the most potent fraction, split by label. Written once.

    ``key`` names rows for the seeded choices; it is made where the table has none, and it may repeat.
    """
    if value not in df.columns:
        raise ValueError(f"no column {value!r} to label by")
    features = [c for c in feature_columns(df, forbidden) if c not in (value, key, fixed.ROW_INDEX, Y)]
    if not features:
        raise ValueError("no numeric feature columns")
    if key not in df.columns:
        df = with_row_index(df, key)
    valued = materialize(coerce_numeric(df, value))
    labelled = label_by_fraction(valued, value, key, fraction, seed, Y)
    return Prepared(materialize(stratified_split(labelled, Y, key, train, val, seed)), features, key, pick_id(df, key))


def score_splits(model: Ensemble, table: DataFrame, y: str = Y) -> DataFrame:
    """Label, split and probability of every row, written once."""
    return materialize(model.predict(table, keep=[y, "split"]))


def evaluate_splits(model: Ensemble, table: DataFrame, threshold: float = 0.5, y: str = Y) -> dict[str, dict]:
    """All metrics per split. The scores are written once, then counted for all splits together."""
    return _metrics(score_splits(model, table, y), threshold, y)


def _metrics(scored: DataFrame, threshold: float = 0.5, y: str = Y) -> dict[str, dict]:
    rows = evaluate(scored, y, "prob_activo", threshold, keys=["split"]).collect()
    return {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in rows}


@dataclass
class CrossValidated:
    folds: DataFrame  # fold, train_auc, val_auc, val_f1
    summary: DataFrame
    scored: DataFrame  # fold, label and probability of every row, from the model that has not seen it


def cross_validate(
    df: DataFrame, features: list[str], key: str, cfg: Config, k: int = 5, y: str = Y, trees: int = CV_TREES
) -> CrossValidated:
    """Stratified k-fold check. Its models have at most ``trees`` trees; medians are fitted anew in every fold."""
    light = replace(cfg, n_estimators=min(trees, cfg.n_estimators))
    folded = materialize(stratified_folds(df, y, key, k, cfg.seed))
    rows, unseen = [], None
    for fold in range(k):
        part = folded.withColumn("split", F.when(col("fold") == fold, "val").otherwise("train"))
        seen = part.where("split = 'train'")
        medians = fit_median(seen, features)
        models = fit_once(training_table(assemble(seen, features, medians, [y]), light, y), light, y)
        scored = score_splits(Ensemble(features, medians, models, light), part, y)
        scores = _metrics(scored, y=y)
        rows.append((fold, scores["train"]["roc_auc"], scores["val"]["roc_auc"], scores["val"]["f1"]))
        own = scored.where("split = 'val'").select(F.lit(fold).alias("fold"), col(y), "prob_activo")
        unseen = own if unseen is None else unseen.union(own)
    folds = df.sparkSession.createDataFrame(rows, "fold int, train_auc double, val_auc double, val_f1 double")
    return CrossValidated(folds, cv_summary(folds), unseen)


def fit_model(prepared: Prepared, cfg: Config) -> Ensemble:
    """Fit with early stopping: medians and trees from the train split, size by the val split."""
    table, features = prepared.table, prepared.features
    train, val = table.where("split = 'train'"), table.where("split = 'val'")
    medians = fit_median(train, features)
    models, history = fit(
        assemble(train, features, medians, [Y]), assemble(val, features, medians, [Y]), cfg
    )
    return Ensemble(features, medians, models, cfg, history)


def evaluation_tables(scored: DataFrame, cv: CrossValidated | None = None, threshold: float = 0.5) -> dict[str, DataFrame]:
    """What the plots of a run are drawn from: ROC and precision-recall points and confusion counts of the val and
    test split; with cross-validation, its folds and their ROC points. Curves are thinned to their corners."""
    seen = scored.where("split IN ('val', 'test')")
    counts = evaluate(seen, Y, "prob_activo", threshold, keys=["split"])
    tables = {
        "roc_points": roc_curve(seen, Y, "prob_activo", ["split"], thin=True),
        "pr_points": pr_curve(seen, Y, "prob_activo", ["split"], thin=True),
        "confusion": counts.select("split", "tn", "fp", "fn", "tp"),
    }
    if cv is not None:
        tables["cv_folds"] = cv.folds
        tables["cv_roc_points"] = roc_curve(cv.scored, Y, "prob_activo", ["fold"], thin=True)
    return tables


def train(
    df: DataFrame,
    path: str,
    cfg: Config = BASE_FOREST,
    retrain: bool = False,
    cv_k: int | None = 5,
    data_hash: str | None = None,
    **options,
) -> Trained:
    """Train and store a model at ``path``, or load the one stored there unless ``retrain``.

    Cross-validation in ``cv_k`` folds comes first, whatever the number of rows; None leaves it out. Stored with the
    model, all in one commit: the run record, the split of every id, and the points of the curves. A loaded model
    comes with its stored metrics and splits if the data is that of its training, else it is evaluated anew.
    """
    spark = df.sparkSession
    data_hash = data_hash or table_fingerprint(df).first()["checksum"]
    if has_model(spark, path) and not retrain:
        model, meta = load_model(spark, path), load_record(spark, path)["meta"]
        if meta.get("data_hash") == data_hash and meta.get("options") == _shown(options):
            return Trained(model, meta["metrics"], load_table(spark, path, "splits"), meta["cv"], load_table(spark, path, "info"), True)
        prepared = label_and_split(df, **options)
        return Trained(model, evaluate_splits(model, prepared.table), split_ids(prepared.table, prepared.id_col), loaded=True)
    prepared = label_and_split(df, **options)
    splits = split_ids(prepared.table, prepared.id_col)
    cv = None if cv_k is None else cross_validate(prepared.table, prepared.features, prepared.key, cfg, cv_k)
    summary = None if cv is None else cv.summary.first().asDict()
    model = fit_model(prepared, cfg)
    scored = score_splits(model, prepared.table)
    metrics = _metrics(scored)
    info = run_info(model, data_hash, {s: m for s, m in metrics.items() if s != "train"}, summary)
    meta = {"data_hash": data_hash, "options": _shown(options), "metrics": metrics, "cv": summary}
    save_model(model, path, meta, {"info": info, "splits": splits, **evaluation_tables(scored, cv)})
    return Trained(model, metrics, splits, summary, info)


def _shown(options: dict) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in sorted(options.items())}


def train_or_load(
    df: DataFrame, folder: str, mode: str = "base", name: str | None = None, algo: str = "rf",
    cfg: Config | None = None, **options,
) -> Trained:
    """Train by mode, in a sub-folder per model.

    ``base`` is the default forest; ``new`` needs a ``name`` and always trains; any other mode is
    the name of a model, whose stored configuration is used over the defaults.
    """
    if mode == "base":
        return train(df, f"{folder}/base", cfg or BASE_FOREST, **options)
    if mode == "new":
        if not name:
            raise ValueError("mode 'new' needs a name")
        chosen = cfg or (BASE_FOREST if algo == "rf" else config_from("gbt", {}))
        return train(df, f"{folder}/{name}", chosen, **{**options, "retrain": True})
    if mode == "test":
        raise ValueError("mode 'test' stores no model: use plans.search.random_search")
    path = f"{folder}/{mode}"
    if has_model(df.sparkSession, path):
        record = load_record(df.sparkSession, path)
        stored = config_from(record["algo"], record["config"])
    else:
        stored = ForestConfig()
    return train(df, path, cfg or stored, **options)
