"""Training, scoring and search. The class is ``embedding[0] + embedding[1] > 0``, which trees can learn.

Trees themselves have no SQL. What SQL can state is what must hold for any trees: how many rows of which class each
split and fold has, that scores are in bounds and good, that a stored model scores like the one it was, that reports
follow from the scores. Queries compute these facts from whole runs.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylane import fixed
from assaylane.operators.columns import col
from assaylane.operators.enrich import expand_vector
from assaylane.plans.ensembles import BoostedConfig, ForestConfig
from assaylane.plans.predict import predict
from assaylane.plans.search import compare, random_search, search
from assaylane.plans.store import load_model, top_importances
from assaylane.plans.train import (
    cross_validate,
    fit_model,
    label_and_split,
    train,
    train_or_load,
)
from assaylane.session import scratch_path
from checks.registry import query
from checks.standins import table
from checks.stats import split_sql

FOREST = ForestConfig(n_estimators=20, step=10, patience=1, max_depth=8)
BOOSTED = BoostedConfig(n_estimators=12, early_stopping_rounds=4, max_depth=3)
SMALL_SPACES = {
    "rf": {"n_estimators": [5, 10], "max_depth": [None, 4], "min_samples_leaf": [1, 3], "max_features": ["sqrt", None]},
    "gbt": {"n_estimators": [4, 8], "max_depth": [2, 3], "learning_rate": [0.1, 0.2], "subsample": [0.8, 1.0]},
}
GOOD = 0.7  # validation AUC of a model that has learned

LABELLED_SQL = """SELECT vec_id AS row_idx, h, CASE WHEN row_number() OVER (ORDER BY value, h) <= greatest(1, floor(0.5e0 * count(*) OVER ()))
    THEN 1 ELSE 0 END AS activo FROM (SELECT vec_id, -(CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE)) AS value,
        md5(concat_ws('|', '1234', CAST(vec_id AS STRING))) AS h FROM embeddings)"""
SPLITS_SQL = split_sql(LABELLED_SQL, "activo", "row_idx, activo")
EACH_SPLIT_SQL = f"SELECT split, count(*) AS n, count(*) FILTER (activo = 1) AS n_pos FROM ({SPLITS_SQL}) GROUP BY split"


def compounds(spark, d) -> DataFrame:
    """Vectors as descriptors; the value is lowest where the first two add up highest."""
    df = expand_vector(table(spark, d, "embeddings").drop("label"), "embedding", "e", 64)
    return df.withColumns(
        {"Standard Value": -(col("e1") + col("e2")), "Molecule ChEMBL ID": F.concat(F.lit("V"), col("vec_id"))}
    ).withColumnRenamed("vec_id", "row_idx")


def prepared(spark, d):
    return label_and_split(compounds(spark, d))


def forest(spark, d):
    return fit_model(prepared(spark, d), FOREST)


def split_rows(ready, split):
    return ready.table.where(col("split") == split).count()


@query("forest_grown", f"SELECT unnest([10, 20]) AS trees, n AS n_val, true AS learned FROM ({EACH_SPLIT_SQL}) WHERE split = 'val'")
def _(spark, d):
    ready = prepared(spark, d)
    model, n = fit_model(ready, FOREST), split_rows(ready, "val")
    rows = [(h["trees"], n, h["val_auc"] > GOOD) for h in model.history]
    return spark.createDataFrame(rows, "trees int, n_val long, learned boolean")


@query(
    "boosting_stopped",
    f"""SELECT n AS n_val, true AS keeps_first_best, true AS stops_in_time, true AS one_tree_a_round, true AS learned
    FROM ({EACH_SPLIT_SQL}) WHERE split = 'val'""",
)
def _(spark, d):
    ready = prepared(spark, d)
    model = fit_model(ready, BOOSTED)
    aucs = [h["val_auc"] for h in model.history]
    best = aucs.index(max(aucs)) + 1
    stops = len(aucs) == min(best + BOOSTED.early_stopping_rounds, BOOSTED.n_estimators)
    rounds = [h["trees"] for h in model.history] == list(range(1, len(aucs) + 1))
    row = (split_rows(ready, "val"), model.n_trees == best, stops, rounds, max(aucs) > GOOD)
    return spark.createDataFrame([row], "n_val long, keeps_first_best boolean, stops_in_time boolean, one_tree_a_round boolean, learned boolean")


def trained(spark, d):
    return train(compounds(spark, d), scratch_path(spark, "model"), FOREST, cv_k=None)


@query("trained_metrics", f"SELECT split, n, n_pos, true AS learned, true AS bounded FROM ({EACH_SPLIT_SQL})")
def _(spark, d):
    rows = []
    for split, m in trained(spark, d).metrics.items():
        bounded = all(0 <= m[k] <= 1 for k in ("roc_auc", "pr_auc", "f1", "precision", "recall"))
        rows.append((split, m["tn"] + m["fp"] + m["fn"] + m["tp"], m["tp"] + m["fn"], m["roc_auc"] > GOOD, bounded))
    return spark.createDataFrame(rows, "split string, n long, n_pos long, learned boolean, bounded boolean")


@query(
    "run_recorded",
    """SELECT * FROM (VALUES ('cv', 6), ('metrics_test', 9), ('metrics_val', 9), ('run', 6), ('top20_importances', 20)) v(section, n)
    UNION ALL SELECT 'n_features', max(len(embedding)) FROM embeddings""",
)
def _(spark, d):
    info = train(compounds(spark, d), scratch_path(spark, "model"), ForestConfig(n_estimators=10, max_depth=4), cv_k=2).info
    features = info.where("section = 'run' AND key = 'n_features'").select(F.lit("n_features").alias("section"), col("value").cast("long").alias("n"))
    return info.groupBy("section").agg(F.count("*").alias("n")).union(features)


@query("feature_importances", "SELECT unnest(['e1', 'e2']) AS feature, max(len(embedding)) AS n_features FROM embeddings")
def _(spark, d):
    model = forest(spark, d)
    return top_importances(model, 2).select("feature", F.lit(len(model.importances())).cast("long").alias("n_features"))


@query("model_stored_and_loaded", "SELECT vec_id AS row_idx, true AS same FROM embeddings")
def _(spark, d):
    path = scratch_path(spark, "model")
    run = train(compounds(spark, d), path, FOREST, cv_k=None)
    before = run.model.predict(compounds(spark, d), "before", keep=["row_idx"])
    after = load_model(spark, path).predict(compounds(spark, d), "after", keep=["row_idx"])
    return before.join(after, "row_idx").select("row_idx", (col("before") == col("after")).alias("same"))


@query(
    "trained_or_loaded",
    f"""SELECT run, run = 1 AS loaded, n AS n_test, true AS same_metrics FROM ({EACH_SPLIT_SQL})
    CROSS JOIN (VALUES (0), (1)) r(run) WHERE split = 'test'""",
)
def _(spark, d):
    folder = scratch_path(spark, "models")
    runs = [train_or_load(compounds(spark, d), folder, cfg=FOREST, cv_k=None) for _ in range(2)]
    tests = [r.splits.where("split = 'test'").count() for r in runs]
    rows = [(i, run.loaded, n, run.metrics == runs[0].metrics) for i, (run, n) in enumerate(zip(runs, tests))]
    return spark.createDataFrame(rows, "run int, loaded boolean, n_test long, same_metrics boolean")


@query(
    "cross_validated",
    f"""SELECT (SELECT count(*) FROM (VALUES (1), (2)) c(j) WHERE rn > (n * j) // 3) AS fold, count(*) AS n_val,
    count(*) FILTER (activo = 1) AS n_pos, true AS learned FROM (SELECT activo, row_number() OVER (PARTITION BY activo ORDER BY h) AS rn,
        count(*) OVER (PARTITION BY activo) AS n FROM ({LABELLED_SQL})) GROUP BY 1""",
)
def _(spark, d):
    ready = prepared(spark, d)
    cv = cross_validate(ready.table, ready.features, ready.key, ForestConfig(n_estimators=10, max_depth=6), 3)
    learned = col("val_auc").between(GOOD, 1) & (col("train_auc") >= col("val_auc")) & col("val_f1").between(0, 1)
    sizes = cv.scored.groupBy("fold").agg(F.count("*").alias("n_val"), F.count_if(col("activo") == 1).alias("n_pos"))
    return sizes.join(cv.folds.select("fold", learned.alias("learned")), "fold")


@query("scored", "SELECT vec_id AS row_idx, true AS bounded FROM embeddings")
def _(spark, d):
    scored = forest(spark, d).predict(compounds(spark, d), keep=["row_idx"])
    return scored.select("row_idx", col("prob_activo").between(0, 1).alias("bounded"))


@query("scored_in_shards", "SELECT vec_id AS row_idx, true AS same FROM embeddings")
def _(spark, d):
    """A model that is cut into shards of trees scores like the whole one."""
    model = forest(spark, d)
    vectors = model.vectors(compounds(spark, d), ["row_idx"])
    whole, cut = model.score_vectors(vectors, "a"), model.score_vectors(vectors, "b", nodes_per_shard=150)
    same = F.abs(col("a") - col("b")) < 1e-12
    return whole.select("row_idx", "a").join(cut.select("row_idx", "b"), "row_idx").select("row_idx", same.alias("same"))


@query("predicted_results", """SELECT concat('V', CAST(vec_id AS STRING)) AS "ID", true AS follows FROM embeddings""")
def _(spark, d):
    out = predict(compounds(spark, d), forest(spark, d))
    order = Window.orderBy(col("prob_activo").desc(), "row_idx")
    again = out.scored.select(
        col("Molecule ChEMBL ID").alias("ID"), F.row_number().over(order).alias("r"), col("prob_activo").alias("p")
    )
    shown = F.when(col("p") >= 0.5, fixed.ACTIVE).otherwise(fixed.INACTIVE)
    follows = (col("Rank") == col("r")) & (col("Prob_activo") == col("p")) & (col("Prediccion") == shown)
    return out.results.join(again, "ID").select("ID", follows.alias("follows"))


@query("predicted_report", """SELECT concat('V', CAST(vec_id AS STRING)) AS "ID", true AS follows FROM embeddings""")
def _(spark, d):
    out = predict(compounds(spark, d), forest(spark, d))
    names = fixed.REPORT_HEADERS
    again = out.scored.select(col("Molecule ChEMBL ID").alias(names[0]), col("prob_activo").alias("p"))
    active = col("p") >= 0.5
    follows = (
        (F.abs(col(names[1]) - col("p")) <= 0.0005 + 1e-9)
        & (col(names[2]) == F.when(active, fixed.ACTIVE).otherwise(fixed.INACTIVE))
        & (col(names[5]) == F.when(active, fixed.SELECTED).otherwise(fixed.NOT_SELECTED))
    )
    return out.report.join(again, names[0]).select(col(names[0]).alias("ID"), follows.alias("follows"))


def _distinct(rows) -> int:
    return len({json.dumps(json.loads(r["cfg"]), sort_keys=True) for r in rows})


@query("random_search", f"SELECT 3 AS n, 3 AS n_distinct, true AS in_order, true AS bounded, n AS n_val FROM ({EACH_SPLIT_SQL}) WHERE split = 'val'")
def _(spark, d):
    ready = prepared(spark, d)
    rows = random_search(ready, "rf", 3, spaces=SMALL_SPACES).collect()
    aucs = [r["roc_auc"] for r in rows]
    row = (len(rows), _distinct(rows), aucs == sorted(aucs, reverse=True), all(0 <= r["f1"] <= 1 for r in rows), split_rows(ready, "val"))
    return spark.createDataFrame([row], "n int, n_distinct int, in_order boolean, bounded boolean, n_val long")


@query("extended_search", f"SELECT 3 AS n, 3 AS n_distinct, true AS in_order, n AS n_test FROM ({EACH_SPLIT_SQL}) WHERE split = 'test'")
def _(spark, d):
    ready = prepared(spark, d)
    rows = compare(search(ready, trials=2, spaces=SMALL_SPACES), "gap").collect()
    gaps = [abs(r["train_roc_auc"] - r["test_roc_auc"]) for r in rows]
    row = (len(rows), _distinct(rows), gaps == sorted(gaps), split_rows(ready, "test"))
    return spark.createDataFrame([row], "n int, n_distinct int, in_order boolean, n_test long")


def flagship(spark, d) -> DataFrame:
    """Train a small forest on the vectors and return the ranked result table."""
    return predict(compounds(spark, d), forest(spark, d)).results
