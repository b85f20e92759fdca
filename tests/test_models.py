"""Ensembles, storage, training modes, search and reports with a model."""

import json

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from assaylane import fixed
from assaylane.operators.columns import col
from assaylane.operators.metrics import roc_auc
from assaylane.plans import search, store, train
from assaylane.plans.ensembles import (
    VECTOR, BoostedConfig, Ensemble, ForestConfig, assemble, config_from, fit_boosted, fit_forest, tree_shards,
)
from assaylane.plans.predict import predict
from assaylane.session import scratch_path
from checks.models import compounds

FOREST = ForestConfig(n_estimators=9, step=3, patience=2, max_depth=5)


@pytest.fixture(scope="module")
def table(spark, data):
    return compounds(spark, data).cache()


@pytest.fixture(scope="module")
def prepared(table):
    return train.label_and_split(table)


@pytest.fixture(scope="module")
def forest(prepared):
    return train.fit_model(prepared, FOREST)


def test_preparation(prepared):
    assert len(prepared.features) == 64 and prepared.key == "row_idx" and prepared.id_col == "Molecule ChEMBL ID"
    counts = {(r["activo"], r["split"]): r["count"] for r in prepared.table.groupBy("activo", "split").count().collect()}
    assert sum(counts.values()) == 500 and counts[0, "train"] + counts[1, "train"] == 375
    with pytest.raises(ValueError):
        train.label_and_split(prepared.table.drop("Standard Value"))


def test_forest_learns_and_adds_up(forest, prepared, table):
    assert [h["trees"] for h in forest.history][:3] == [3, 6, 9][: len(forest.history)]
    best = max(forest.history, key=lambda h: h["val_auc"])
    assert forest.n_trees <= 9 and best["val_auc"] > 0.5
    scored = forest.score_vectors(forest.vectors(table, ["row_idx"]))
    parts = [
        m.setRawPredictionCol("_one").transform(scored.drop("_one")).select("row_idx", vector_to_array("_one")[1].alias("v"))
        for m in forest.models
    ]
    votes = parts[0]
    for part in parts[1:]:
        votes = votes.unionByName(part)
    mean = votes.groupBy("row_idx").agg((F.sum("v") / forest.n_trees).alias("mean"))
    checked = scored.join(mean, "row_idx").select(F.max(F.abs(col("prob_activo") - col("mean"))).alias("d"),
                                                  F.min("prob_activo").alias("lo"), F.max("prob_activo").alias("hi")).first()
    assert checked["d"] < 1e-12 and 0 <= checked["lo"] and checked["hi"] <= 1
    metrics = train.evaluate_splits(forest, prepared.table)
    assert set(metrics) == {"train", "val", "test"} and metrics["train"]["roc_auc"] > 0.8


def test_importances(forest):
    values = dict(forest.importances())
    assert sum(values.values()) == pytest.approx(1)
    top = [r["feature"] for r in store.top_importances(forest, 5).collect()]
    assert len(top) == 5 and {"e1", "e2"} & set(top[:3])


def test_model_is_stored_and_missing_features_are_imputed(spark, forest, table):
    path = scratch_path(spark, "model")
    with pytest.raises(FileNotFoundError):
        store.load_model(spark, path)
    store.save_model(forest, path, {"note": "ñ"})
    loaded = store.load_model(spark, path)
    assert loaded.config == FOREST and store.load_record(spark, path)["meta"] == {"note": "ñ"}
    for df in (table, table.drop("e5").withColumn("e7", F.lit(None).cast("double"))):
        a = forest.predict(df, keep=["row_idx"]).orderBy("row_idx").collect()
        assert a == loaded.predict(df, keep=["row_idx"]).orderBy("row_idx").collect()


def vectors_of(prepared):
    parts = [prepared.table.where(col("split") == s) for s in ("train", "val")]
    medians = train.fit_median(parts[0], prepared.features)
    return medians, [assemble(x, prepared.features, medians, ["activo"]) for x in parts]


def test_boosting_history_is_that_of_the_prefixes(prepared, monkeypatch):
    from assaylane.plans import ensembles

    fits = []
    grow = ensembles._next_tree
    monkeypatch.setattr(ensembles, "_next_tree", lambda *a: fits.append(a[2]) or grow(*a))
    monkeypatch.setattr(ensembles, "ADVANCE", 3)
    medians, vectors = vectors_of(prepared)
    cfg = BoostedConfig(n_estimators=8, early_stopping_rounds=3, max_depth=3)
    models, history = fit_boosted(*vectors, cfg)
    assert fits == list(range(len(history)))  # every tree is fitted once
    best = max(history, key=lambda h: (h["val_auc"], -h["trees"]))["trees"]
    assert models[0].getNumTrees == best and len(history) == min(best + 3, 8)
    trees, weights = models[0]._call_java("trees"), models[0].treeWeights
    for n in (1, 2, best):  # the stored margins give what a model of the first trees gives
        prefix = ensembles.boosted_model([trees[i] for i in range(n)], weights[:n])
        model = Ensemble(prepared.features, medians, [prefix], cfg)
        auc = roc_auc(model.score_vectors(vectors[1]), "activo", "prob_activo").first()["roc_auc"]
        assert auc == pytest.approx(history[n - 1]["val_auc"], abs=1e-9)
    probs = Ensemble(prepared.features, medians, models, cfg).score_vectors(vectors[1])
    lo, hi = probs.agg(F.min("prob_activo"), F.max("prob_activo")).first()
    assert 0 < lo < hi < 1


def test_forest_windows_give_the_same_history(prepared):
    """Rounds grown between two looks are those that a look after every round would have grown."""
    _, vectors = vectors_of(prepared)
    cfg = ForestConfig(n_estimators=10, step=2, patience=2, max_depth=4)
    models, history = fit_forest(*vectors, cfg)
    aucs = [h["val_auc"] for h in history]
    assert [h["trees"] for h in history] == [2 * (i + 1) for i in range(len(aucs))]
    best, best_auc, stale = 0, float("-inf"), 0
    for i, auc in enumerate(aucs):
        assert stale < 2
        best, best_auc, stale = (i + 1, auc, 0) if auc > best_auc + 1e-6 else (best, best_auc, stale + 1)
    assert len(models) == best and (stale == 2 or len(aucs) == 5)
    single = Ensemble(prepared.features, {}, models[:1], cfg).score_vectors(vectors[1])
    assert roc_auc(single, "activo", "prob_activo").first()["roc_auc"] == pytest.approx(aucs[0], abs=1e-12)


def test_shards_of_trees(prepared, forest, table):
    shards = tree_shards(forest.models, 60)
    assert len(shards) > 2 and sum(len(m.treeWeights) for s in shards for m in s) == forest.n_trees
    for model in (forest, Ensemble(forest.features, forest.medians, [_boosted(prepared)], BoostedConfig())):
        vectors = model.vectors(table, ["row_idx"])
        whole, cut = model.score_vectors(vectors, "a"), model.score_vectors(vectors, "b", nodes_per_shard=20)
        assert cut.columns == [*vectors.columns, "b"]
        both = whole.select("row_idx", "a").join(cut.select("row_idx", "b"), "row_idx")
        assert both.count() == 500 and both.where("abs(a - b) > 1e-12").isEmpty()


def _boosted(prepared):
    _, vectors = vectors_of(prepared)
    return fit_boosted(*vectors, BoostedConfig(n_estimators=3, early_stopping_rounds=3, max_depth=3))[0][0]


def test_depths_and_settings_are_checked(spark, prepared):
    _, vectors = vectors_of(prepared)
    with pytest.raises(ValueError):
        fit_forest(*vectors, ForestConfig(n_estimators=1, max_depth=31))
    with pytest.raises(ValueError):
        config_from("gbt", {"reg_lambda": 1})
    depths = [json.loads(r["cfg"])["max_depth"] for r in search.sample_configs(spark, {"max_depth": [None, 10, 30, 40, 50]}, 9).collect()]
    assert sorted(depths, key=str) == [10, None]


def test_a_commit_cut_short_leaves_the_old_model(spark, forest, monkeypatch):
    from assaylane.sources import versions

    path = scratch_path(spark, "model")
    store.save_model(forest, path, {"note": "old"}, {"info": spark.range(3)})
    with monkeypatch.context() as m:
        m.setattr(store, "write_table", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            store.save_model(forest, path, {"note": "new"}, {"info": spark.range(9)})
    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            store.save_model(forest, path, {"note": "new"}, {"info": spark.range(9)})
    assert store.load_record(spark, path)["meta"] == {"note": "old"} and store.load_table(spark, path, "info").count() == 3
    assert store.load_model(spark, path).n_trees == forest.n_trees
    for i in range(3):
        store.save_model(forest, path, {"note": i})
    assert store.load_record(spark, path)["meta"] == {"note": 2}


def test_train_then_load(spark, table):
    folder = scratch_path(spark, "models")
    first = train.train_or_load(table, folder, cfg=FOREST, cv_k=None)
    assert not first.loaded and first.splits.count() == 500
    again = train.train_or_load(table, folder, cfg=FOREST, cv_k=None)
    assert again.loaded and again.metrics == first.metrics
    info = {(r["section"], r["key"]): r["value"] for r in store.load_table(spark, f"{folder}/base", "info").collect()}
    assert info["run", "n_features"] == "64" and ("metrics_val", "roc_auc") in info and ("metrics_train", "f1") not in info
    assert store.load_table(spark, f"{folder}/base", "splits").count() == 500
    other = train.train_or_load(table.withColumn("e1", col("e1") + 1), folder, cfg=FOREST, cv_k=None)
    assert other.loaded and set(other.metrics) == {"train", "val", "test"}  # other data is evaluated anew
    for mode, name in (("new", None), ("test", None)):
        with pytest.raises(ValueError):
            train.train_or_load(table, folder, mode, name)


def test_named_model_trains_again_with_its_stored_configuration(spark, table):
    folder = scratch_path(spark, "models")
    train.train_or_load(table, folder, "new", "mine", cfg=FOREST, cv_k=None)
    again = train.train_or_load(table, folder, "mine", retrain=True, cv_k=None)
    assert again.model.config == FOREST and not again.loaded


def test_cross_validation(prepared):
    cv = train.cross_validate(prepared.table, prepared.features, "row_idx", ForestConfig(n_estimators=4, max_depth=4), 2)
    got, rows = cv.summary.first(), cv.folds.collect()
    assert cv.scored.groupBy("fold").count().orderBy("fold").collect() == [(0, 250), (1, 250)]
    assert got["cv_k"] == 2 and got["cv_auc_mean"] == pytest.approx(sum(r["val_auc"] for r in rows) / 2)
    assert got["cv_gap_auc_mean"] > 0


def test_config_draw(spark):
    space = fixed.FOREST_SPACE_EXTENDED
    drawn = [json.loads(r["cfg"]) for r in search.sample_configs(spark, space, 7, 3).collect()]
    assert len({json.dumps(c) for c in drawn}) == 7
    assert all(c[k] in space[k] for c in drawn for k in space)
    assert drawn == [json.loads(r["cfg"]) for r in search.sample_configs(spark, space, 7, 3).collect()]
    assert search.sample_configs(spark, {"a": [1, 2]}, 5).count() == 2
    assert config_from("rf", drawn[0]).max_features == drawn[0]["max_features"]


def test_search_and_rankings(prepared):
    spaces = {"rf": {"n_estimators": [2, 3], "max_depth": [2, None]}, "gbt": {"n_estimators": [2], "max_depth": [2, 3]}}
    board = search.search(prepared, trials=2, spaces=spaces).cache()
    rows = board.collect()
    assert [r["algo"] for r in rows] == ["rf", "rf", "gbt", "gbt"]
    best = search.compare(board, "val", 2).collect()
    assert best[0]["val_roc_auc"] == max(r["val_roc_auc"] for r in rows) and len(best) == 2
    assert search.compare(board, "test").first()["test_roc_auc"] == max(r["test_roc_auc"] for r in rows)
    gap = lambda r: abs(r["train_roc_auc"] - r["test_roc_auc"])
    assert gap(search.compare(board, "gap").first()) == min(map(gap, rows))
    with pytest.raises(ValueError):
        search.compare(board, "other")


def test_prediction_tables(forest, table):
    out = predict(table, forest, threshold=0.6)
    assert out.results.count() == 500
    rows = out.results.orderBy("Rank").collect()
    assert [r["Rank"] for r in rows] == list(range(1, 501))
    probs = [r["Prob_activo"] for r in rows]
    assert probs == sorted(probs, reverse=True)
    assert all((r["Prediccion"] == "Activo") == (r["Prob_activo"] >= 0.6) for r in rows)
    assert {r["Filtros"] for r in rows} == {""}
    summary = out.summary.first()
    assert summary["n"] == 500 and summary["n_active"] + summary["n_inactive"] == 500 and summary["n_with_alerts"] is None
    assert out.report.columns == fixed.REPORT_HEADERS
    assert VECTOR not in out.scored.columns
