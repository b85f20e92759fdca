"""Labels, splits, order statistics and metrics."""

import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaylane.functions import seed_hash
from assaylane.operators import impute, labels, metrics, ordering, selection, split
from assaylane.operators.columns import col


def label(spark, numbers, fraction, **limits):
    df = spark.createDataFrame(list(enumerate(numbers)), "id int, v double")
    out = labels.label_by_fraction(df, "v", "id", fraction, **limits)
    return {r["id"]: r["activo"] for r in out.collect()}, labels.label_cutoff(out, "v").first()["cutoff"]


@pytest.mark.parametrize(
    "numbers, fraction, k, cutoff",
    [
        ([1, 2, 3, 4], 0.5, 2, 2),
        ([1, 2, 2, 2, 5], 0.5, 2, 2),
        ([7], 0.1, 1, 7),
        ([1, 2, 3], 1.0, 3, 3),
        ([1, None, 3, 4, 5], 0.5, 2, 3),
        ([float("nan"), 3, 1], 0.5, 1, 1),
    ],
)
def test_label_by_fraction(spark, numbers, fraction, k, cutoff):
    numbers = [None if n is None else float(n) for n in numbers]
    got, cut = label(spark, numbers, fraction)
    assert sum(got.values()) == k
    assert cut == cutoff
    kept = [n for n in numbers if n is not None and n == n]
    assert all(not got[i] for i, n in enumerate(numbers) if n is None or n != n or n > sorted(kept)[k - 1])


def test_label_fraction_range(spark):
    for fraction in (0, 1.1):
        with pytest.raises(ValueError):
            label(spark, [1.0], fraction)


def test_label_without_values(spark):
    got, cut = label(spark, [None, None], 0.5)
    assert set(got.values()) == {0} and cut is None


def test_label_with_a_hot_tied_value_in_many_passes(spark):
    rng = random.Random(3)
    numbers = [5.0 if rng.random() < 0.6 else rng.lognormvariate(1, 3) for _ in range(5000)]
    got, cut = label(spark, numbers, 0.5, final_rows=20)
    assert sum(got.values()) == 2500 and cut == 5.0
    df = spark.createDataFrame(list(enumerate(numbers)), "id int, v double").withColumn("h", seed_hash("id"))
    want = {r["id"] for r in df.orderBy("v", "h").limit(2500).collect()}
    assert {i for i, y in got.items() if y} == want


def test_result_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select("id", (col("id") % 7).alias("y"), (col("id") % 11).cast("double").alias("v"))
    one, many = df.coalesce(1), df.repartition(13)
    for add in (
        lambda d: labels.label_by_fraction(d, "v", "id", 0.3),
        lambda d: split.stratified_split(d, "y", "id"),
        lambda d: split.stratified_folds(d, "y", "id"),
        lambda d: split.sample_n(d, "id", 50),
    ):
        assert sorted(add(one).collect()) == sorted(add(many).collect())


def test_split_shares(spark):
    df = spark.range(1003).select("id", (col("id") < 300).cast("int").alias("y"))
    rows = split.stratified_split(df, "y", "id").groupBy("y", "split").count().collect()
    got = {(r["y"], r["split"]): r["count"] for r in rows}
    assert got == {(0, "train"): 527, (1, "train"): 225, (0, "val"): 105, (1, "val"): 45, (0, "test"): 71, (1, "test"): 30}
    assert sum(n for (_, s), n in got.items() if s == "train") == 752
    assert all(abs(got[y, s] - share * n) <= 1.5 for y, n in ((0, 703), (1, 300))
               for s, share in (("train", 0.75), ("val", 0.15), ("test", 0.1)))


def test_split_checks(spark):
    df = spark.range(20).select("id", (col("id") % 2).alias("y"))
    for train, val in ((0, 0.1), (1, 0), (0.9, 0.1), (0.5, -0.1)):
        with pytest.raises(ValueError):
            split.stratified_split(df, "y", "id", train, val)
    counted = split.stratified_split(df, "y", "id", 0.5, 0).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in counted} == {"train": 10, "test": 10}


def test_split_needs_labels(spark):
    for add in (lambda d: split.stratified_split(d, "y", "id"), lambda d: labels.with_class_weight(d, "y")):
        with pytest.raises(ValueError):
            add(spark.createDataFrame([(1, None), (2, 1)], "id int, y int"))


@pytest.mark.parametrize("indexed", [True, False])
def test_rows_with_one_id_are_labelled_and_split(spark, indexed):
    df = spark.range(400).select(F.lit("one").alias("id"), (col("id") % 2).alias("y"), F.lit(1.5).alias("v"), col("id").alias("row_idx"))
    df = df if indexed else df.drop("row_idx")
    out = split.stratified_split(df, "y", "id", 0.5, 0.25)
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert counts == {(y, s): n for y in (0, 1) for s, n in (("train", 100), ("val", 50), ("test", 50))}
    assert out.columns == [*df.columns, "split"]
    labelled = labels.label_by_fraction(df, "v", "id", 0.25)
    assert labelled.where("activo = 1").count() == 100 and labelled.columns == [*df.columns, "activo"]
    if indexed:  # the index decides, so a part of one id is the same rows every time
        assert {r["row_idx"] for r in labelled.where("activo = 1").collect()} == set(range(100))


def test_many_classes(spark):
    df = spark.range(9000).select("id", (col("id") % 1500).cast("string").alias("y"))
    out = split.stratified_folds(df, "y", "id", 3).groupBy("y", "fold").count().collect()
    assert len(out) == 4500 and {r["count"] for r in out} == {2}
    shares = split.stratified_split(df, "y", "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in shares} == {"train": 6750, "val": 1350, "test": 900}


def test_selection_in_many_passes(spark, monkeypatch):
    monkeypatch.setattr(selection, "ROWS_PER_PREFIX", 3)
    df = spark.range(4000).select("id", (col("id") % 3 == 0).cast("int").alias("y"))
    out = split.stratified_folds(df, "y", "id", 4).withColumn("h", seed_hash("id"))
    for y in (0, 1):
        rows = sorted((r["h"], r["fold"]) for r in out.where(col("y") == y).collect())
        folds = [fold for _, fold in rows]
        assert folds == sorted(folds)
        sizes = [folds.count(i) for i in range(4)]
        assert max(sizes) - min(sizes) <= 1
    same = df.select(F.lit("x").alias("id"), "y", col("id").alias("row_idx"))
    counts = split.stratified_split(same, "y", "id", 0.5, 0.25).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in counts} == {"train": 2000, "val": 1000, "test": 1000}


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "activo int")
    weights = {(r["activo"], r["weight"]) for r in labels.with_class_weight(df).collect()}
    assert weights == {(1, 2.0), (0, 4 / 6)}


@pytest.mark.parametrize("limits", [{}, {"final_rows": 3}])
def test_medians(spark, limits):
    rng = random.Random(1)
    columns = {
        "even": [1.0, 2.0, 3.0, 10.0] * 50,
        "skew": [rng.lognormvariate(0, 4) for _ in range(200)],
        "hot": [0.0] * 120 + [rng.random() for _ in range(80)],
        "gaps": [None if i % 3 else float(i) for i in range(200)],
        "nan": [float("nan") if i % 2 else float(-i) for i in range(200)],
        "edge": [float("inf"), float("-inf")] * 50 + [1.0] * 51 + [2.0] * 49,
        "tiny": [5e-324, 0.0, -5e-324, 1e308] * 50,
        "none": [None] * 200,
    }
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    got = impute.fit_median(df, list(columns), **limits)
    for name, numbers in columns.items():
        kept = [n for n in numbers if n is not None and n == n]
        if kept:
            assert got[name] == statistics.median(kept), name
        else:
            assert name not in got
    out = impute.apply_median(df, got)
    assert out.columns == [c for c in columns if c != "none"]
    assert out.where("gaps is null or isnan(nan)").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.integers(1, 5))
def test_values_at_ranks_property(spark, numbers, final_rows):
    df = spark.createDataFrame([(float(n),) for n in numbers], "v double")
    ranks = lambda n: [1, (n + 1) // 2, n]
    _, got = ordering.values_at_ranks(df, ["v"], ranks, final_rows=final_rows)
    assert got["v"] == [sorted(numbers)[r - 1] for r in ranks(len(numbers))]


def test_ordered_index(spark):
    df = spark.range(5000).select("id", F.when(col("id") % 3 == 0, 1.0).otherwise(F.rand(5)).alias("v"))
    df = df.repartition(9).cache()
    got = ordering.ordered_index(df, [col("v").desc(), col("id")], "rn")
    rows = got.orderBy("rn").collect()
    want = sorted(df.collect(), key=lambda r: (-r["v"], r["id"]))
    assert [(r["id"], r["rn"]) for r in rows] == [(r["id"], i + 1) for i, r in enumerate(want)]


SCORED = [(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.5), (0, 0.1)]


def test_metrics_of_the_small_table(spark):
    df = spark.createDataFrame(SCORED, "y int, p double")
    got = metrics.evaluate(df, "y", "p").first()
    assert got["roc_auc"] == pytest.approx(0.75)
    assert got["pr_auc"] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (3, 1, 0, 1)
    assert got["precision"] == 0.75 and got["recall"] == 1 and got["f1"] == pytest.approx(6 / 7)


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    got = metrics.evaluate(df, "y", "p").first()
    assert got["roc_auc"] is None and got["f1"] == 0 and got["precision"] == 0


def brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y != 1]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("rows_per_task", [None, 50])
def test_auc_against_brute_force_and_mirrored(spark, rows_per_task):
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), 0.5 if rng.random() < 0.4 else round(rng.random(), 2)) for _ in range(800)]
    df = spark.createDataFrame([(y, p, i % 2) for i, (y, p) in enumerate(rows)], "y int, p double, g int")
    auc = metrics.roc_auc(df, "y", "p", rows_per_task=rows_per_task).first()["roc_auc"]
    assert auc == pytest.approx(brute_auc(rows), abs=1e-12)
    mirrored = metrics.roc_auc(df.withColumn("p", -col("p")), "y", "p", rows_per_task=rows_per_task)
    assert auc + mirrored.first()["roc_auc"] == pytest.approx(1)
    per_group = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, "y", "p", ["g"], rows_per_task=rows_per_task).collect()}
    for g in (0, 1):
        assert per_group[g] == pytest.approx(brute_auc(rows[g::2]), abs=1e-12)


def test_running_totals_use_no_single_partition(spark):
    df = spark.range(10_000).select((col("id") % 2).alias("y"), F.rand(1).alias("p")).cache()
    plan = metrics.score_totals(df, "y", "p", rows_per_task=1000)._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window [sum") :].split("Join")[-1]
    assert "hashpartitioning(_range" in window


def test_confusion_matrix_has_all_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, pred int")
    assert [tuple(r) for r in metrics.confusion_matrix(df, "y", "pred").orderBy("real").collect()] == [(0, 0, 0), (1, 0, 2)]


def test_minmax(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "z double")
    assert [r["z"] for r in metrics.minmax_scale(df, "z").collect()] == pytest.approx([0, 1, 0.5], abs=1e-8)
    flat = spark.createDataFrame([(2.0,)], "z double")
    assert metrics.minmax_scale(flat, "z").first()["z"] == 0


def test_zip_columns(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1), ("z", 3)], "a string, o int")
    b = spark.createDataFrame([("p", 9)], "b string, o int")
    empty = spark.createDataFrame([], "c string, o int")
    out = sorted(split.zip_columns([a, b, empty], "o").collect(), key=str)
    assert out == [("x", None, None), ("y", "p", None), ("z", None, None)]
