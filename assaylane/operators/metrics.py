"""Binary classification metrics as grouped sums.

Ranking metrics add up positives and negatives per distinct score and run over the scores from the
highest down, so tied scores are handled exactly. ``keys`` (split, fold, ...) gives one result per
group in the same pass. A true class is 1, anything else is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylane.operators.columns import col
from assaylane.operators.ordering import running_totals


def score_totals(
    df: DataFrame, y: str, score: str, keys: Sequence[str] = (), rows_per_task: int | None = None, range_name: str | None = None
) -> DataFrame:
    """Per distinct score, from the highest: positives and negatives, and both sums down to it.

    A row without a score is an error, as leaving it out would flatter the model.
    """
    value = col(score).cast("double")
    missing = F.raise_error(F.lit(f"rows without a score in {score}")).cast("double")
    checked = df.withColumn(score, F.when(value.isNull() | F.isnan(value), missing).otherwise(value))
    amounts = {"pos": (col(y) == 1).cast("long"), "neg": (col(y) != 1).cast("long")}
    return running_totals(checked, score, amounts, keys, descending=True, rows_per_task=rows_per_task, range_name=range_name)


def thinned_totals(df: DataFrame, y: str, score: str, keys: Sequence[str], corner: Callable, **limits) -> DataFrame:
    """The rows of ``score_totals`` that are corners of a curve: ``corner(before, here, after)`` of the running sums.

    The neighbours of a row at the border of a value range come from the ranges beside it, so ranges stay apart.
    Before the first row lies the point without any hit; the last row stays.
    """
    rng = "_value_range"
    totals = score_totals(df, y, score, keys, range_name=rng, **limits)
    group = [col(k) for k in keys]
    point = F.struct(F.col("cum_neg").cast("decimal(19,0)").alias("x"), F.col("cum_pos").cast("decimal(19,0)").alias("y"))
    inside = Window.partitionBy(*group, rng).orderBy(col(score).desc())
    names = [f"_k{i}" for i in range(len(keys))]
    across = Window.partitionBy(*names).orderBy(F.col("_r").desc())
    borders = (
        totals.groupBy(*[k.alias(n) for k, n in zip(group, names)], F.col(rng).alias("_r"))
        .agg(F.max_by(point, col(score)).alias("first"), F.min_by(point, col(score)).alias("last"))
        .select(*names, "_r", F.lag("last").over(across).alias("_last"), F.lead("first").over(across).alias("_first"))
    )
    same = F.col(rng) == F.col("_r")
    for k, n in zip(group, names):
        same = same & k.eqNullSafe(F.col(n))
    beside = totals.select("*", F.lag(point).over(inside).alias("_before"), F.lead(point).over(inside).alias("_after")).join(borders, same)
    origin = F.struct(*[F.lit(0).cast("decimal(19,0)").alias(n) for n in "xy"])
    before, after = F.coalesce("_before", "_last", origin), F.coalesce("_after", "_first")
    kept = beside.where(after.isNull() | corner(before, point, after))
    return kept.select(*[c for c in totals.columns if c != rng])


def _bends(before: Column, here: Column, after: Column) -> Column:
    """Not on the line through its neighbours."""
    step = lambda a, b, c: b[c] - a[c]
    return step(before, here, "x") * step(here, after, "y") != step(before, here, "y") * step(here, after, "x")


def _turns(before: Column, here: Column, after: Column) -> Column:
    """A corner in precision and recall: between points of one recall, or without a miss so far, lies a line."""
    level = (before["y"] == here["y"]) & (here["y"] == after["y"])
    return ~(level | (after["x"] == 0))


def _auc() -> Column:
    """1 - P(negative ranked over positive), ties counted half; null unless both classes occur."""
    missed = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return 1.0 - F.try_divide(missed, pairs)


def _average_precision() -> Column:
    hits = F.col("cum_pos").cast("double")
    steps = F.sum(F.col("pos") * hits / (F.col("cum_pos") + F.col("cum_neg")))
    return F.coalesce(F.try_divide(steps, F.sum("pos")), F.lit(0.0))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def roc_auc(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), **limits) -> DataFrame:
    totals = score_totals(df, y, score, keys, **limits)
    return totals.groupBy(*[col(k) for k in keys]).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), **limits) -> DataFrame:
    totals = score_totals(df, y, score, keys, **limits)
    return totals.groupBy(*[col(k) for k in keys]).agg(_average_precision().alias("pr_auc"))


def prf(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """F1, precision and recall of 0/1 predictions; 0 where undefined."""
    real, said = col(y) == 1, col(pred) == 1
    tp, fp, fn = F.count_if(real & said), F.count_if(~real & said), F.count_if(real & ~said)
    return df.groupBy(*[col(k) for k in keys]).agg(
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
    )


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Two rows (real class 0 and 1), counts per predicted class. One aggregate, zeros included."""
    real, said = (col(y) == 1).cast("int"), (col(pred) == 1).cast("int")
    cells = df.agg(
        *[F.count_if((real == r) & (said == p)).alias(f"n{r}{p}") for r in (0, 1) for p in (0, 1)]
    )
    rows = [
        F.struct(F.lit(r).alias("real"), F.col(f"n{r}0").alias("pred_0"), F.col(f"n{r}1").alias("pred_1"))
        for r in (0, 1)
    ]
    return cells.select(F.inline(F.array(*rows)))


def roc_curve(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), thin: bool = False, **limits) -> DataFrame:
    """Points ``fpr, tpr, threshold`` per distinct score, plus the origin at an infinite threshold.

    With ``thin``, points on a line between their neighbours are left out: the same curve in fewer rows.
    """
    totals = thinned_totals(df, y, score, keys, _bends, **limits) if thin else score_totals(df, y, score, keys, **limits)
    points = _with_class_totals(totals, keys)
    group = [col(k) for k in keys]
    curve = points.select(
        *group,
        _ratio_or_null(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        _ratio_or_null(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
        col(score).alias("threshold"),
    )
    start = df.select(*group).distinct() if keys else df.sparkSession.range(1).drop("id")
    origin = start.select(*group, *[F.lit(v).alias(n) for n, v in (("fpr", 0.0), ("tpr", 0.0), ("threshold", float("inf")))])
    return origin.unionByName(curve)


def pr_curve(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), thin: bool = False, **limits) -> DataFrame:
    """Points ``precision, recall, threshold`` per distinct score, plus (1, 0) without a threshold. ``thin`` as above."""
    totals = thinned_totals(df, y, score, keys, _turns, **limits) if thin else score_totals(df, y, score, keys, **limits)
    points = _with_class_totals(totals, keys)
    group = [col(k) for k in keys]
    hits = F.col("cum_pos")
    curve = points.select(
        *group,
        (hits.cast("double") / (hits + F.col("cum_neg"))).alias("precision"),
        F.coalesce(_ratio_or_null(hits, F.col("all_pos")), F.lit(1.0)).alias("recall"),
        col(score).alias("threshold"),
    )
    start = df.select(*group).distinct() if keys else df.sparkSession.range(1).drop("id")
    end = start.select(
        *group, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return end.unionByName(curve)


def _ratio_or_null(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _with_class_totals(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the class totals of each group to its points: the running sums at the last one."""
    sums = [F.max("cum_pos").alias("all_pos"), F.max("cum_neg").alias("all_neg")]
    if not keys:
        row = totals.agg(*sums).first()
        return totals.select("*", *[F.lit(row[n]).cast("long").alias(n) for n in ("all_pos", "all_neg")])
    per_key = totals.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*sums)
    same = None
    for i, k in enumerate(keys):
        match = col(k).eqNullSafe(F.col(f"_k{i}"))
        same = match if same is None else same & match
    return totals.join(per_key, same).drop(*[f"_k{i}" for i in range(len(keys))])


def evaluate(
    df: DataFrame, y: str, score: str, threshold: float = 0.5, keys: Sequence[str] = (), **limits
) -> DataFrame:
    """All metrics of one scored table in one pass: one row per group.

    ``roc_auc, pr_auc, f1, precision, recall`` and the confusion counts ``tn, fp, fn, tp``. The
    threshold metrics come from the same per-score counts as the ranking ones.
    """
    totals = score_totals(df, y, score, keys, **limits)
    said = col(score) >= F.lit(float(threshold))
    part = lambda name, where: F.coalesce(F.sum(F.when(where, F.col(name))), F.lit(0))
    tp, fp, fn, tn = part("pos", said), part("neg", said), part("pos", ~said), part("neg", ~said)
    return totals.groupBy(*[col(k) for k in keys]).agg(
        _auc().alias("roc_auc"),
        _average_precision().alias("pr_auc"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        tn.alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        tp.alias("tp"),
    )


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation over folds, from ``val_auc, val_f1, train_auc`` per fold."""
    return folds.agg(
        F.count("*").alias("cv_k"),
        F.avg("val_auc").alias("cv_auc_mean"),
        F.stddev_pop("val_auc").alias("cv_auc_std"),
        F.avg("val_f1").alias("cv_f1_mean"),
        F.stddev_pop("val_f1").alias("cv_f1_std"),
        F.avg(F.col("train_auc") - F.col("val_auc")).alias("cv_gap_auc_mean"),
    )


def minmax_scale(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Scale margins to 0..1 with a guard against a zero range."""
    span = df.agg(F.min(col(name)).alias("lo"), F.max(col(name)).alias("hi")).first()
    if span["lo"] is None:
        return df.withColumn(out or name, col(name).cast("double"))
    scaled = (col(name) - F.lit(span["lo"])) / (F.lit(span["hi"]) - F.lit(span["lo"]) + F.lit(1e-9))
    return df.withColumn(out or name, scaled)
