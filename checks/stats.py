"""Labels, splits, imputation and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylane.operators import impute, labels, metrics, ordering, split
from assaylane.operators.columns import col
from checks.registry import query
from checks.standins import JUDGED_SQL, judged, table

EVENT_HASH = "md5(concat_ws('|', '1234', CAST(event_id AS STRING)))"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "value")


def label_sql(fraction: str) -> str:
    return f"""SELECT event_id, event_type, value,
        CASE WHEN rn <= greatest(1, floor({fraction} * n)) THEN 1 ELSE 0 END AS activo FROM (
        SELECT *, row_number() OVER (ORDER BY value, {EVENT_HASH}) AS rn, count(*) OVER () AS n FROM events)"""


def labelled(spark, d, fraction=0.5, **limits):
    return labels.label_by_fraction(events(spark, d), "value", "event_id", fraction, **limits)


@query("labelled_by_fraction", label_sql("0.5e0"))
def _(spark, d):
    return labelled(spark, d)


@query("labelled_lowest_third", label_sql("0.33e0"))
def _(spark, d):
    return labelled(spark, d, 0.33, final_rows=100)


@query("label_cutoff", f"SELECT max(value) AS cutoff FROM ({label_sql('0.5e0')}) WHERE activo = 1")
def _(spark, d):
    return labels.label_cutoff(labelled(spark, d), "value")


@query("class_distribution", f"SELECT activo, count(*) AS n FROM ({label_sql('0.33e0')}) GROUP BY activo")
def _(spark, d):
    return labels.class_distribution(labelled(spark, d, 0.33))


@query(
    "class_weights",
    """SELECT event_id, n / (k * nk) AS weight FROM events JOIN (SELECT event_type, count(*) AS nk,
    CAST(sum(count(*)) OVER () AS DOUBLE) AS n, count(*) OVER () AS k FROM events GROUP BY event_type) USING (event_type)""",
)
def _(spark, d):
    return labels.with_class_weight(events(spark, d), "event_type").select("event_id", "weight")


def allocated_sql(source: str, size: str, name: str) -> str:
    """Largest-remainder shares of ``size`` rows over the classes ``y`` with ``k`` rows in ``source``."""
    return f"""SELECT y, k, whole + CASE WHEN r <= size - placed THEN 1 ELSE 0 END AS {name} FROM (
        SELECT *, floor(share) AS whole, sum(floor(share)) OVER () AS placed,
            row_number() OVER (ORDER BY share - floor(share) DESC, y) AS r
        FROM (SELECT *, size * k / n AS share FROM (
            SELECT *, {size} AS size FROM (SELECT y, k, sum(k) OVER () AS n FROM {source}))))"""


def split_sql(source: str, y: str, columns: str) -> str:
    """``columns`` and the split of the rows of ``source``, which has the class ``y`` and the order ``h`` within it."""
    train = allocated_sql(f"(SELECT {y} AS y, count(*)::DOUBLE AS k FROM s GROUP BY 1)", "floor(0.75e0 * n)", "n_train")
    val = allocated_sql("(SELECT y, k - n_train AS k FROM tr)", "floor(0.15e0 / (0.15e0 + (1e0 - 0.75e0 - 0.15e0)) * n)", "n_val")
    return f"""WITH s AS ({source}), tr AS ({train}), va AS ({val}) SELECT {columns},
    CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'val' ELSE 'test' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY {y} ORDER BY h) AS rn FROM s) e JOIN tr ON tr.y = {y} JOIN va ON va.y = {y}"""


SPLIT_SQL = split_sql(f"SELECT *, {EVENT_HASH} AS h FROM events", "event_type", "event_id, event_type, value")


def splitted(spark, d):
    return split.stratified_split(events(spark, d), "event_type", "event_id")


@query("stratified_split", SPLIT_SQL)
def _(spark, d):
    return splitted(spark, d)


# a class for every customer, and ids that repeat within it: rows of one id go by their index
BY_CUSTOMER_SQL = """SELECT o_orderkey, o_custkey, md5(concat_ws('|', '1234', o_orderpriority)) || lpad(lower(hex(o_orderkey)), 16, '0') AS h
    FROM orders"""


@query("split_of_many_classes", split_sql(BY_CUSTOMER_SQL, "o_custkey", "o_orderkey, o_custkey"))
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return split.stratified_split(orders, "o_custkey", "o_orderpriority", ties="o_orderkey").drop("o_orderpriority")


@query(
    "labelled_with_repeated_ids",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderstatus, h) <= floor(0.4e0 * count(*) OVER ()) THEN 1 ELSE 0 END AS activo
    FROM (SELECT o_orderkey, ascii(o_orderstatus) AS o_orderstatus, h FROM ({BY_CUSTOMER_SQL}) JOIN orders USING (o_orderkey))""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.ascii("o_orderstatus").alias("v"))
    return labels.label_by_fraction(orders, "v", "o_orderpriority", 0.4, ties="o_orderkey").select("o_orderkey", "activo")


@query("split_ids", f"SELECT CAST(event_id AS VARCHAR) AS id, split FROM ({SPLIT_SQL})")
def _(spark, d):
    return split.split_ids(splitted(spark, d), "event_id")


def wide_sql(source: str) -> str:
    return f"""SELECT max(CASE WHEN split = 'train' THEN id END) AS train_ids, max(CASE WHEN split = 'val' THEN id END) AS val_ids,
        max(CASE WHEN split = 'test' THEN id END) AS test_ids FROM (SELECT split, CAST(event_id AS VARCHAR) AS id,
        row_number() OVER (PARTITION BY split ORDER BY event_id) AS rn FROM ({source})) GROUP BY rn"""


@query("split_ids_wide", wide_sql(SPLIT_SQL))
def _(spark, d):
    return split.split_table_wide(splitted(spark, d), "event_id", "event_id")


@query(
    "columns_zipped",
    """SELECT max(CASE WHEN l = 0 THEN v END) AS segment, max(CASE WHEN l = 1 THEN v END) AS nation,
    max(CASE WHEN l = 2 THEN v END) AS supplier FROM (
    SELECT l, v, row_number() OVER (PARTITION BY l ORDER BY o) AS rn FROM (
        SELECT 0 AS l, c_mktsegment AS v, c_custkey AS o FROM customer
        UNION ALL SELECT 1, n_name, n_nationkey FROM nation UNION ALL SELECT 2, s_name, s_suppkey FROM supplier))
    GROUP BY rn""",
)
def _(spark, d):
    lists = [
        table(spark, d, "customer").select(col("c_mktsegment").alias("segment"), col("c_custkey").alias("o")),
        table(spark, d, "nation").select(col("n_name").alias("nation"), col("n_nationkey").cast("long").alias("o")),
        table(spark, d, "supplier").select(col("s_name").alias("supplier"), col("s_suppkey").alias("o")),
    ]
    return split.zip_columns(lists, "o")


@query(
    "stratified_folds",
    f"""SELECT event_id, event_type, (SELECT count(*) FROM (VALUES (1), (2), (3), (4)) c(j) WHERE rn > (n * j) // 5) AS fold
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {EVENT_HASH}) AS rn,
        count(*) OVER (PARTITION BY event_type) AS n FROM events)""",
)
def _(spark, d):
    return split.stratified_folds(events(spark, d).drop("value"), "event_type", "event_id", 5)


@query("sample", f"SELECT event_id, value FROM events ORDER BY {EVENT_HASH} LIMIT 500")
def _(spark, d):
    return split.sample_n(events(spark, d), "event_id", 500).select("event_id", "value")


GAPPY_SQL = """SELECT l_orderkey, l_partkey, CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice END AS price,
    CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity END AS quantity, l_tax AS tax, l_shipdate < TIMESTAMP '1998-01-01' AS old
    FROM lineitem"""


def gappy(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.when(col("l_tax") != 0, col("l_extendedprice")).alias("price"),
        F.when(col("l_discount") != 0, col("l_quantity")).alias("quantity"),
        col("l_tax").alias("tax"),
        (col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("old"),
    )


IMPUTED_SQL = f"""SELECT l_orderkey, l_partkey, coalesce(price, (SELECT median(price) FROM g WHERE old)) AS price,
    coalesce(quantity, (SELECT median(quantity) FROM g WHERE old)) AS quantity,
    coalesce(tax, (SELECT median(tax) FROM g WHERE old)) AS tax FROM g"""


def _imputed(spark, d, **limits):
    df = gappy(spark, d)
    medians = impute.fit_median(df.where("old"), ["price", "quantity", "tax"], **limits)
    return impute.apply_median(df, medians, ["l_orderkey", "l_partkey"])


@query("median_imputed", f"WITH g AS ({GAPPY_SQL}) {IMPUTED_SQL}")
def _(spark, d):
    return _imputed(spark, d)


@query("median_imputed_by_passes", f"WITH g AS ({GAPPY_SQL}) {IMPUTED_SQL}")
def _(spark, d):
    return _imputed(spark, d, final_rows=50)


def totals_sql(source: str, keys: str = "") -> str:
    """Per score (and key): class counts and running sums from the highest score down."""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"{keys}, " if keys else ""
    over = f"OVER ({part}ORDER BY score DESC)"
    return f"""SELECT {group}score, pos, neg, CAST(sum(pos) {over} AS BIGINT) AS cum_pos,
        CAST(sum(neg) {over} AS BIGINT) AS cum_neg FROM (
        SELECT {group}score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM ({source})
        GROUP BY {group}score)"""


AUC_SQL = "round(1 - sum(pos * (cum_neg - neg / 2.0e0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0), 9)"
AP_SQL = "round(coalesce(sum(pos * (cum_pos / (cum_pos + cum_neg)::DOUBLE)) / nullif(sum(pos), 0), 0), 9)"
PRF_SQL = """round(coalesce(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
    round(coalesce(1.0e0 * tp / nullif(tp + fp, 0), 0), 9) AS "precision", round(coalesce(1.0e0 * tp / nullif(tp + fn, 0), 0), 9) AS recall"""
CELLS_SQL = """count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y <> 1 AND pred = 1) AS fp,
    count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y <> 1 AND pred = 0) AS tn"""


def rounded(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else col(c) for c in df.columns])


@query("running_sums", totals_sql(JUDGED_SQL))
def _(spark, d):
    return metrics.score_totals(judged(spark, d), "y", "score", rows_per_task=40)


@query("roc_auc", f"SELECT {AUC_SQL} AS roc_auc FROM ({totals_sql(JUDGED_SQL)})")
def _(spark, d):
    return rounded(metrics.roc_auc(judged(spark, d), "y", "score"), "roc_auc")


@query("roc_auc_by_group", f"SELECT lang, {AUC_SQL} AS roc_auc FROM ({totals_sql(JUDGED_SQL, 'lang')}) GROUP BY lang")
def _(spark, d):
    auc = metrics.roc_auc(judged(spark, d), "y", "score", ["lang"], rows_per_task=40)
    return rounded(auc, "roc_auc")


@query("average_precision", f"SELECT {AP_SQL} AS pr_auc FROM ({totals_sql(JUDGED_SQL)})")
def _(spark, d):
    return rounded(metrics.average_precision(judged(spark, d), "y", "score"), "pr_auc")


@query("precision_recall_f1", f"SELECT {PRF_SQL} FROM (SELECT {CELLS_SQL} FROM ({JUDGED_SQL}))")
def _(spark, d):
    return rounded(metrics.prf(judged(spark, d), "y", "pred"), "f1", "precision", "recall")


@query(
    "confusion_matrix",
    f"""SELECT real, count(*) FILTER (y = real AND pred = 0) AS pred_0, count(*) FILTER (y = real AND pred = 1) AS pred_1
    FROM ({JUDGED_SQL}) CROSS JOIN (VALUES (0), (1)) r(real) GROUP BY real""",
)
def _(spark, d):
    return metrics.confusion_matrix(judged(spark, d), "y", "pred")


@query(
    "roc_curve",
    f"""WITH t AS ({totals_sql(JUDGED_SQL)}) SELECT round(cum_neg / (SELECT sum(neg) FROM t)::DOUBLE, 9) AS fpr,
    round(cum_pos / (SELECT sum(pos) FROM t)::DOUBLE, 9) AS tpr, score AS threshold FROM t
    UNION ALL SELECT 0, 0, CAST('inf' AS DOUBLE)""",
)
def _(spark, d):
    return rounded(metrics.roc_curve(judged(spark, d), "y", "score"), "fpr", "tpr")


@query(
    "precision_recall_curve",
    f"""WITH t AS ({totals_sql(JUDGED_SQL, 'toxic')}) SELECT toxic, round(cum_pos / (cum_pos + cum_neg)::DOUBLE, 9) AS "precision",
    round(cum_pos / (sum(pos) OVER (PARTITION BY toxic))::DOUBLE, 9) AS recall, score AS threshold FROM t
    UNION ALL SELECT DISTINCT toxic, 1, 0, CAST(NULL AS DOUBLE) FROM t""",
)
def _(spark, d):
    return rounded(metrics.pr_curve(judged(spark, d), "y", "score", ["toxic"]), "precision", "recall")


# corners of the curve: points that are not on the line through their neighbours
THINNED_SQL = f"""WITH t AS (SELECT * FROM ({totals_sql(JUDGED_SQL, 'toxic')})), n AS (SELECT *,
    coalesce(lag(cum_neg) OVER w, 0) AS px, coalesce(lag(cum_pos) OVER w, 0) AS py, lead(cum_neg) OVER w AS nx, lead(cum_pos) OVER w AS ny,
    sum(neg) OVER (PARTITION BY toxic) AS all_neg, sum(pos) OVER (PARTITION BY toxic) AS all_pos
    FROM t WINDOW w AS (PARTITION BY toxic ORDER BY score DESC))"""


@query(
    "roc_curve_thinned",
    f"""{THINNED_SQL} SELECT toxic, round(cum_neg / all_neg::DOUBLE, 9) AS fpr, round(cum_pos / all_pos::DOUBLE, 9) AS tpr, score AS threshold
    FROM n WHERE nx IS NULL OR (cum_neg - px) * (ny - cum_pos) <> (cum_pos - py) * (nx - cum_neg)
    UNION ALL SELECT DISTINCT toxic, 0, 0, CAST('inf' AS DOUBLE) FROM t""",
)
def _(spark, d):
    return rounded(metrics.roc_curve(judged(spark, d), "y", "score", ["toxic"], thin=True, rows_per_task=40), "fpr", "tpr")


@query(
    "precision_recall_curve_thinned",
    f"""{THINNED_SQL} SELECT toxic, round(cum_pos / (cum_pos + cum_neg)::DOUBLE, 9) AS "precision", round(cum_pos / all_pos::DOUBLE, 9) AS recall,
    score AS threshold FROM n WHERE nx IS NULL OR NOT ((py = cum_pos AND cum_pos = ny) OR nx = 0)
    UNION ALL SELECT DISTINCT toxic, 1, 0, CAST(NULL AS DOUBLE) FROM t""",
)
def _(spark, d):
    return rounded(metrics.pr_curve(judged(spark, d), "y", "score", ["toxic"], thin=True, rows_per_task=40), "precision", "recall")


def evaluated_sql(keys: str) -> str:
    return f"""SELECT {keys}, roc_auc, pr_auc, {PRF_SQL}, tn, fp, fn, tp FROM
        (SELECT {keys}, {AUC_SQL} AS roc_auc, {AP_SQL} AS pr_auc FROM ({totals_sql(JUDGED_SQL, keys)}) GROUP BY {keys})
        JOIN (SELECT {keys}, {CELLS_SQL} FROM ({JUDGED_SQL}) GROUP BY {keys}) USING ({keys})"""


METRICS = ("roc_auc", "pr_auc", "f1", "precision", "recall")


@query("evaluated", evaluated_sql("toxic"))
def _(spark, d):
    return rounded(metrics.evaluate(judged(spark, d), "y", "score", keys=["toxic"]), *METRICS)


@query(
    "fold_summary",
    f"""SELECT count(*) AS cv_k, round(avg(roc_auc), 9) AS cv_auc_mean, round(stddev_pop(roc_auc), 9) AS cv_auc_std,
    round(avg(f1), 9) AS cv_f1_mean, round(stddev_pop(f1), 9) AS cv_f1_std, round(avg(pr_auc - roc_auc), 9) AS cv_gap_auc_mean
    FROM ({evaluated_sql('source')})""",
)
def _(spark, d):
    per_source = rounded(metrics.evaluate(judged(spark, d), "y", "score", keys=["source"]), *METRICS)
    folds = per_source.selectExpr("roc_auc AS val_auc", "f1 AS val_f1", "pr_auc AS train_auc")
    summary = metrics.cv_summary(folds)
    return rounded(summary, *[c for c in summary.columns if c != "cv_k"])


@query(
    "scores_scaled",
    "SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER () + 1e-9), 9) AS value FROM events",
)
def _(spark, d):
    return rounded(metrics.minmax_scale(events(spark, d).select("event_id", "value"), "value"), "value")


@query("rows_numbered", "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rn FROM events")
def _(spark, d):
    numbered = ordering.ordered_index(
        events(spark, d).select("event_id", "value"), [col("value").desc(), col("event_id")], "rn"
    )
    return numbered.select("event_id", "rn")
