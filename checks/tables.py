"""Reports, leaderboards, files, and the combined steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylane.operators import report
from assaylane.operators.columns import col
from assaylane.plans.prepare import prepare
from assaylane.plans.search import compare, leaderboard
from assaylane.operators import metrics
from assaylane.session import scratch_path
from assaylane.sources import files
from checks.registry import query
from checks.rows import (
    DECISION_SQL, ID_CELL_SQL, SUMMARY_SQL, FILTER_SQL, _text_features, cell_sql,
)
from checks.standins import ASSAY_SQL, JUDGED_SQL, SCORED_SQL, assay, in_ranges, judged, scored, table
from checks.stats import AUC_SQL, METRICS, evaluated_sql, rounded, totals_sql

RANKED_SQL = f"""SELECT row_number() OVER (ORDER BY prob_activo DESC, row_idx) AS "Rank", "Molecule ChEMBL ID" AS "ID",
    prob_activo AS "Prob_activo", CASE WHEN prob_activo >= 0.5e0 THEN 'Activo' ELSE 'Inactivo' END AS "Prediccion",
    {SUMMARY_SQL} AS "Filtros" FROM ({SCORED_SQL})"""


@query("result_table", RANKED_SQL)
def _(spark, d):
    return report.result_table(scored(spark, d))


@query("ranked", f'SELECT row_idx, row_number() OVER (ORDER BY prob_activo DESC, row_idx) AS "Rank" FROM ({SCORED_SQL})')
def _(spark, d):
    df = scored(spark, d).select("row_idx", "prob_activo")
    return report.rank_predictions(df).select("row_idx", "Rank")


@query("top_predictions", f'SELECT * FROM ({RANKED_SQL}) WHERE "Rank" <= 10')
def _(spark, d):
    return report.top_predictions(scored(spark, d), 10)


@query(
    "final_report",
    f"""SELECT {ID_CELL_SQL} AS "ID Molécula (ChEMBL/SMILES)",
    round_even(prob_activo * 1000, 0) / 1000 AS "Probabilidad (Score)",
    CASE WHEN prob_activo >= 0.5e0 THEN 'Activo' ELSE 'Inactivo' END AS "Predicción Clase",
    {cell_sql('PAINS')} AS "Alerta PAINS", {cell_sql('Chelator')} AS "Alerta Quelante", {DECISION_SQL} AS "Decisión Final"
    FROM ({SCORED_SQL})""",
)
def _(spark, d):
    return report.final_report(scored(spark, d))


@query(
    "prediction_summary",
    f"""SELECT count(*) AS n, count(*) FILTER (prob_activo >= 0.5e0) AS n_active, count(*) FILTER (prob_activo < 0.5e0) AS n_inactive,
    count(*) FILTER ({SUMMARY_SQL} <> 'Sin alertas') AS n_with_alerts FROM ({SCORED_SQL})""",
)
def _(spark, d):
    return report.prediction_summary(scored(spark, d))


@query("leaderboard", f"SELECT source, roc_auc, f1 FROM ({evaluated_sql('source')}) ORDER BY roc_auc DESC NULLS LAST, f1 DESC, source LIMIT 5")
def _(spark, d):
    board = rounded(metrics.evaluate(judged(spark, d), "y", "score", keys=["source"]), *METRICS)
    return leaderboard(board.select("source", "roc_auc", "f1"), "roc_auc", "f1", tie="source")


# one "configuration" per source; its train and test scores are those of two halves by language
HALVES = "CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END"
COMPARED_SQL = f"""WITH j AS (SELECT *, {HALVES} AS half, concat(source, '/', {HALVES}) AS k FROM ({JUDGED_SQL})),
    a AS (SELECT k, {AUC_SQL} AS auc FROM ({totals_sql('SELECT * FROM j', 'k')}) GROUP BY k),
    w AS (SELECT split_part(k, '/', 1) AS source, max(CASE WHEN k LIKE '%/train' THEN auc END) AS train_roc_auc,
        max(CASE WHEN k LIKE '%/test' THEN auc END) AS test_roc_auc FROM a GROUP BY 1)
    SELECT * FROM w WHERE train_roc_auc IS NOT NULL AND test_roc_auc IS NOT NULL
    ORDER BY abs(train_roc_auc - test_roc_auc), test_roc_auc DESC, source LIMIT 3"""


@query("smallest_gap", COMPARED_SQL)
def _(spark, d):
    halves = judged(spark, d).withColumn("half", F.expr(HALVES))
    auc = rounded(metrics.roc_auc(halves, "y", "score", ["source", "half"]), "roc_auc")
    wide = auc.groupBy("source").agg(
        *[F.max(F.when(col("half") == h, col("roc_auc"))).alias(f"{h}_roc_auc") for h in ("train", "test")]
    )
    return compare(wide.dropna(), "gap", tie="source")


# files: written from a table, read back, and compared with the table


@query(
    "delimited_read",
    f"""SELECT row_idx, "Molecule ChEMBL ID", "Smiles", "Standard Type", trim("Standard Relation", chr(9)) AS "Standard Relation",
    "Standard Value", "Standard Units", "Target ChEMBL ID" FROM (SELECT * REPLACE (CAST(row_idx AS VARCHAR) AS row_idx) FROM ({ASSAY_SQL}))""",
)
def _(spark, d):
    path = files.scratch_copy(assay(spark, d), "csv", header="true", sep=";", escape='"', emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    # cells are read with their tabs, which the SQL trims
    return files.read_delimited(spark, path).withColumn("Standard Relation", F.trim(col("Standard Relation"), F.lit("\t")))


@query("table_written", "SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM orders")
def _(spark, d):
    path = scratch_path(spark)
    files.write_table(table(spark, d, "orders").withColumn("o_orderdate", col("o_orderdate").cast("string")), path, "csv")
    return files.read_table(spark, path, "csv")


@query("texts_written", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, d):
    """Texts with blanks, tabs, quotes, line breaks and accents come back as they were."""
    path = scratch_path(spark)
    files.write_table(table(spark, d, "documents"), path, "csv")
    return files.read_table(spark, path, "csv")


@query("table_enriched", "SELECT *, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS big FROM part")
def _(spark, d):
    path = scratch_path(spark)
    files.write_table(table(spark, d, "part"), path)
    return files.enrich_table(spark, path, lambda df: df.withColumn("big", (col("p_size") > 25).cast("int")))


@query("version_enriched", "SELECT *, c_acctbal < 0 AS owes FROM customer")
def _(spark, d):
    path = scratch_path(spark)
    files.write_version(table(spark, d, "customer"), path)
    return files.enrich_table(spark, path, lambda df: df.withColumn("owes", col("c_acctbal") < 0))


# a folder with a file for every dialect: delimiters, columns in other orders, one file that is not UTF-8
DIALECTS = {
    ",": (["c_custkey", "c_name", "c_acctbal", "segment"], "UTF-8"),
    ";": (["segment", "c_name", "c_custkey", "c_acctbal"], "ISO-8859-1"),
    "|": (["c_name", "c_custkey", "segment"], "UTF-8"),
}


@query(
    "dialects_read",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE CAST(c_acctbal AS VARCHAR) END AS c_acctbal,
    concat('señal, ', c_mktsegment) AS segment FROM customer""",
)
def _(spark, d):
    folder = scratch_path(spark, "raw")
    customers = table(spark, d, "customer").withColumn("segment", F.concat(F.lit("señal, "), col("c_mktsegment")))
    for i, (sep, (names, encoding)) in enumerate(DIALECTS.items()):
        part = customers.where(col("c_custkey") % 3 == i).select(*[col(n).cast("string") for n in names])
        part.write.mode("append").csv(folder, header=True, sep=sep, encoding=encoding)
    return files.read_delimited(spark, folder)


@query("rows_indexed", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, CAST(doc_id AS VARCHAR) AS doc_id FROM documents")
def _(spark, d):
    path = scratch_path(spark, "raw")
    docs = table(spark, d, "documents").select("doc_id", F.translate("text", "\n\r\"", "   ").alias("text"))
    in_ranges(docs, "doc_id", "text").write.csv(path, header=True)
    return files.read_delimited(spark, path, row_index="row_idx").select("row_idx", "doc_id")


@query(
    "results_written",
    f"""SELECT CAST("Rank" AS VARCHAR) AS "Rank", "ID", printf('%.6f', "Prob_activo") AS "Prob_activo", "Prediccion", "Filtros"
    FROM ({RANKED_SQL})""",
)
def _(spark, d):
    path = files.write_results(report.result_table(scored(spark, d)), scratch_path(spark, "results"), "20240101")
    return files.read_delimited(spark, path)


@query("latest_file", "SELECT CAST(COLUMNS(*) AS VARCHAR) FROM supplier")
def _(spark, d):
    folder = scratch_path(spark, "raw")
    for name in ("customer", "supplier"):  # the supplier file is written last
        table(spark, d, name).write.mode("append").csv(folder, header=True)
    return files.read_delimited(spark, files.latest_file(spark, folder))


@query("file_hashes")
def _(spark, d):
    return files.file_sha256(spark, f"{d}/*.parquet")


def tagged_sql(tag: str, text: str) -> str:
    return f"coalesce(concat('{tag}', CAST(length({text}) AS VARCHAR), ':', {text}), 'n')"


FINGERPRINT_SQL = f"""SELECT count(*) AS n_rows, concat(CAST(sum(CAST(concat('0x', left(h, 16)) AS HUGEINT)) AS VARCHAR), '-',
    CAST(sum(CAST(concat('0x', right(h, 16)) AS HUGEINT)) AS VARCHAR)) AS checksum FROM (SELECT md5(concat(
    {tagged_sql('i', 'CAST(o_orderkey AS VARCHAR)')}, {tagged_sql('i', 'CAST(o_custkey AS VARCHAR)')}, {tagged_sql('s', 'o_orderstatus')},
    {tagged_sql('f', 'CAST(o_totalprice AS VARCHAR)')}, {tagged_sql('o', 'CAST(o_orderdate AS VARCHAR)')},
    {tagged_sql('s', 'o_orderpriority')})) AS h FROM orders)"""


@query("table_fingerprint", FINGERPRINT_SQL)
def _(spark, d):
    return files.table_fingerprint(table(spark, d, "orders"))


# combined steps


@query(
    "prepared",
    f"""WITH k AS (SELECT * FROM ({FILTER_SQL}) WHERE "Smiles" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "Smiles" ORDER BY row_idx) = 1)
    SELECT "Molecule ChEMBL ID", "Smiles", "Standard Type", "Standard Relation", "Standard Value", "Standard Units",
    "Target ChEMBL ID", md5("Smiles") AS canonical_smiles, CAST(length("Smiles") AS DOUBLE) AS chars,
    CAST(length("Smiles") - length(replace("Smiles", ' ', '')) AS DOUBLE) AS blanks FROM k""",
)
def _(spark, d):
    return prepare(
        assay(spark, d), "Smiles", _text_features, ["chars", "blanks", "missing"], order_by=["row_idx"],
        required=["chars", "blanks", "missing"],
    )
