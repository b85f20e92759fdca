"""Whole chains: from a raw export over preparation and screens to a trained model and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylane import fixed
from assaylane.operators.assay import filter_assay_other_units
from assaylane.operators.columns import col
from assaylane.operators.screens import match_catalog, match_patterns
from assaylane.plans.ensembles import ForestConfig
from assaylane.plans.predict import predict
from assaylane.plans.prepare import prepare
from assaylane.plans.screen import screen
from assaylane.plans.store import load_table
from assaylane.plans.train import train
from assaylane.session import scratch_path
from assaylane.sources import files
from checks.registry import query
from checks.rows import CATALOG, CATALOG_SQL, _text_features
from checks.standins import ASSAY_SQL, assay, in_ranges, table

# A raw export out of documents: the structure is the text, the value its length.
EXPORT = [
    ("concat('D', CAST(doc_id AS STRING))", "Molecule ChEMBL ID"),
    ("CASE WHEN doc_id % 50 = 7 THEN NULL ELSE translate(text, chr(10), ' ') END", "Smiles"),
    ("CASE WHEN doc_id % 11 = 3 THEN 'Ki' ELSE 'ic50' END", "Standard Type"),
    ("CASE WHEN doc_id % 13 = 5 THEN '>' ELSE concat(chr(39), '=', chr(39)) END", "Standard Relation"),
    ("CAST(n_chars AS STRING)", "Standard Value"),
    ("CASE WHEN doc_id % 17 = 4 THEN 'ug/mL' WHEN doc_id % 17 = 8 THEN NULL ELSE 'nM' END", "Standard Units"),
    ("CASE WHEN doc_id % 19 = 6 THEN 'CHEMBL333' ELSE 'CHEMBL332' END", "Target ChEMBL ID"),
]
EXPORT_SQL = "SELECT doc_id, " + ", ".join(f'{e} AS "{n}"' for e, n in EXPORT) + " FROM documents"
DESCRIPTORS = ["AMW", "SlogP", "TPSA", "NumLipinskiHBA", "NumLipinskiHBD", "NumRotatableBonds"]
CHELATORS = {"mail": "@[a-z]+", "link": "https?://"}


def _features():
    """A stand-in for a chemistry library: letter counts of the text."""
    import hashlib

    def featurize(text):
        letters = {c: text.count(c) for c in "aeio "}
        numbers = (len(text) / 8, letters[" "] / 4, len(text) / 10, letters["a"] // 8, letters["e"] // 8, letters["o"] // 4)
        return hashlib.md5(text.encode()).hexdigest(), dict(zip(DESCRIPTORS, map(float, numbers)))

    return featurize


PREPARED_SQL = f"""SELECT *, length("Smiles") / 8 AS "AMW", (length("Smiles") - length(replace("Smiles", ' ', ''))) / 4 AS "SlogP",
    length("Smiles") / 10 AS "TPSA", (length("Smiles") - length(replace("Smiles", 'a', ''))) // 8 AS "NumLipinskiHBA",
    (length("Smiles") - length(replace("Smiles", 'e', ''))) // 8 AS "NumLipinskiHBD",
    (length("Smiles") - length(replace("Smiles", 'o', ''))) // 4 AS "NumRotatableBonds"
    FROM (SELECT * FROM ({EXPORT_SQL}) WHERE "Target ChEMBL ID" = 'CHEMBL332' AND "Standard Type" = 'ic50' AND "Standard Units" = 'nM'
        AND "Standard Relation" <> '>' AND TRY_CAST("Standard Value" AS DOUBLE) > 0 AND trim("Smiles") <> ''
        QUALIFY row_number() OVER (PARTITION BY "Smiles" ORDER BY doc_id) = 1)"""
MATCHED_SQL = CATALOG_SQL.replace("FROM documents", "FROM (SELECT doc_id, translate(text, chr(10), ' ') AS text FROM documents) documents")
SCREENED_SQL = f"""SELECT p.*, "PAINS_flag", "PAINS_terms",
    CASE WHEN mail OR link THEN 1 ELSE 0 END AS "Chelator_flag",
    concat_ws('|', CASE WHEN link THEN 'link' END, CASE WHEN mail THEN 'mail' END) AS "Chelator_terms",
    CAST("NumLipinskiHBA" > 10 AS INT) + CAST("NumLipinskiHBD" > 5 AS INT) + CAST("AMW" > 500 AS INT) + CAST("SlogP" > 5 AS INT) AS "Lipinski_violations",
    CAST(NOT ("TPSA" <= 140 OR "NumLipinskiHBA" + "NumLipinskiHBD" <= 12) AS INT) + CAST("NumRotatableBonds" > 10 AS INT) AS "Veber_violations"
    FROM (SELECT *, regexp_matches("Smiles", '@[a-z]+') AS mail, regexp_matches("Smiles", 'https?://') AS link FROM ({PREPARED_SQL})) p
    JOIN ({MATCHED_SQL}) USING (doc_id)"""


def export(spark, d) -> str:
    """The raw export as a folder of CSV files, in the order of the documents."""
    path = scratch_path(spark, "raw")
    rows = table(spark, d, "documents").selectExpr("doc_id", *[f"{e} AS `{n}`" for e, n in EXPORT])
    ordered = in_ranges(rows, "doc_id", "Smiles").drop("doc_id")
    ordered.write.csv(path, header=True, sep=";", **files.CELLS)
    return path


def screened(spark, d) -> DataFrame:
    """Raw export to screened table. The export has no row numbers; they come from the files."""
    raw = files.read_delimited(spark, export(spark, d), row_index="row_idx")
    ready = prepare(raw, "Smiles", _features, DESCRIPTORS, required=DESCRIPTORS, keep=["row_idx"])
    catalog = spark.createDataFrame(CATALOG, "pattern string, description string")
    return screen(
        ready,
        "all",
        pains=lambda df: match_catalog(df, "Smiles", catalog, "PAINS"),
        chelators=lambda df: match_patterns(df, "Smiles", CHELATORS, "Chelator"),
    )


@query(
    "prepared_and_screened",
    f"""SELECT "Molecule ChEMBL ID", "Smiles", md5("Smiles") AS canonical_smiles, "Standard Value", CAST("AMW" AS DOUBLE) AS "AMW", CAST("SlogP" AS DOUBLE) AS "SlogP",
    "PAINS_flag", "PAINS_terms", "Chelator_flag", "Chelator_terms", "Lipinski_violations", "Veber_violations" FROM ({SCREENED_SQL})""",
)
def _(spark, d):
    names = ["Molecule ChEMBL ID", "Smiles", "canonical_smiles", "Standard Value", "AMW", "SlogP", *fixed.SCREEN_COLUMNS]
    return screened(spark, d).select(*[col(n) for n in names])


def _cell_sql(prefix: str) -> str:
    return f"""CASE WHEN "{prefix}_flag" = 0 THEN 'No' WHEN "{prefix}_terms" = '' THEN 'Sí' ELSE concat('Sí (', "{prefix}_terms", ')') END"""


@query(
    "chain_reported",
    f"""SELECT "Molecule ChEMBL ID" AS id, {_cell_sql('PAINS')} AS pains, {_cell_sql('Chelator')} AS chelator, true AS follows FROM ({SCREENED_SQL})""",
)
def _(spark, d):
    """The whole way: raw export, preparation, three screens, training, prediction, report with its alerts."""
    ready = screened(spark, d)
    run = train(ready, scratch_path(spark, "model"), ForestConfig(n_estimators=10, step=5, patience=1, max_depth=6), cv_k=None)
    out = predict(ready, run.model)
    names = fixed.REPORT_HEADERS
    again = out.scored.select(
        F.concat_ws("", col("Molecule ChEMBL ID"), F.lit(" ("), col("canonical_smiles"), F.lit(")")).alias(names[0]),
        col("Molecule ChEMBL ID").alias("id"), col("prob_activo").alias("p"), col("PAINS_flag").alias("pf"), col("Chelator_flag").alias("cf"),
    )
    active = col("p") >= 0.5
    told = (
        F.when(active & (col("pf") == 1), fixed.DISCARDED)
        .when(active & (col("cf") == 1), fixed.REVIEW)
        .when(active, fixed.SELECTED)
        .otherwise(fixed.NOT_SELECTED)
    )
    return out.report.join(again, names[0]).select(
        "id", col(names[3]).alias("pains"), col(names[4]).alias("chelator"), (col(names[5]) == told).alias("follows")
    )


@query(
    "evaluation_stored",
    "SELECT unnest(['test', 'val']) AS split, true AS starts_at_origin, true AS ends_at_corner, true AS whole, count(*) > 0 AS has_folds FROM documents",
)
def _(spark, d):
    """Curve points, confusion counts and fold rows lie beside the model."""
    path = scratch_path(spark, "model")
    run = train(screened(spark, d), path, ForestConfig(n_estimators=5, max_depth=5), cv_k=2)
    roc, cells = load_table(spark, path, "roc_points"), load_table(spark, path, "confusion")
    ends = roc.groupBy("split").agg(
        F.bool_or((col("fpr") == 0) & (col("tpr") == 0)).alias("starts_at_origin"),
        F.bool_or((col("fpr") == 1) & (col("tpr") == 1)).alias("ends_at_corner"),
    )
    sizes = run.splits.groupBy("split").agg(F.count("*").alias("n"))
    folds = load_table(spark, path, "cv_folds").count() == 2 and load_table(spark, path, "cv_roc_points").select("fold").distinct().count() == 2
    whole = (col("tn") + col("fp") + col("fn") + col("tp") == col("n")).alias("whole")
    return ends.join(cells, "split").join(sizes, "split").select("split", "starts_at_origin", "ends_at_corner", whole, F.lit(folds).alias("has_folds"))


@query(
    "prepared_other_units",
    f"""SELECT "Molecule ChEMBL ID", "Smiles", "Standard Type", "Standard Relation", "Standard Value", "Standard Units", "Target ChEMBL ID",
    md5("Smiles") AS canonical_smiles, CAST(length("Smiles") AS DOUBLE) AS chars,
    CAST(length("Smiles") - length(replace("Smiles", ' ', '')) AS DOUBLE) AS blanks FROM (SELECT * FROM ({ASSAY_SQL})
        WHERE "Target ChEMBL ID" = 'CHEMBL332' AND upper("Standard Type") = 'IC50' AND lower(trim("Standard Units")) IS DISTINCT FROM 'nm'
        AND "Smiles" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "Smiles" ORDER BY row_idx) = 1)""",
)
def _(spark, d):
    """The preparation for rows in any other unit, missing ones included."""
    columns = ["chars", "blanks", "missing"]
    return prepare(assay(spark, d), "Smiles", _text_features, columns, required=columns, row_filter=filter_assay_other_units)
