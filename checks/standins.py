"""Stand-ins for screening data, derived from the test tables.

Each is a list of ``(expression, name)`` over one table, in SQL that both engines read alike, so
the query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Raw assay export out of events: type and unit by event type, the rest by the digits in props.
ASSAY = [
    ("event_id", "row_idx"),
    ("concat('C', CAST(event_id AS STRING))", "Molecule ChEMBL ID"),
    ("CASE WHEN props LIKE '%0}' THEN NULL ELSE props END", "Smiles"),
    ("CASE event_type WHEN 'click' THEN 'ic50' WHEN 'purchase' THEN 'Ki' ELSE 'IC50' END", "Standard Type"),
    (
        "CASE WHEN props LIKE '%1}' THEN concat(chr(39), '>', chr(39)) WHEN props LIKE '%2}' THEN '\"=\"' "
        "WHEN props LIKE '%3}' THEN NULL WHEN props LIKE '%4}' THEN concat(chr(9), chr(39), '=', chr(39), ' ') "
        "ELSE '=' END",
        "Standard Relation",
    ),
    (
        "CASE WHEN props LIKE '%5}' THEN 'abc' WHEN props LIKE '%6}' THEN concat('-', CAST(value AS STRING)) "
        "WHEN props LIKE '%7}' THEN NULL ELSE CAST(value AS STRING) END",
        "Standard Value",
    ),
    (
        "CASE WHEN props LIKE '%8}' THEN 'ug/mL' WHEN event_type = 'signup' THEN 'NM' "
        "WHEN event_type = 'click' THEN ' nM ' WHEN event_type = 'error' THEN NULL ELSE 'nM' END",
        "Standard Units",
    ),
    ("CASE WHEN props LIKE '%9}' THEN 'CHEMBL333' ELSE 'CHEMBL332' END", "Target ChEMBL ID"),
]

# Rule inputs out of lineitem; a row without tax is an invalid one.
RULES = [
    ("l_orderkey", "l_orderkey"),
    ("l_partkey", "l_partkey"),
    ("l_suppkey", "l_suppkey"),
    ("CAST(l_linenumber + 5 AS DOUBLE)", "NumLipinskiHBA"),
    ("CAST(l_linenumber AS DOUBLE)", "NumLipinskiHBD"),
    ("CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / 100 END", "AMW"),
    ("l_quantity / 5", "SlogP"),
    ("CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / 300 END", "TPSA"),
    ("l_quantity / 3", "NumRotatableBonds"),
]

# Scored and screened compounds out of documents, with every kind of flag and term.
SCORED = [
    ("doc_id", "row_idx"),
    ("concat(' D', CAST(doc_id AS STRING))", "Molecule ChEMBL ID"),
    ("CASE WHEN lang = 'de' THEN NULL WHEN lang = 'es' THEN ' ' ELSE md5(text) END", "canonical_smiles"),
    ("n_chars / (n_chars + 1500.0e0)", "prob_activo"),
    (
        "CASE WHEN text LIKE '%http%' THEN 'no' WHEN text LIKE '%@%' THEN ' Sí ' WHEN lang = 'fr' THEN '1' "
        "WHEN lang = 'es' THEN '0.0' WHEN text LIKE '%|%' THEN '' WHEN text LIKE '%ing%' THEN '0' ELSE NULL END",
        "PAINS_flag",
    ),
    (
        "CASE WHEN lang = 'fr' THEN 'azo_é|quinone ' WHEN text LIKE '%@%' THEN 'nan' ELSE NULL END",
        "PAINS_terms",
    ),
    ("CASE WHEN source < 'src2' THEN 1 WHEN lang = 'de' THEN NULL ELSE 0 END", "Chelator_flag"),
    ("CASE WHEN lang = 'en' THEN 'thiol' WHEN lang = 'es' THEN concat('a', chr(10), 'b') ELSE '' END", "Chelator_terms"),
    ("CASE WHEN lang = 'de' THEN NULL WHEN n_chars > 2000 THEN 2.0e0 ELSE 0.0e0 END", "Lipinski_violations"),
    ("CASE WHEN lang = 'fr' THEN NULL WHEN n_chars > 4000 THEN 1 ELSE 0 END", "Veber_violations"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


RANGE_BYTES = 64 << 20


def in_ranges(df: DataFrame, key: str, text: str, range_bytes: int = RANGE_BYTES, least: int = 3) -> DataFrame:
    """Rows sorted by ``key`` in ranges of about ``range_bytes`` of text: their number follows from the table, so what one
    task sorts and writes stays the same however large the table is."""
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return df.repartitionByRange(max(least, -(-size // range_bytes)), key).sortWithinPartitions(key)


def standin(spark: SparkSession, folder: str, source: str, columns: list[tuple[str, str]]) -> DataFrame:
    return table(spark, folder, source).selectExpr(*[f"{e} AS `{n}`" for e, n in columns])


def standin_sql(source: str, columns: list[tuple[str, str]]) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for e, n in columns) + f" FROM {source}"


def assay(spark: SparkSession, folder: str) -> DataFrame:
    return standin(spark, folder, "events", ASSAY)


def rules(spark: SparkSession, folder: str) -> DataFrame:
    return standin(spark, folder, "lineitem", RULES)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return standin(spark, folder, "documents", SCORED)


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Class and score: labelled documents, scored by length; split by toxicity, grouped by language."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, folder, "labels")
    return docs.join(labels, "doc_id").selectExpr(
        "doc_id", "lang", "source", "quality AS y", "toxic", "n_chars / 5000.0e0 AS score",
        "CASE WHEN n_chars / 5000.0e0 >= 0.5e0 THEN 1 ELSE 0 END AS pred",
    )


JUDGED_SQL = """SELECT doc_id, lang, source, quality AS y, toxic, n_chars / 5000.0e0 AS score,
    CASE WHEN n_chars / 5000.0e0 >= 0.5e0 THEN 1 ELSE 0 END AS pred
    FROM documents JOIN labels USING (doc_id)"""
ASSAY_SQL = standin_sql("events", ASSAY)
RULES_SQL = standin_sql("lineitem", RULES)
SCORED_SQL = standin_sql("documents", SCORED)
