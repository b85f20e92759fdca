"""Row-level operators: filters, columns, enrichment, screens, dedup, scalar functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from assaylane import fixed
from assaylane.functions import (
    classify, clean_text, first_available, normalize_relation, numeric, round3, safe_float, truthy, count_violations,
    class_text,
)
from assaylane.operators import assay as assay_ops
from assaylane.operators import columns, enrich, report, screens
from assaylane.operators.columns import col
from assaylane.operators.dedup import dedup_first, duplicate_count
from checks.registry import query
from checks.standins import ASSAY_SQL, RULES_SQL, SCORED_SQL, assay, rules, scored, table

SPACES = "concat(chr(32), chr(9), chr(10), chr(13))"
QUOTES = "concat(chr(39), chr(34))"
RELATION_SQL = f'trim(trim(trim(coalesce("Standard Relation", \'\'), {SPACES}), {QUOTES}), {SPACES})'
FILTER_SQL = f"""SELECT * FROM ({ASSAY_SQL}) WHERE "Target ChEMBL ID" = 'CHEMBL332'
    AND upper("Standard Type") = 'IC50' AND lower("Standard Units") = 'nm' AND {RELATION_SQL} = '='
    AND TRY_CAST("Standard Value" AS DOUBLE) > 0"""


def filtered(spark, d):
    return assay_ops.filter_assay(assay(spark, d))


def listed(df, *names):
    return df.select(*[col(n) for n in names])


@query("assay_filter", FILTER_SQL)
def _(spark, d):
    return filtered(spark, d)


@query(
    "assay_filter_other_units",
    f"""SELECT * FROM ({ASSAY_SQL}) WHERE "Target ChEMBL ID" = 'CHEMBL332' AND upper("Standard Type") = 'IC50'
    AND lower(trim("Standard Units", {SPACES})) IS DISTINCT FROM 'nm'""",
)
def _(spark, d):
    return assay_ops.filter_assay_other_units(assay(spark, d))


@query("relation_normalized", f"SELECT row_idx, {RELATION_SQL} AS relation FROM ({ASSAY_SQL})")
def _(spark, d):
    return assay(spark, d).select("row_idx", normalize_relation(col("Standard Relation")).alias("relation"))


@query(
    "numeric_coerced",
    f"""SELECT row_idx, TRY_CAST("Standard Value" AS DOUBLE) AS "Standard Value" FROM ({ASSAY_SQL})
    WHERE TRY_CAST("Standard Value" AS DOUBLE) IS NOT NULL""",
)
def _(spark, d):
    return columns.coerce_numeric(listed(assay(spark, d), "row_idx", "Standard Value"), "Standard Value")


@query("safe_float", f'SELECT row_idx, TRY_CAST("Standard Value" AS DOUBLE) AS v FROM ({ASSAY_SQL})')
def _(spark, d):
    return assay(spark, d).select("row_idx", safe_float(col("Standard Value")).alias("v"))


@query("structure_column", f"""SELECT count("Smiles") AS n, 'Smiles' AS found FROM ({ASSAY_SQL})""")
def _(spark, d):
    df = assay(spark, d)
    name = columns.structure_column(df)
    return df.agg(F.count(col(name)).alias("n"), F.lit(name).alias("found"))


@query("id_column", f'SELECT "Molecule ChEMBL ID" AS id FROM ({ASSAY_SQL})')
def _(spark, d):
    df = assay(spark, d)
    return df.select(col(columns.pick_id(df)).alias("id"))


@query(
    "columns_conformed",
    f"""SELECT "Molecule ChEMBL ID", "Smiles", "Standard Type", "Standard Relation", "Standard Value",
    "Standard Units", "Target ChEMBL ID", md5("Smiles") AS canonical_smiles,
    TRY_CAST("Standard Value" AS DOUBLE) AS "SlogP", CAST(NULL AS DOUBLE) AS "SMR", CAST(NULL AS DOUBLE) AS "TPSA"
    FROM ({ASSAY_SQL})""",
)
def _(spark, d):
    df = assay(spark, d).withColumns(
        {"canonical_smiles": F.md5("Smiles"), "SlogP": numeric(col("Standard Value"))}
    )
    return columns.conform(df, fixed.META_COLUMNS, ["SlogP", "SMR", "TPSA"], "canonical_smiles")


@query("feature_columns", "SELECT unnest(['p_partkey', 'p_size', 'p_retailprice']) AS feature, count(*) AS n FROM part")
def _(spark, d):
    part = table(spark, d, "part")
    counts = columns.non_null_counts(part, columns.feature_columns(part))
    return counts.unpivot([], counts.columns, "feature", "n")


@query(
    "features_aligned",
    "SELECT p_partkey, p_retailprice, CAST(NULL AS DOUBLE) AS gone, CAST(p_size AS DOUBLE) AS p_size FROM part",
)
def _(spark, d):
    return columns.align_features(table(spark, d, "part"), ["p_retailprice", "gone", "p_size"], ["p_partkey"])


GAPPY_SQL = """SELECT vec_id, CASE WHEN embedding[1] > 0.15 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS a,
    CASE WHEN embedding[2] < -0.15 THEN NULL ELSE CAST(embedding[2] AS DOUBLE) END AS b,
    CAST(embedding[3] AS DOUBLE) AS c, CAST(NULL AS DOUBLE) AS d FROM embeddings"""


def gappy(spark, d):
    v = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.when(~(v(1) > 0.15), v(1)).alias("a"),
        F.when(~(v(2) < -0.15), v(2)).alias("b"),
        v(3).alias("c"),
        F.lit(None).cast("double").alias("d"),
    )


@query("column_profile", f"SELECT count(a) AS a, count(b) AS b, count(c) AS c, count(d) AS d FROM ({GAPPY_SQL})")
def _(spark, d):
    return columns.non_null_counts(gappy(spark, d), ["a", "b", "c", "d"])


@query("rows_complete", f"SELECT * FROM ({GAPPY_SQL}) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def _(spark, d):
    df = gappy(spark, d)
    return columns.drop_incomplete(df, columns.non_null_columns(df, ["a", "b", "c", "d"]))


@query(
    "completeness",
    f"SELECT count(*) AS rows_before, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS rows_after FROM ({GAPPY_SQL})",
)
def _(spark, d):
    return columns.completeness(gappy(spark, d), ["a", "b"])


@query("empty_columns_dropped", f"SELECT vec_id, a, b, c FROM ({GAPPY_SQL})")
def _(spark, d):
    return columns.drop_all_null(gappy(spark, d), ["a", "b", "c", "d"])


@query("class_predicted", f"SELECT row_idx, CASE WHEN prob_activo >= 0.6e0 THEN 1 ELSE 0 END AS pred FROM ({SCORED_SQL})")
def _(spark, d):
    return scored(spark, d).select("row_idx", classify(col("prob_activo"), 0.6).alias("pred"))


@query(
    "preview",
    f'SELECT "Molecule ChEMBL ID", "Smiles", "Standard Value" FROM ({ASSAY_SQL}) ORDER BY row_idx LIMIT 10',
)
def _(spark, d):
    wanted = ["Molecule ChEMBL ID", "canonical_smiles", "Smiles", "Standard Value", "activo"]
    return columns.preview(assay(spark, d), wanted, 10, "row_idx")


def _text_features():
    """Featuriser for texts: valid if it has a blank; a stand-in for a chemistry library."""

    def featurize(text):
        if " " not in text.strip():
            return None
        return hashlib.md5(text.encode()).hexdigest(), {
            "chars": len(text),
            "blanks": text.count(" "),
            "lines": text.count("\n") + 1,
        }

    return featurize


FEATURES_SQL = """SELECT doc_id, text,
    CASE WHEN trim(text) LIKE '% %' THEN md5(text) END AS canonical_smiles,
    CASE WHEN trim(text) LIKE '% %' THEN CAST(length(text) AS DOUBLE) END AS chars,
    CASE WHEN trim(text) LIKE '% %' THEN CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) END AS blanks,
    CASE WHEN trim(text) LIKE '% %' THEN CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) END AS lines
    FROM documents"""


@query("descriptors", FEATURES_SQL)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return enrich.with_descriptors(docs, "text", _text_features, ["chars", "blanks", "lines"])


@query(
    "descriptors_joined",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_size, p_retailprice
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    return enrich.join_descriptors(lines, parts, "l_partkey")


@query(
    "vector_expanded",
    "SELECT vec_id, label, "
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(1, 65))
    + ", CAST(NULL AS DOUBLE) AS e65, CAST(NULL AS DOUBLE) AS e66 FROM embeddings",
)
def _(spark, d):
    return enrich.expand_vector(table(spark, d, "embeddings"), "embedding", "e", 66)


@query("first_available", f"SELECT vec_id, coalesce(d, a, b, c) AS v FROM ({GAPPY_SQL})")
def _(spark, d):
    return gappy(spark, d).select("vec_id", first_available(*[col(c) for c in "dabc"]).alias("v"))


# (pattern, description): two patterns share a description, one is not valid
CATALOG = [
    ("ing\\b", "suffix_ing"),
    ("[0-9]{3,}", "digits"),
    ("(?i)license", "licence"),
    ("@[a-z]+", "mail"),
    ("https?://", "link"),
    ("www\\.", "link"),
    ("é", "accent"),
]
CATALOG_SQL = """WITH c(pattern, description) AS (VALUES ('ing\\b', 'suffix_ing'), ('[0-9]{3,}', 'digits'),
    ('(?i)license', 'licence'), ('@[a-z]+', 'mail'), ('https?://', 'link'), ('www\\.', 'link'), ('é', 'accent')),
    m AS (SELECT doc_id, string_agg(DISTINCT description, '|' ORDER BY description) AS terms
        FROM documents JOIN c ON regexp_matches(text, pattern) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN terms IS NULL THEN 0 ELSE 1 END AS "PAINS_flag", coalesce(terms, '') AS "PAINS_terms"
    FROM documents LEFT JOIN m USING (doc_id)"""


def _catalog(spark):
    return spark.createDataFrame(CATALOG, "pattern string, description string")


@query("catalog_matched", CATALOG_SQL)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return screens.match_catalog(docs, "text", _catalog(spark), "PAINS").drop("text")


@query("catalog_matched_in_rounds", CATALOG_SQL)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return screens.match_catalog(docs, "text", _catalog(spark), "PAINS", literal_bytes=8).drop("text")


@query(
    "patterns_matched",
    """SELECT doc_id, CASE WHEN mail OR link THEN 1 ELSE 0 END AS "Chelator_flag",
    concat_ws('|', CASE WHEN link THEN 'link' END, CASE WHEN mail THEN 'mail' END) AS "Chelator_terms"
    FROM (SELECT doc_id, regexp_matches(text, '@[a-z]+') AS mail, regexp_matches(text, 'https?://') AS link
        FROM documents)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    patterns = {"mail": "@[a-z]+", "broken": "[", "link": "https?://"}
    return screens.match_patterns(docs, "text", patterns, "Chelator").drop("text")


def _marks():
    return lambda text: [name for name, mark in (("pipe", "|"), ("mail", "@"), ("colon", ":")) if mark in text]


@query(
    "terms_matched_with_function",
    """SELECT doc_id, CASE WHEN text LIKE '%|%' OR text LIKE '%@%' OR text LIKE '%:%' THEN 1 ELSE 0 END AS "Chelator_flag",
    concat_ws('|', CASE WHEN text LIKE '%:%' THEN 'colon' END, CASE WHEN text LIKE '%@%' THEN 'mail' END,
        CASE WHEN text LIKE '%|%' THEN 'pipe' END) AS "Chelator_terms" FROM documents""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return screens.match_terms_with(docs, "text", _marks, "Chelator").drop("text")


LIPINSKI_SQL = """CASE WHEN "AMW" IS NULL THEN NULL ELSE CASE WHEN "NumLipinskiHBA" > 10 THEN 1 ELSE 0 END
    + CASE WHEN "NumLipinskiHBD" > 5 THEN 1 ELSE 0 END + CASE WHEN "AMW" > 500 THEN 1 ELSE 0 END
    + CASE WHEN "SlogP" > 5 THEN 1 ELSE 0 END END"""
VEBER_SQL = """CASE WHEN "TPSA" IS NULL THEN NULL ELSE
    CASE WHEN "TPSA" <= 140 OR "NumLipinskiHBA" + "NumLipinskiHBD" <= 12 THEN 0 ELSE 1 END
    + CASE WHEN "NumRotatableBonds" > 10 THEN 1 ELSE 0 END END"""
DRUG_SQL = f'SELECT *, {LIPINSKI_SQL} AS "Lipinski_violations", {VEBER_SQL} AS "Veber_violations" FROM ({RULES_SQL})'


@query("lipinski", f'SELECT l_orderkey, l_partkey, "Lipinski_violations" FROM ({DRUG_SQL})')
def _(spark, d):
    df = screens.with_druglikeness(rules(spark, d))
    return df.select("l_orderkey", "l_partkey", "Lipinski_violations")


@query("veber", f'SELECT l_orderkey, l_partkey, "Veber_violations" FROM ({DRUG_SQL})')
def _(spark, d):
    return screens.with_druglikeness(rules(spark, d)).select("l_orderkey", "l_partkey", "Veber_violations")


@query(
    "rule_violations",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN 1 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END
    + CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS violations FROM part""",
)
def _(spark, d):
    broken = [col("p_size") > 25, col("p_retailprice") > 1000, col("p_type") == "SMALL"]
    return table(spark, d, "part").select("p_partkey", count_violations(broken).alias("violations"))


def _screened(spark, d, chosen="all"):
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    parts = table(spark, d, "part").select(col("p_partkey").alias("l_partkey"), text.alias("Smiles"))
    df = rules(spark, d).join(parts, "l_partkey", "left")
    return screens.apply_screens(
        df,
        chosen,
        pains=lambda x: screens.match_patterns(x, "Smiles", {"ring": "ring", "red": "^red"}, "PAINS"),
        chelators=lambda x: screens.match_patterns(x, "Smiles", {"bolt": "bolt", "brand": "#1[0-9]"}, "Chelator"),
    )


SCREENED_SQL = f"""SELECT *, {LIPINSKI_SQL} AS "Lipinski_violations", {VEBER_SQL} AS "Veber_violations",
    CASE WHEN ring OR red THEN 1 ELSE 0 END AS "PAINS_flag",
    concat_ws('|', CASE WHEN red THEN 'red' END, CASE WHEN ring THEN 'ring' END) AS "PAINS_terms",
    CASE WHEN bolt OR brand THEN 1 ELSE 0 END AS "Chelator_flag",
    concat_ws('|', CASE WHEN bolt THEN 'bolt' END, CASE WHEN brand THEN 'brand' END) AS "Chelator_terms"
    FROM (SELECT r.*, s AS "Smiles", coalesce(s LIKE '%ring%', false) AS ring, coalesce(s LIKE 'red%', false) AS red,
        coalesce(s LIKE '%bolt%', false) AS bolt, coalesce(regexp_matches(s, '#1[0-9]'), false) AS brand
        FROM ({RULES_SQL}) r LEFT JOIN (SELECT p_partkey, concat_ws(' ', p_name, p_type, p_brand) AS s FROM part)
        ON l_partkey = p_partkey)"""


@query("screens_applied", f"SELECT * EXCLUDE (ring, red, bolt, brand) FROM ({SCREENED_SQL})")
def _(spark, d):
    return _screened(spark, d)


@query(
    "screens_summary",
    f"""SELECT count(*) FILTER ("PAINS_flag" = 1) AS pains_flagged, count(*) FILTER ("Chelator_flag" = 1) AS chelator_flagged,
    count(*) FILTER ("Lipinski_violations" = 0) AS lipinski_ok, count(*) FILTER ("Veber_violations" = 0) AS veber_ok
    FROM ({SCREENED_SQL})""",
)
def _(spark, d):
    return screens.screen_summary(_screened(spark, d))


@query(
    "deduplicated",
    """SELECT doc_id, text, lang FROM documents
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def _(spark, d):
    return dedup_first(table(spark, d, "documents").select("doc_id", "text", "lang"), ["text"], ["doc_id"])


@query(
    "deduplicated_null_key",
    f"""SELECT row_idx, "Smiles" FROM ({ASSAY_SQL})
    QUALIFY row_number() OVER (PARTITION BY "Smiles" ORDER BY row_idx) = 1""",
)
def _(spark, d):
    return dedup_first(listed(assay(spark, d), "row_idx", "Smiles"), ["Smiles"], ["row_idx"])


@query(
    "duplicates_counted",
    """SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_after, count(*) - count(DISTINCT text) AS removed
    FROM documents""",
)
def _(spark, d):
    return duplicate_count(table(spark, d, "documents"), ["text"])


TRUE_SQL = "('1', 'true', 'yes', 'si', 'sí', 'y')"


def truthy_sql(c: str) -> str:
    t = f"lower(trim(CAST({c} AS VARCHAR), {SPACES}))"
    return f"""(CASE WHEN {c} IS NULL THEN false WHEN {t} IN {TRUE_SQL} THEN true
        ELSE coalesce(TRY_CAST({t} AS DOUBLE) <> 0, {t} <> '') END)"""


@query("flags_read", f"""SELECT row_idx, {truthy_sql('"PAINS_flag"')} AS pains, {truthy_sql('"Chelator_flag"')} AS chelator
    FROM ({SCORED_SQL})""")
def _(spark, d):
    return scored(spark, d).select(
        "row_idx", truthy(col("PAINS_flag")).alias("pains"), truthy(col("Chelator_flag")).alias("chelator")
    )


@query(
    "text_cleaned",
    f"""SELECT doc_id, trim(replace(replace(strip_accents(trim(text, {SPACES})), chr(13), ' '), chr(10), ' ')) AS text
    FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7Fà-üÀ-Ü]', '', 'g') AS text FROM documents)""",
)
def _(spark, d):
    # whole texts; the SQL holds for plain text and for Latin-1 letters, as it can only strip accents
    return table(spark, d, "documents").select("doc_id", clean_text(col("text")).alias("text"))


def clean_sql(c: str) -> str:
    return f"trim(replace(replace(strip_accents(trim(coalesce({c}, ''), {SPACES})), chr(13), ' '), chr(10), ' '))"


def _alert_sql(title: str, prefix: str) -> str:
    term = clean_sql(f'"{prefix}_terms"')
    return f"""CASE WHEN {truthy_sql(f'"{prefix}_flag"')} THEN concat('{title}: ', coalesce(nullif({term}, ''), 'si')) END"""


SUMMARY_SQL = f"""coalesce(nullif(concat_ws(' | ', {_alert_sql('PAINS', 'PAINS')}, {_alert_sql('Quelacion', 'Chelator')},
    CASE WHEN "Lipinski_violations" >= 1 THEN concat('Lipinski alertas: ', CAST("Lipinski_violations" AS BIGINT)) END,
    CASE WHEN "Veber_violations" >= 1 THEN concat('Veber alertas: ', CAST("Veber_violations" AS BIGINT)) END), ''),
    'Sin alertas')"""


@query("alerts_summarized", f"SELECT row_idx, {SUMMARY_SQL} AS filtros FROM ({SCORED_SQL})")
def _(spark, d):
    df = scored(spark, d)
    return df.select("row_idx", report.alert_summary(df).alias("filtros"))


def cell_sql(prefix: str) -> str:
    term = f'trim("{prefix}_terms", {SPACES})'
    return f"""CASE WHEN NOT {truthy_sql(f'"{prefix}_flag"')} THEN 'No'
        WHEN {term} <> '' AND lower({term}) <> 'nan' THEN concat('Sí (', {term}, ')') ELSE 'Sí' END"""


@query("alert_cells", f"SELECT row_idx, {cell_sql('PAINS')} AS pains, {cell_sql('Chelator')} AS chelator FROM ({SCORED_SQL})")
def _(spark, d):
    return scored(spark, d).select(
        "row_idx",
        report.alert_cell(truthy(col("PAINS_flag")), col("PAINS_terms")).alias("pains"),
        report.alert_cell(truthy(col("Chelator_flag")), col("Chelator_terms")).alias("chelator"),
    )


ID_CELL_SQL = """concat(trim("Molecule ChEMBL ID"), CASE WHEN trim(canonical_smiles) <> '' THEN
    concat(' (', trim(canonical_smiles), ')') ELSE '' END)"""


@query("id_cells", f"SELECT row_idx, {ID_CELL_SQL} AS cell FROM ({SCORED_SQL})")
def _(spark, d):
    cell = report.id_cell(col("Molecule ChEMBL ID"), col("canonical_smiles"))
    return scored(spark, d).select("row_idx", cell.alias("cell"))


DECISION_SQL = f"""CASE WHEN prob_activo < 0.5e0 THEN 'No seleccionado' WHEN {truthy_sql('"PAINS_flag"')} THEN '❌ Descartado'
    WHEN {truthy_sql('"Chelator_flag"')} THEN '⚠️ Revisión (Riesgo)' ELSE '✅ Seleccionado' END"""


@query("decisions", f"SELECT row_idx, {DECISION_SQL} AS decision FROM ({SCORED_SQL})")
def _(spark, d):
    made = report.decision(classify(col("prob_activo")), truthy(col("PAINS_flag")), truthy(col("Chelator_flag")))
    return scored(spark, d).select("row_idx", made.alias("decision"))


@query("scores_rounded", "SELECT event_id, round_even(value / 16e0 * 1000, 0) / 1000 AS v FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", round3(col("value") / 16).alias("v"))


@query(
    "class_texts",
    f"SELECT row_idx, CASE WHEN prob_activo >= 0.5e0 THEN 'Activo' ELSE 'Inactivo' END AS v FROM ({SCORED_SQL})",
)
def _(spark, d):
    return scored(spark, d).select("row_idx", class_text(classify(col("prob_activo"))).alias("v"))
