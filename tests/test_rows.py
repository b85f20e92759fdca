"""Filters, columns, scalar functions, screens and dedup on hand-made rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaylane import fixed
from assaylane.functions.literals import required_literal
from assaylane.functions import clean_text, numeric, round3, safe_float, truthy
from assaylane.operators import columns, enrich, screens
from assaylane.operators.assay import filter_assay, filter_assay_other_units
from assaylane.operators.columns import col
from assaylane.operators.dedup import dedup_first
from assaylane.plans.prepare import prepare

ASSAY = [
    (0, "C1", "CCO", "IC50", "'='", "10", "nM", "CHEMBL332"),
    (1, "C2", "CCN", "ic50", "=", "5.5", "NM", "CHEMBL332"),
    (2, "C3", "CCC", "IC50", "'>'", "10", "nM", "CHEMBL332"),
    (3, "C4", "CCC", "IC50", '"="', "0", "nM", "CHEMBL332"),
    (4, "C5", "CCC", "IC50", "=", "abc", "nM", "CHEMBL332"),
    (5, "C6", "CCS", "Ki", "=", "7", "nM", "CHEMBL332"),
    (6, "C7", "CCS", "IC50", "=", "7", "nM", "CHEMBL333"),
    (7, "C8", "CCF", "IC50", ">", "7", None, "CHEMBL332"),
    (8, "C9", "CCF", "IC50", "=", "-1", "ug/mL", "CHEMBL332"),
    (9, "C10", "CCF", "IC50", "=", "7", " nM ", "CHEMBL332"),
    (10, "C11", "CCO", "IC50", "=", "99", "nM", "CHEMBL332"),
    (11, "C12", "bad", "IC50", "=", "3", "nM", "CHEMBL332"),
    (12, "C13", None, "IC50", None, "3", "nM", "CHEMBL332"),
]
NAMES = [
    "row_idx", "Molecule ChEMBL ID", "Smiles", "Standard Type", "Standard Relation", "Standard Value",
    "Standard Units", "Target ChEMBL ID",
]


@pytest.fixture(scope="module")
def assay(spark):
    kinds = ", ".join(f"`{n}` {'long' if n == 'row_idx' else 'string'}" for n in NAMES)
    return spark.createDataFrame(ASSAY, kinds)


def ids(df):
    return sorted(r["row_idx"] for r in df.select("row_idx").collect())


def values(df, name="v"):
    return [r[name] for r in df.collect()]


def test_assay_filter(assay):
    assert ids(filter_assay(assay)) == [0, 1, 10, 11]
    assert ids(filter_assay_other_units(assay)) == [7, 8]


def test_assay_filter_skips_absent_columns(assay):
    assert ids(filter_assay(assay.select("row_idx", "Standard Units"))) == [0, 1, 2, 3, 4, 5, 6, 10, 11, 12]
    assert ids(filter_assay(assay.select("row_idx"))) == list(range(13))


def test_assay_filter_on_a_numeric_value_column(assay):
    typed = assay.withColumn("Standard Value", col("Standard Value").try_cast("double"))
    assert ids(filter_assay(typed)) == [0, 1, 10, 11]
    with_nan = typed.withColumn("Standard Value", F.lit(float("nan")))
    assert ids(filter_assay(with_nan)) == []


def describe():
    from math import nan

    return lambda text: None if text == "bad" else (text[::-1], {"SlogP": len(text), "MQN1": nan, "TPSA": None})


def test_prepare(assay):
    out = prepare(assay, "Smiles", describe)
    assert [r["Molecule ChEMBL ID"] for r in out.orderBy("Molecule ChEMBL ID").collect()] == ["C1", "C2"]
    assert out.columns == fixed.META_COLUMNS + ["canonical_smiles", "SlogP"]


def test_prepare_without_rows_keeps_the_typed_columns(assay):
    out = prepare(assay.where("row_idx < 0"), "Smiles", describe)
    assert out.count() == 0
    assert out.columns == fixed.META_COLUMNS + ["canonical_smiles"] + fixed.DESCRIPTOR_COLUMNS


def test_fixed_columns():
    assert len(fixed.DESCRIPTOR_COLUMNS) == 98
    assert fixed.DESCRIPTOR_COLUMNS[-1] == "MQN42"
    assert "peoe_VSA14" in fixed.DESCRIPTOR_COLUMNS


def test_descriptors_keep_invalid_rows_and_exact_other_columns(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "CCO"), (None, "bad"), (3, None), (4, "  "), (5, "boom")], "id long, t string")

    def make():
        def featurize(text):
            if text == "boom":
                raise RuntimeError(text)
            return None if text == "bad" else ("k", {"a": "1.5", "b": float("nan")})

        return featurize

    out = enrich.with_descriptors(df, "t", make, ["a", "b"], key="key")
    assert sorted(out.collect(), key=str) == sorted(
        [(big, "CCO", "k", 1.5, None), (None, "bad", None, None, None), (3, None, None, None, None),
         (4, "  ", None, None, None), (5, "boom", None, None, None)], key=str,
    )


def test_expand_vector_pads_with_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, v array<double>")
    out = enrich.expand_vector(df, "v", "x", 3).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, 1.0, 2.0, None), (2, None, None, None)]


def test_dedup_keeps_the_first_and_treats_null_keys_as_equal(spark):
    rows = [(3, None, "x"), (1, None, "y"), (2, "a", "z"), (5, "a", "w")]
    df = spark.createDataFrame(rows, "id int, k string, v string")
    assert sorted(dedup_first(df, ["k"], ["id"]).collect(), key=str) == [(1, None, "y"), (2, "a", "z")]


def test_dedup_drops_duplicates_before_the_shuffle(spark):
    df = spark.range(10).withColumn("k", col("id") % 3)
    plan = dedup_first(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize(
    "text, wanted",
    [
        (None, False), ("", False), (" ", False), ("0", False), ("0.0", False), ("-0e5", False), ("NaN", False),
        ("1", True), ("sí", True), (" Y ", True), ("2.5", True), ("no", True), ("false", True), ("abc", True),
        ("0d", True), ("\t0\n", False), ("inf", True),
    ],
)
def test_truthy(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "v string")
    assert values(df.select(truthy(col("v")).alias("v"))) == [wanted]


def test_truthy_of_numbers(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.0), (4, 1.0)], "id int, v double").orderBy("id")
    assert values(df.select(truthy(col("v")).alias("v"))) == [False, False, False, True]
    flags = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id int, v int").orderBy("id")
    assert values(flags.select(truthy(col("v")).alias("v"))) == [False, True, False]


def test_safe_float(spark):
    texts = [" 1.5 ", "1e-3", "1.5d", "0x1p3", "abc", None, "", "inf", ".5", "5.", "1,5", " 7 "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, v string").orderBy("id")
    assert values(df.select(safe_float(col("v")).alias("v"))) == [
        1.5, 0.001, None, None, None, None, None, float("inf"), 0.5, 5.0, None, 7.0,
    ]
    nans = spark.createDataFrame([("NaN",)], "v string")
    assert values(nans.select(numeric(col("v")).alias("v"))) == [None]


def test_round_half_to_even_on_the_scaled_number(spark):
    numbers = [0.0625, 0.0005, 1.0015, 2.0475, 0.9995]
    df = spark.createDataFrame(list(enumerate(numbers)), "id int, v double").orderBy("id")
    import numpy as np

    assert values(df.select(round3(col("v")).alias("v"))) == [float(x) for x in np.round(numbers, 3)]


def test_clean_text(spark):
    texts = [" Ácido\r\nβ ", None, "plain", "ﬁx\n", "日本"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, v string").orderBy("id")
    assert values(df.select(clean_text(col("v")).alias("v"))) == ["Acido", "", "plain", "fix", ""]


def test_text_cleaned_takes_whole_texts(spark, tmp_path):
    from checks.registry import QUERIES

    given = [
        ("Łódź ő ű", "odz o u"), ("ﬁne ² ½ Ⅳ １２", "fine 2 12 IV 12"), ("日本 abc Ж", "abc"), ("Æ × ÷ ß ø", ""),
        ("\u2003ñandú\r\n€5 ", "nandu  5"), ("e\u0301t\u00e9", "ete"), ("Việt Nam", "Viet Nam"), ("", ""), (None, ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(given)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in QUERIES["text_cleaned"](spark, str(tmp_path)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(given)}


def test_detect_column(spark):
    df = spark.createDataFrame([(1, 2)], "`Canonical SMILES text` int, other int")
    assert columns.structure_column(df) == "Canonical SMILES text"
    with pytest.raises(ValueError):
        columns.screen_structure_column(df)
    both = spark.createDataFrame([(1, 2)], "canonical_smiles int, Smiles int")
    assert columns.structure_column(both) == "Smiles"
    assert columns.screen_structure_column(both) == "canonical_smiles"
    assert columns.pick_id(both) == "canonical_smiles"
    assert columns.pick_id(df) == "row_idx"


def test_feature_columns(spark):
    df = spark.createDataFrame([(1, 1.0, True, "a", 2)], "a int, `Standard Value` double, b boolean, c string, activo int")
    assert columns.feature_columns(df) == ["a", "b"]


def test_missing_columns_rules(spark):
    df = spark.createDataFrame([(1, 1.0, None, None), (2, None, 2.0, None)], "id int, a double, b double, c double")
    assert columns.non_null_columns(df, ["a", "b", "c"]) == ["a", "b"]
    assert columns.drop_all_null(df, ["a", "b", "c"]).columns == ["id", "a", "b"]
    assert values(columns.drop_incomplete(df, ["a"]), "id") == [1]
    assert columns.drop_incomplete(df, []).count() == 2


def test_drug_likeness_bounds(spark):
    rows = [
        (10.0, 5.0, 500.0, 5.0, 140.0, 10.0, 0, 0),
        (11.0, 6.0, 501.0, 5.1, 141.0, 11.0, 4, 2),
        (6.0, 6.0, 400.0, 1.0, 200.0, 3.0, 1, 0),
        (7.0, 6.0, 400.0, 1.0, 200.0, 3.0, 1, 1),
        (None, None, None, None, None, None, None, None),
    ]
    names = ["NumLipinskiHBA", "NumLipinskiHBD", "AMW", "SlogP", "TPSA", "NumRotatableBonds"]
    schema = ", ".join(f"{n} double" for n in names) + ", lip int, veb int"
    out = screens.with_druglikeness(spark.createDataFrame(rows, schema)).collect()
    assert all(r["Lipinski_violations"] == r["lip"] and r["Veber_violations"] == r["veb"] for r in out)


CATALOG = [("a+b", "ab"), ("b", "has_b"), ("^x", "ab"), ("[", "broken"), ("z", None)]
TEXTS = [(1, "aab"), (2, "x"), (3, None), (4, "q"), (5, "z")]
MATCHED = {1: (1, "ab|has_b"), 2: (1, "ab"), 3: (0, ""), 4: (0, ""), 5: (1, "P_match")}


def matched(df):
    return {r["id"]: (r["P_flag"], r["P_terms"]) for r in df.collect()}


def test_catalog(spark):
    df = spark.createDataFrame(TEXTS, "id int, t string")
    catalog = spark.createDataFrame(CATALOG, "pattern string, description string")
    assert matched(screens.match_catalog(df, "t", catalog, "P")) == MATCHED
    for size in (1, 2, 4):
        assert matched(screens.match_catalog(df, "t", catalog, "P", literal_bytes=size)) == MATCHED
    contains = spark.createDataFrame([("a", "A"), ("[", "B")], "pattern string, description string")
    out = screens.match_catalog(df, "t", contains, "P", predicate=F.contains)
    assert matched(out)[1] == (1, "A")


@pytest.mark.parametrize(
    "pattern, literal",
    [
        ("abc", "abc"), ("a+bc", "bc"), ("(?:ab)+cde?", "ab"), ("x(yz)w", "xyzw"), ("ab|cd", ""), ("(?i)abc", ""),
        ("[ab]cd", "cd"), ("ab*cd", "cd"), ("^ab$", "ab"), (r"ab\\.c", "ab.c"), (r"\\Qa.b\\E", ""), ("[a&&[ab]]x", ""),
        ("(abc){0,2}x", "x"), ("a{2}b", "a"), ("(", ""), (r"a\\vb", ""), ("", ""), (r"\\d+kg", "kg"),
    ],
)
def test_required_literals(pattern, literal):
    assert required_literal(pattern.replace("\\\\", "\\")) == literal


def test_large_catalog_in_one_pass(spark):
    words = [f"key{i:06d}" for i in range(100_000)]
    catalog = spark.createDataFrame([(f"{w}[a-z]", f"d{i % 1000}") for i, w in enumerate(words)], "pattern string, description string")
    rows = [(i, f"some text with {words[7 * i]}x and {words[11 * i]}5") for i in range(200)]
    out = screens.match_catalog(spark.createDataFrame(rows, "id int, t string"), "t", catalog, "P")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["P_terms"] for r in out.collect()} == {i: f"d{7 * i % 1000}" for i, _ in rows}


def test_catalog_needs_no_shuffle(spark):
    df = spark.createDataFrame(TEXTS, "id int, t string")
    catalog = spark.createDataFrame(CATALOG, "pattern string, description string")
    plan = screens.match_catalog(df, "t", catalog, "P")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_match_with_function(spark):
    df = spark.createDataFrame(TEXTS, "id int, t string")

    def make():
        def match(text):
            if text == "q":
                raise ValueError(text)
            return ["b", "a", "b"] if text == "aab" else []

        return match

    out = matched(screens.match_terms_with(df, "t", make, "P"))
    assert out == {1: (1, "a|b"), 2: (0, ""), 3: (0, ""), 4: (0, ""), 5: (0, "")}


def test_screen_selection(spark):
    df = spark.createDataFrame([("CCO",)], "Smiles string")
    assert screens.apply_screens(df, []).columns == ["Smiles"]
    with pytest.raises(ValueError):
        screens.apply_screens(df, ["pains"])
    with pytest.raises(ValueError):
        screens.apply_screens(df, ["other"])
    assert len(fixed.CHELATOR_PATTERNS) == 6


def test_filter_reaches_the_scan(spark, assay, tmp_path, capsys):
    assay.write.parquet(str(tmp_path / "t"))
    filter_assay(spark.read.parquet(str(tmp_path / "t"))).select("row_idx").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(`Target ChEMBL ID`,CHEMBL332)" in plan
    schema = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "Standard Units" in schema and "Smiles" not in schema


def test_texts_are_objects_piece_by_piece(monkeypatch):
    from pyspark.sql import types as T

    from assaylane import batches
    from assaylane.functions import text as texts
    from assaylane.operators import enrich, screens

    long = pa.array(["é" * 300_000, None, "ﬁx", ""] * 5)
    parts = list(batches.pieces(long))
    assert len(parts) >= 3 and [i for a, b in parts for i in range(a, b)] == list(range(20))
    assert list(batches.pieces(long.slice(0, 0))) == [(0, 0)] and list(batches.pieces(pa.array([1, 2]))) == [(0, 2)]
    seen = []
    for module in (texts, enrich, screens):
        monkeypatch.setattr(module, "pieces", lambda c: [seen.append((a, b)) or (a, b) for a, b in batches.pieces(c)])
    assert texts._to_ascii.func(long).to_pylist() == ["e" * 300_000, None, "fix", ""] * 5
    assert seen == parts
    firsts = screens._mapped(long, lambda t: [t[:1]] if t else None, pa.list_(pa.string()))
    assert firsts.to_pylist() == [["é"], None, ["ﬁ"], None] * 5

    class Rows:
        schema = T.StructType([T.StructField("t", T.StringType())])

        def mapInArrow(self, run, schema):
            return run

    run = enrich.with_descriptors(Rows(), "t", lambda: lambda t: (t[:1], {"n": len(t)}), ["n"])
    found = list(run(iter([pa.record_batch([long], names=["t"])])))
    assert len(found) == len(parts) and pa.Table.from_batches(found).column("n").to_pylist() == [300_000.0, None, 2.0, None] * 5
