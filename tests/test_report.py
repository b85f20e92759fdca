"""Report texts on hand-made rows."""

import pytest

from assaylane import fixed
from assaylane.operators import report

ROWS = [
    (0, "A ", "CCO", 0.9, "1", "a|b", 1, "thiol", 0.0, 0.0),
    (1, "B", None, 0.8, "0", None, 1, None, 2.0, None),
    (2, None, "nan", 0.5, None, None, 0, "", 0.0, 0.0),
    (3, "D", " ", 0.4, "1", "x", 0, None, 0.0, 1.0),
]
SCHEMA = (
    "row_idx long, `Molecule ChEMBL ID` string, canonical_smiles string, prob_activo double, PAINS_flag string, "
    "PAINS_terms string, Chelator_flag int, Chelator_terms string, Lipinski_violations double, Veber_violations double"
)


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_report(scored):
    rows = [tuple(r) for r in report.final_report(scored).collect()]
    assert rows == [
        ("A (CCO)", 0.9, "Activo", "Sí (a|b)", "Sí (thiol)", fixed.DISCARDED),
        ("B", 0.8, "Activo", "No", "Sí", fixed.REVIEW),
        ("nan", 0.5, "Activo", "No", "No", fixed.SELECTED),
        ("D", 0.4, "Inactivo", "Sí (x)", "No", fixed.NOT_SELECTED),
    ]


def test_results(scored):
    rows = [tuple(r) for r in report.result_table(scored).orderBy("Rank").collect()]
    assert rows == [
        (1, "A ", 0.9, "Activo", "PAINS: a|b | Quelacion: thiol"),
        (2, "B", 0.8, "Activo", "Quelacion: si | Lipinski alertas: 2"),
        (3, None, 0.5, "Activo", "Sin alertas"),
        (4, "D", 0.4, "Inactivo", "PAINS: x | Veber alertas: 1"),
    ]
    top = report.top_predictions(scored, 2).collect()
    assert [tuple(r) for r in top] == rows[:2]


def test_text_counts_and_missing_columns(spark, scored):
    text = spark.createDataFrame([(0, 0.1, "2", "2.0"), (1, 0.2, "x", None)],
                                 "row_idx long, prob_activo double, Lipinski_violations string, Veber_violations string")
    rows = {r["ID"]: r["Filtros"] for r in report.result_table(text).collect()}
    assert rows == {"0": "Lipinski alertas: 2", "1": "Sin alertas"}
    bare = scored.select("row_idx", "prob_activo")
    assert {r["Filtros"] for r in report.result_table(bare).collect()} == {""}
    assert report.final_report(bare).first()[fixed.REPORT_HEADERS[0]] == "0"


def test_summary(scored):
    assert report.prediction_summary(scored).first().asDict() == {
        "n": 4, "n_active": 3, "n_inactive": 1, "n_with_alerts": 3,
    }


def test_stateless_operators_run_on_a_stream(spark, scored, tmp_path):
    scored.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scored.schema).parquet(str(tmp_path / "in"))
    shown = report.final_report(stream, sort=False)
    query = (
        shown.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    want = sorted(map(tuple, report.final_report(scored, sort=False).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
