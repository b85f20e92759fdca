"""Scoring with a stored model, and its reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from assaylane.fixed import ROW_INDEX
from assaylane.operators.report import final_report, prediction_summary, result_table
from assaylane.plans.ensembles import Ensemble
from assaylane.plans.store import load_model
from assaylane.session import materialize
from assaylane.sources.rows import with_row_index


@dataclass
class Predictions:
    """Scores and reports of a table; nothing runs before one of them is asked for."""

    table: DataFrame
    model: Ensemble
    threshold: float
    row_index: str
    id_col: str | None

    @cached_property
    def scored(self) -> DataFrame:
        """The table with its probabilities, written once for all reports."""
        return materialize(self.model.predict(self.table))

    @property
    def _options(self) -> dict:
        return {"threshold": self.threshold, "ties": (self.row_index,), "id_col": self.id_col}

    @property
    def results(self) -> DataFrame:
        return result_table(self.scored, **self._options)

    @property
    def report(self) -> DataFrame:
        return final_report(self.scored, **self._options)

    @property
    def summary(self) -> DataFrame:
        return prediction_summary(self.scored, threshold=self.threshold)


def predict(
    df: DataFrame, model: Ensemble | str, threshold: float = 0.5, row_index: str = ROW_INDEX, id_col: str | None = None
) -> Predictions:
    """Score a table, rank it and build the reports. Rows are numbered if the table has no ``row_index``."""
    if isinstance(model, str):
        model = load_model(df.sparkSession, model)
    if row_index not in df.columns:
        df = with_row_index(df, row_index)
    return Predictions(df, model, threshold, row_index, id_col)
