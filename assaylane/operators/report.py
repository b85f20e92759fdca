"""Ranking and the report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylane import fixed
from assaylane.functions.numeric import class_text, classify, round3
from assaylane.functions.text import clean_text, strip, truthy
from assaylane.operators.columns import col, pick_id
from assaylane.operators.ordering import ordered_index


def has_screens(df: DataFrame) -> bool:
    return any(c in df.columns for c in fixed.SCREEN_COLUMNS)


def _flag(df: DataFrame, name: str) -> Column:
    return truthy(col(name)) if name in df.columns else F.lit(False)


def _text(df: DataFrame, name: str) -> Column:
    return col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _count(df: DataFrame, name: str) -> Column:
    """Whole number of violations; text that is no whole number counts as missing."""
    if name not in df.columns:
        return F.lit(None).cast("long")
    if isinstance(df.schema[name].dataType, T.StringType):
        text = strip(col(name))
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))
    return col(name).try_cast("long")


def alert_summary(df: DataFrame) -> Column:
    """One line with all alerts of a row; ``""`` if the table has no screen columns at all."""
    if not has_screens(df):
        return F.lit("")

    def named(title: str, prefix: str) -> Column:
        term = clean_text(_text(df, f"{prefix}_terms"))
        shown = F.when(term != "", term).otherwise(fixed.TERM_YES)
        return F.when(_flag(df, f"{prefix}_flag"), F.concat(F.lit(f"{title}: "), shown))

    def counted(title: str, name: str) -> Column:
        n = _count(df, name)
        return F.when(n > 0, F.concat(F.lit(f"{title} alertas: "), n.cast("string")))

    line = F.concat_ws(
        " | ",
        named("PAINS", "PAINS"),
        named("Quelacion", "Chelator"),
        counted("Lipinski", "Lipinski_violations"),
        counted("Veber", "Veber_violations"),
    )
    return F.when(line != "", line).otherwise(fixed.NO_ALERTS)


def _shown(text: Column) -> Column:
    """Stripped text, or null when it is blank or spells a missing value."""
    plain = strip(text)
    return F.when((plain != "") & (F.lower(plain) != "nan"), plain)


def alert_cell(flag: Column, terms: Column) -> Column:
    """``No``, ``Sí`` or ``Sí (terms)``."""
    shown = _shown(terms.cast("string"))
    text = F.when(shown.isNotNull(), F.concat(F.lit(f"{fixed.ALERT_YES} ("), shown, F.lit(")")))
    return F.when(~flag, fixed.ALERT_NO).otherwise(F.coalesce(text, F.lit(fixed.ALERT_YES)))


def id_cell(id_: Column, smiles: Column) -> Column:
    """``id (smiles)``, or the id alone; a missing id is shown as ``nan``."""
    name = F.coalesce(strip(id_.cast("string")), F.lit("nan"))
    shown = _shown(smiles.cast("string"))
    return F.when(shown.isNotNull(), F.concat(name, F.lit(" ("), shown, F.lit(")"))).otherwise(name)


def decision(pred: Column, pains: Column, chelator: Column) -> Column:
    active = pred == 1
    return (
        F.when(active & pains, fixed.DISCARDED)
        .when(active & chelator, fixed.REVIEW)
        .when(active, fixed.SELECTED)
        .otherwise(fixed.NOT_SELECTED)
    )


def rank_predictions(
    df: DataFrame, prob: str = "prob_activo", ties: Sequence[str] = (fixed.ROW_INDEX,), out: str = "Rank"
) -> DataFrame:
    """Rank 1..n from the highest probability down, ties in the given order.

    Predicted class first and probability second is the same order, as the class is a step of it. Only probability and
    ties are sorted; the ranks are joined to the rows by them. So ``ties`` must tell all rows apart.
    """
    names = [f"_t{i}" for i in range(len(ties))]
    narrow = df.select(col(prob).alias("_p"), *[col(t).alias(n) for t, n in zip(ties, names)])
    ranked = ordered_index(narrow, [F.col("_p").desc(), *[F.col(n) for n in names]], "_rank")
    same = None
    for t, n in zip(ties, names):
        match = col(t).eqNullSafe(F.col(n))
        same = match if same is None else same & match
    joined = df.join(ranked.select(*names, "_rank"), same)
    return joined.select(*[col(c) for c in df.columns if c != out], F.col("_rank").alias(out))


def result_table(
    scored: DataFrame,
    prob: str = "prob_activo",
    threshold: float = 0.5,
    ties: Sequence[str] = (fixed.ROW_INDEX,),
    id_col: str | None = None,
) -> DataFrame:
    """Ranked results: ``Rank, ID, Prob_activo, Prediccion, Filtros``. Rows come unsorted, texts are made last."""
    id_name = id_col or pick_id(scored, ties[0])
    ranked = rank_predictions(scored, prob, ties, "_Rank")
    return ranked.select(
        F.col("_Rank").alias("Rank"),
        col(id_name).cast("string").alias("ID"),
        col(prob).alias("Prob_activo"),
        class_text(classify(col(prob), threshold)).alias("Prediccion"),
        alert_summary(scored).alias("Filtros"),
    )


def top_predictions(
    scored: DataFrame,
    n: int = 10,
    prob: str = "prob_activo",
    threshold: float = 0.5,
    ties: Sequence[str] = (fixed.ROW_INDEX,),
    id_col: str | None = None,
) -> DataFrame:
    """Best ``n`` rows of the result table. A top-k over the input: nothing else is ranked."""
    best = scored.orderBy(col(prob).desc(), *[col(t) for t in ties]).limit(n)
    return result_table(best, prob, threshold, ties, id_col).orderBy("Rank")


def final_report(
    scored: DataFrame,
    prob: str = "prob_activo",
    threshold: float = 0.5,
    ties: Sequence[str] = (fixed.ROW_INDEX,),
    id_col: str | None = None,
    sort: bool = True,
) -> DataFrame:
    """Report of six columns, best first: id, rounded score, class, both alerts and the decision."""
    id_name = id_col or pick_id(scored, ties[0])
    pred = classify(col(prob), threshold)
    pains, chelator = _flag(scored, "PAINS_flag"), _flag(scored, "Chelator_flag")
    cells = [
        id_cell(_text(scored, id_name), _text(scored, "canonical_smiles")),
        round3(col(prob).cast("double")),
        class_text(pred),
        alert_cell(pains, _text(scored, "PAINS_terms")),
        alert_cell(chelator, _text(scored, "Chelator_terms")),
        decision(pred, pains, chelator),
    ]
    named = [cell.alias(name) for cell, name in zip(cells, fixed.REPORT_HEADERS)]
    used = {prob, id_name, "canonical_smiles", *ties, *fixed.SCREEN_COLUMNS}
    needed = scored.select(*[col(c) for c in scored.columns if c in used])
    # the columns are sorted as they are, and the cells made afterwards
    ordered = needed.orderBy(col(prob).desc(), *[col(t) for t in ties]) if sort else needed
    return ordered.select(*named)


def prediction_summary(scored: DataFrame, prob: str = "prob_activo", threshold: float = 0.5) -> DataFrame:
    """One row: rows, predicted classes, and rows with any alert (null without screen columns)."""
    pred = classify(col(prob), threshold)
    alerts = F.count_if(has_alert(scored)) if has_screens(scored) else F.lit(None).cast("long")
    return scored.agg(
        F.count("*").alias("n"),
        F.count_if(pred == 1).alias("n_active"),
        F.count_if(F.coalesce(pred, F.lit(0)) != 1).alias("n_inactive"),
        alerts.alias("n_with_alerts"),
    )


def has_alert(df: DataFrame) -> Column:
    """Whether the alert line of a row says more than that there are none; no text is made for it."""
    flagged = _flag(df, "PAINS_flag") | _flag(df, "Chelator_flag")
    broken = [F.coalesce(_count(df, n) > 0, F.lit(False)) for n in ("Lipinski_violations", "Veber_violations")]
    return flagged | broken[0] | broken[1]
