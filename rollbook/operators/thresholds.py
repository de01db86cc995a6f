"""Choosing thresholds and summing a split up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook import vocabulary as v
from rollbook.operators import curves


def max_f1(table: DataFrame, eps: float = v.F1_EPS_MODEL) -> DataFrame:
    """(threshold, f1) of the best F1; the smallest threshold at ties."""
    p, r = F.col("precision"), F.col("recall")
    return (
        curves.curve_points(table)
        .select("threshold", (F.lit(2.0) * p * r / (p + r + F.lit(eps))).alias("f1"))
        .orderBy(F.col("f1").desc(), F.col("threshold").asc())
        .limit(1)
    )


def nearest_recall(table: DataFrame, target: float) -> DataFrame:
    """(threshold, recall) whose recall is closest to `target`; the smallest threshold at ties."""
    return (
        curves.curve_points(table)
        .select("threshold", "recall")
        .orderBy(F.abs(F.col("recall") - F.lit(float(target))).asc(), F.col("threshold").asc())
        .limit(1)
    )


def best_thresholds(
    df: DataFrame,
    score: str,
    label: str,
    id: str,
    eps: float = v.F1_EPS_MODEL,
    points: int = v.RECALL_POINTS,
    cap: bool = False,
    table: DataFrame | None = None,
) -> DataFrame:
    """One row (max_f1, max_lift) of thresholds.

    Max lift: the recall at the first k with the largest lift, then the threshold with
    the nearest recall. With `cap` and the smaller `eps` this is the evaluation's
    variant, without them the model's.
    """
    table = curves.score_table(df, score, label) if table is None else table
    top = (
        curves.recall_at_k(df, score, label, id, points, cap, table)
        .orderBy(F.col("lift").desc(), F.col("point").asc())
        .first()
    )
    f1 = max_f1(table, eps).first()
    lift = nearest_recall(table, top.recall).first()
    return df.sparkSession.range(1).select(
        F.lit(f1.threshold).alias("max_f1"), F.lit(lift.threshold).alias("max_lift")
    )


def split_thresholds(
    df: DataFrame,
    score: str,
    label: str,
    id: str,
    named: Mapping[str, float | None] | None = None,
    table: DataFrame | None = None,
) -> dict[str, float]:
    """The split's own max_f1 and max_lift thresholds, then the named ones that have a value."""
    row = best_thresholds(df, score, label, id, v.F1_EPS_EVALUATION, cap=True, table=table).first()
    own = {"max_f1": row.max_f1, "max_lift": row.max_lift}
    return {k: t for k, t in {**own, **(named or {})}.items() if t is not None}


def threshold_for(table: DataFrame, target_recall: float | None = None, eps: float = v.F1_EPS_MODEL) -> float:
    """The threshold nearest to a wanted recall or, without one, that of the best F1."""
    chosen = max_f1(table, eps) if target_recall is None else nearest_recall(table, target_recall)
    return chosen.first().threshold


def summary(table: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row: prevalence, threshold, precision, recall, auc, ap.

    The threshold is the split's own max-F1 one unless given.
    """
    if threshold is None:
        threshold = threshold_for(table, eps=v.F1_EPS_EVALUATION)
    return curves.summary_at(table, threshold)


def evaluate(
    df: DataFrame,
    score: str = v.PROBA_1,
    label: str | None = v.LABEL,
    id: str = v.INDEX,
    named: Mapping[str, float | None] | None = None,
) -> dict[str, DataFrame]:
    """All evaluation tables of one split; without a label only those that need none."""
    label = label if label in df.columns else None
    table = curves.score_table(df, score, label)
    result = {
        "histogram": curves.histogram(table, "score", weight="n"),
        "flag_rate": curves.flag_rate(table),
    }
    if label is None:
        return result
    thresholds = split_thresholds(df, score, label, id, named, table)
    result.update(
        pr_curve=curves.pr_curve(table),
        roc_curve=curves.roc_curve(table),
        areas=curves.areas(table),
        thresholds=curves.metrics_at(table, thresholds),
        calibration=curves.calibration_bins(table),
        histogram_by_label=curves.histogram(curves.labelled_counts(table, label), "score", by=label, weight="n"),
        error_histogram=curves.error_histogram(table, label),
        ppv_npv=curves.ppv_npv(table),
        recall_at_k=curves.recall_at_k(df, score, label, id, table=table),
        summary=summary(table, thresholds["max_f1"]),
    )
    return result
