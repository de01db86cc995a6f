"""Explaining a scored frame by predictor groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook import vocabulary as v
from rollbook.operators import curves, thresholds
from rollbook.operators.attribution import shap_values
from rollbook.operators.explanation import check_groups, explain_groups, shap_columns
from rollbook.operators.model import EwsModel


def explain(
    df: DataFrame,
    model_path: str,
    groups: Mapping[str, Sequence[str]],
    threshold: float | None = None,
    target_recall: float | None = None,
    validation: DataFrame | None = None,
    label: str = v.LABEL,
    wide: bool = False,
    path: str | None = None,
) -> DataFrame:
    """Add attributions, ranked groups with their top drivers, and the label text.

    Without a `threshold` it is taken from the scored `validation` frame: the one nearest
    to `target_recall` or, without that, the best F1. `wide` gives one `shap[<feature>]`
    column per feature instead of the struct. With a `path` the result is written there
    and read back.
    """
    fitted = EwsModel.load(model_path)
    usable = check_groups(groups, fitted.features)
    if threshold is None:
        if validation is None:
            raise ValueError("give a threshold or the scored validation frame")
        table = curves.score_table(validation, v.PROBA_1, label)
        threshold = thresholds.threshold_for(table, target_recall)
    cast = df.withColumns(
        {
            **{c: F.col(f"`{c}`").cast("double") for c in fitted.numerical},
            **{c: F.col(f"`{c}`").cast("string") for c in fitted.categorical},
        }
    )
    explained = explain_groups(shap_values(fitted, cast, model_path), usable, threshold)
    if wide:
        explained = shap_columns(explained, fitted.features)
    if path is None:
        return explained
    explained.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
