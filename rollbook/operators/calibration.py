"""Isotonic calibration of scores."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook import vocabulary as v
from rollbook.operators import curves


def fit_calibrator(
    df: DataFrame, score: str, label: str, bins: int = v.CALIBRATION_BINS, table: DataFrame | None = None
) -> IsotonicRegressionModel:
    """Fit on the (mean score, positive rate) pairs of the non-empty bins, each with weight 1."""
    # Bins need no order, so rows do.
    table = curves.score_rows(df, score, label) if table is None else table
    return fit_bins(curves.calibration_bins(table, bins))


def fit_bins(binned: DataFrame) -> IsotonicRegressionModel:
    """Fit on a calibration table: at most one row per bin."""
    return IsotonicRegression(
        featuresCol="mean_score", labelCol="positive_rate", predictionCol="calibrated"
    ).fit(binned.select("mean_score", "positive_rate"))


def calibrate(model: IsotonicRegressionModel, df: DataFrame, score: str, out: str) -> DataFrame:
    """Add the calibrated score: straight lines between the knots, constant outside them."""
    bound = model.copy().setFeaturesCol("__raw").setPredictionCol("__calibrated")
    return (
        bound.transform(df.withColumn("__raw", F.col(score).cast("double")))
        .withColumn(out, F.col("__calibrated"))
        .drop("__raw", "__calibrated")
    )
