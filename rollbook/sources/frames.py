"""Sinks for the frames a run leaves behind."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_frames(frames: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Write each split as Parquet under `path`/split=<name>."""
    for name, df in frames.items():
        df.write.mode(mode).parquet(f"{path}/split={name}")


def write_scores(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write validation scores as CSV with a header."""
    df.write.mode(mode).csv(path, header=True)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a small table of metrics as one JSON-lines file."""
    df.coalesce(1).write.mode(mode).json(path)


def metrics_long(df: DataFrame, split: str) -> DataFrame:
    """One row of named metrics -> rows (split, metric, value)."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    return values.unpivot([], df.columns, "metric", "value").select(
        F.lit(split).alias("split"), "metric", "value"
    )
