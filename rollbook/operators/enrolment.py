"""Merging the three sources and deriving the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dropout_label(enrol: DataFrame, id: str, year: str, last_year: int | None = None) -> DataFrame:
    """(id, year, target): 1 where the id is not enrolled in the following year.

    The last year seen has no label, as its following year is unknown. Years are
    gathered per id (one short set each), so one shuffle replaces a distinct and a
    self-join.
    """
    if last_year is None:
        last_year = enrol.agg(F.max(year)).first()[0]
    years = enrol.groupBy(id).agg(F.collect_set(year).alias("__years"))
    return (
        years.select(id, "__years", F.explode("__years").alias(year))
        .filter(F.col(year) < F.lit(last_year))
        .select(
            id,
            year,
            F.when(F.array_contains("__years", F.col(year) + 1), 0).otherwise(1).alias("target"),
        )
    )


def exams_wide(
    exams: DataFrame, id: str | Sequence[str], subject: str, score: str, subjects: list[str]
) -> DataFrame:
    """One row per id (one or several columns) with `<subject>_score` columns; several marks of a subject keep the best."""
    by = [id] if isinstance(id, str) else list(id)
    wide = exams.groupBy(*by).pivot(subject, subjects).agg(F.max(score))
    return wide.select(*by, *[F.col(f"`{s}`").alias(f"{s}_score") for s in subjects])


def unify(enrol: DataFrame, sequences: DataFrame, exams: DataFrame, id: str | Sequence[str]) -> DataFrame:
    """One row per enrolled id with its day statuses and exam columns, where it has any.

    All three inputs hold one row per id.
    """
    by = [id] if isinstance(id, str) else list(id)
    return enrol.join(sequences, by, "left").join(exams, by, "left")
