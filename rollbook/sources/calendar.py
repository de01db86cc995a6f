"""The academic year as 372 fixed positions, and the holiday calendar.

A year runs from June to May. Every month gets 31 positions, so the position of a day
is arithmetic and needs no calendar table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook import vocabulary as v

MONTH_DAYS = 31
YEAR_POSITIONS = len(v.MONTHS) * MONTH_DAYS
_DAYS_IN_MONTH = {2: 29, 4: 30, 6: 30, 9: 30, 11: 30}
_HOLIDAY_SCHEMA = "map<string,map<string,map<string,array<int>>>>"


def position(month: Column, day: Column) -> Column:
    """0-based position of a day in the academic year."""
    return ((month + 6) % 12) * MONTH_DAYS + day - 1


def month_day(pos: int) -> tuple[int, int]:
    """Month and day at a position."""
    return v.MONTHS[pos // MONTH_DAYS], pos % MONTH_DAYS + 1


def real_positions() -> list[int]:
    """Positions that are dates (29 February counts as one)."""
    return [
        p
        for p in range(YEAR_POSITIONS)
        if month_day(p)[1] <= _DAYS_IN_MONTH.get(month_day(p)[0], MONTH_DAYS)
    ]


def year_start(date: Column) -> Column:
    """Calendar year in which the academic year of `date` begins."""
    return F.year(date) - F.when(F.month(date) < v.MONTHS[0], 1).otherwise(0)


def year_name(start: Column) -> Column:
    """Name such as '2223' of the academic year that begins in `start`."""
    two = lambda year: F.lpad((year % 100).cast("string"), 2, "0")
    return F.concat(two(start), two(start + 1))


def holidays_from_json(df: DataFrame, json: str) -> DataFrame:
    """Flatten year -> month -> category -> [days] documents to distinct (acad_year, month, day).

    Categories are merged and months outside 1..12 are left out.
    """
    years = df.select(F.explode(F.from_json(json, _HOLIDAY_SCHEMA)).alias("acad_year", "months"))
    months = years.select("acad_year", F.explode("months").alias("month", "categories"))
    days = months.select(
        "acad_year",
        F.expr("try_cast(month AS int)").alias("month"),
        F.explode(F.flatten(F.map_values("categories"))).alias("day"),
    )
    return days.filter(F.col("month").between(1, 12)).distinct()


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """`holidays_from_json` over JSON files, one document per file."""
    return holidays_from_json(spark.read.text(path, wholetext=True), "value")
