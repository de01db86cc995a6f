"""Sequence features of a table that holds several academic years.

Every year has valid days of its own: its holidays, and the days on which its rows have marks. They are kept as one row a
year with the stretches of the 372-character string that count, and each row of the table picks by its own year's
stretches. The table with the years' rows goes to every task, so features stay one projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rollbook import vocabulary as v
from rollbook.functions import text
from rollbook.functions.ordering import cut_lineage
from rollbook.operators import cleaning, sequence
from rollbook.operators.sequence import SequenceConfig
from rollbook.sources import calendar

#: A column with more values than this is no academic year; it bounds the rows that go to every task.
MOST_YEARS = 1_000
_YEAR = "__year"
_BINARY = "__binary"


def year_of(df: DataFrame, year: str) -> Column:
    """The academic year's name: a column of names such as '2223' as it is, one of starting years by name."""
    column = F.col(f"`{year}`")
    return calendar.year_name(column) if isinstance(df.schema[year].dataType, IntegralType) else column.cast("string")


def missing_shares(sequences: DataFrame, year: str, days: str = "days") -> DataFrame:
    """(year, pos, month, day, missing_share): `sequence.missing_shares` of each year by itself."""
    return sequence.missing_shares(sequences, days, [year])


def valid_days(
    sequences: DataFrame,
    year: str,
    holidays: DataFrame | None = None,
    max_missing: float = v.MAX_MISSING,
    days: str = "days",
    dates: Sequence[int] | None = None,
) -> DataFrame:
    """(year, month, day, pos, missing_share): each year's dates that are no holiday of that year and are missing for
    less than `max_missing` of that year's rows. `dates` limits them to positions that have a column."""
    shares = missing_shares(sequences, year, days).filter(F.col("missing_share") < max_missing)
    if dates is not None:
        shares = shares.filter(F.col("pos").isin(list(dates)))
    if holidays is not None:
        off = holidays.select(F.col("acad_year").alias(_YEAR), F.col("month").alias("__month"), F.col("day").alias("__day"))
        same = (year_of(shares, year) == F.col(_YEAR)) & (F.col("month") == F.col("__month")) & (F.col("day") == F.col("__day"))
        shares = shares.join(off, same, "left_anti")
    return shares.select(f"`{year}`", "month", "day", "pos", "missing_share")


def day_masks(valid: DataFrame, year: str, groups: Mapping[str, Sequence[int]]) -> DataFrame:
    """One row a year: `runs_<group>`, the (start, size) stretches of the group's valid days, and `len_<group>`, their number."""
    chosen = valid.groupBy(F.col(f"`{year}`").alias(_YEAR)).agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("month").isin(list(months)), F.col("pos")))).alias(group)
            for group, months in groups.items()
        ]
    )

    def runs(positions: Column) -> Column:
        starts = F.filter(positions, lambda p: ~F.array_contains(positions, p - 1))
        ends = F.filter(positions, lambda p: ~F.array_contains(positions, p + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("size")))

    return chosen.select(
        _YEAR,
        *[runs(F.col(f"`{g}`")).alias(f"runs_{g}") for g in groups],
        *[F.size(F.col(f"`{g}`")).alias(f"len_{g}") for g in groups],
    )


def group_sequences(
    df: DataFrame, masks: DataFrame, year: str, groups: Sequence[str], days: str = "days"
) -> DataFrame:
    """Add `seq_<group>`, the valid days of the row's own year, and `len_<group>`.

    Both are null where the row's year has no valid day in the group.
    """
    if masks.count() > MOST_YEARS:
        raise ValueError(f"'{year}' has more than {MOST_YEARS} values, it is no academic year")
    joined = df.join(F.broadcast(masks), F.col(f"`{year}`").eqNullSafe(F.col(_YEAR)), "left")
    pick = lambda r: F.substr(F.col(days), r["start"] + 1, r["size"])
    some = lambda g: F.col(f"`len_{g}`") > 0
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.when(some(g), F.array_join(F.transform(F.col(f"`runs_{g}`"), pick), "")).alias(f"seq_{g}") for g in groups],
        *[F.when(some(g), F.col(f"`len_{g}`")).alias(f"len_{g}") for g in groups],
    )


def pattern_fractions(
    seq: Column, length: Column, partitions: Sequence[int], patterns: Sequence[str], prefix: str
) -> dict[str, Column]:
    """As `sequence.pattern_fractions`, for a length that differs from row to row; fewer days than partitions are an error."""
    found = {}
    for n in partitions:
        size = F.floor(length / n)
        told = F.concat(length.cast("string"), F.lit(f" days cannot be cut into {n} partitions"))
        size = F.when(length < n, F.raise_error(told)).otherwise(size)
        for i in range(n):
            own = size if i < n - 1 else length - size * (n - 1)
            part = F.substr(seq, (size * i + 1).cast("int"), own.cast("int"))
            for pattern in patterns:
                step = len(pattern) - text.border(pattern)
                most = F.floor((own - len(pattern)) / step) + 1
                count = text.count_overlapping(part, pattern).cast("double")
                found[f"{prefix}_partns_{n}_partn_{i + 1}_frac_{pattern}"] = count / F.nullif(most, F.lit(0)).cast("double")
    return found


def attendance_features(
    df: DataFrame, valid: DataFrame, year: str, config: SequenceConfig = SequenceConfig(), days: str = "days"
) -> DataFrame:
    """Add all configured features to a frame with a `days` string and a year, and drop the string.

    `valid` has the years' valid days; none at all is an error. Features of a group in which the row's year has no valid
    day are null. A group without valid days in any year is left out.
    """
    groups = {**config.month_groups, _BINARY: config.binary_months}
    masks = cut_lineage(day_masks(valid, year, groups))
    most = masks.agg(*[F.coalesce(F.max(f"len_{g}"), F.lit(0)).alias(g) for g in groups], F.count("*").alias("__years")).first()
    if not most["__years"]:
        raise ValueError("no valid attendance days")
    present = [g for g in groups if most[g]]
    with_seqs = group_sequences(df, masks, year, present, days)
    patterns = text.pattern_strings(config.char_combinations)
    made: dict[str, Column] = {}
    for group in config.month_groups:
        if group in present:
            seq = F.col(f"`seq_{group}`")
            made.update(pattern_fractions(seq, F.col(f"`len_{group}`"), config.partitions, patterns, group))
            made.update(sequence.last_occurrence(seq, group))
    if _BINARY in present:
        seq = F.col(f"seq_{_BINARY}")
        flags = sequence.binary_absence(seq, config.absence_thresholds)
        made.update({name: F.when(seq.isNotNull(), flag) for name, flag in flags.items()})
    kept = [F.col(f"`{c}`") for c in df.columns if c != days]
    return with_seqs.select(*kept, *[column.alias(name) for name, column in made.items()])


def features_from_long(
    long: DataFrame, by: Sequence[str], year: str, holidays: DataFrame | None = None, config: SequenceConfig = SequenceConfig()
) -> DataFrame:
    """Rows (id.., year, month, day, status) to one row of features per id and year; `by` names id and year."""
    sequences = cut_lineage(sequence.build_sequence(long, by))
    return attendance_features(sequences, valid_days(sequences, year, holidays, config.max_missing), year, config)


def engineer(
    df: DataFrame,
    holidays: DataFrame | None,
    year: str,
    config: SequenceConfig = SequenceConfig(),
    drop: Sequence[str] = (),
    groups: Mapping[str, Sequence[str]] | None = None,
    index: str = v.INDEX,
    label: str | None = v.LABEL,
    dates: Sequence[int] | None = None,
) -> tuple[DataFrame, list[str], list[str]]:
    """As `sequence.engineer`, for a frame whose column `year` names each row's academic year; the column goes."""
    if dates is None:
        dates = sequence.column_positions(df)
        df = sequence.sequence_from_wide(df)
    valid = valid_days(df, year, holidays, config.max_missing, dates=dates)
    made = attendance_features(df, valid, year, config).drop(year)
    features = cleaning.drop_columns(made, drop, groups)
    categorical, numerical = cleaning.split_features(features, index, label)
    return features, categorical, numerical
