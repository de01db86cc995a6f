"""Attendance sequences and the features read off them.

A year of one id is a string of 372 characters, one per position of
`rollbook.sources.calendar`. Building it takes the only shuffle; choosing valid days,
month groups and partitions are substrings of it, so any number of features is one
row-local projection.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook import vocabulary as v
from rollbook.functions import text
from rollbook.functions.ordering import cut_lineage
from rollbook.operators import cleaning
from rollbook.sources import calendar


@dataclass(frozen=True)
class SequenceConfig:
    """What to compute; the defaults are those of the original pipeline."""

    month_groups: Mapping[str, Sequence[int]] = field(default_factory=lambda: dict(v.MONTH_GROUPS))
    char_combinations: Sequence[tuple[int, Sequence[str]]] = v.CHAR_COMBINATIONS
    partitions: Sequence[int] = v.PARTITIONS
    max_missing: float = v.MAX_MISSING
    binary_months: Sequence[int] = v.BINARY_MONTHS
    absence_thresholds: Sequence[int] = v.ABSENCE_THRESHOLDS


def day_columns(names: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Columns named `month_day` -> (month, day), in the given order.

    Each has one place of its own in the year: months outside 1..12, days outside 1..31, and two columns for the same
    day (`6_1` and `06_1`) are errors. Dates such as 31 June have a place and are allowed.
    """
    found = {}
    for name in names:
        match = re.match(v.DAY_COLUMN, name)
        if match:
            found[name] = int(match.group(1)), int(match.group(2))
    wrong = [name for name, (month, day) in found.items() if not (1 <= month <= 12 and 1 <= day <= calendar.MONTH_DAYS)]
    if wrong:
        raise ValueError(f"day columns outside the year: {', '.join(wrong)}")
    dates = list(found.values())
    twice = [name for name, date in found.items() if dates.count(date) > 1]
    if twice:
        raise ValueError(f"several columns for one day: {', '.join(twice)}")
    return found


def to_long(df: DataFrame, id: str, keep: Sequence[str] = ()) -> DataFrame:
    """Wide day columns to rows (id, month, day, status)."""
    days = list(day_columns(df.columns))
    rows = df.unpivot([id, *keep], days, "__day", "status")
    return rows.select(
        id,
        *keep,
        F.regexp_extract("__day", v.DAY_COLUMN, 1).cast("int").alias("month"),
        F.regexp_extract("__day", v.DAY_COLUMN, 2).cast("int").alias("day"),
        "status",
    )


def _one_char(status: Column) -> Column:
    return F.when((F.length(status) == 1) & (F.ascii(status) < 256), status).otherwise(
        F.raise_error(F.concat(F.lit("a status is one Latin-1 character, not: "), status))
    )


def _place(month: Column, day: Column) -> Column:
    """Position of a date; null without one, an error for a month or day that does not exist."""
    wrong = ~(month.between(1, 12) & day.between(1, calendar.MONTH_DAYS))
    told = F.concat(F.lit("a date outside the year: month "), month.cast("string"), F.lit(", day "), day.cast("string"))
    return F.when(wrong, F.raise_error(told)).otherwise(calendar.position(month, day))


def build_sequence(long: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Rows (id.., month, day, status) to (id.., days), one string of 372 characters per id.

    Days without a row, and rows without a status, are missing; rows without month or day mark no day, and months
    outside 1..12 or days outside 1..31 are errors. Where a day has several
    rows, present wins over absent, absent over any other status and missing comes last.

    Two aggregations: the first reduces the rows to one small number per id and day, on
    the map side first and spread by both, so an id with very many rows is no burden on
    one task; the second gathers at most 372 of them per id.
    """
    by = [by] if isinstance(by, str) else list(by)
    status = F.coalesce(F.col("status"), F.lit(v.MISSING))
    rank = (
        F.when(status == v.PRESENT, 0).when(status == v.ABSENT, 1).when(status == v.MISSING, 3).otherwise(2)
    )
    per_day = (
        long.select(
            *by,
            _place(F.col("month"), F.col("day")).cast("int").alias("pos"),
            (rank * 256 + F.ascii(_one_char(status))).alias("code"),
        )
        .groupBy(*by, "pos")
        .agg(F.min("code").alias("code"))
    )
    marks = per_day.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("marks"))
    # Every mark brings the missing days between it and the one before.
    gap = lambda x, i: x["pos"] - F.coalesce(F.get("marks", i - 1)["pos"], F.lit(-1)) - 1
    pieces = F.transform(
        "marks", lambda x, i: F.concat(F.repeat(F.lit(v.MISSING), gap(x, i)), F.chr(x["code"] % 256))
    )
    return marks.select(
        *by, F.rpad(F.array_join(pieces, ""), calendar.YEAR_POSITIONS, v.MISSING).alias("days")
    )


def sequence_from_wide(df: DataFrame, out: str = "days") -> DataFrame:
    """Replace the `month_day` columns by one 372-character string; no shuffle."""
    names = {calendar_position(*md): name for name, md in day_columns(df.columns).items()}
    pieces = [
        _one_char(F.coalesce(F.col(f"`{names[p]}`"), F.lit(v.MISSING))) if p in names else F.lit(v.MISSING)
        for p in range(calendar.YEAR_POSITIONS)
    ]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in set(names.values())]
    return df.select(*kept, F.concat(*pieces).alias(out))


def column_positions(df: DataFrame) -> list[int]:
    """Positions that have a day column."""
    return sorted(calendar_position(*md) for md in day_columns(df.columns).values())


def calendar_position(month: int, day: int) -> int:
    """Position of a date given as numbers."""
    return (month + 6) % 12 * calendar.MONTH_DAYS + day - 1


def missing_shares(sequences: DataFrame, days: str = "days", by: Sequence[str] = ()) -> DataFrame:
    """(by.., pos, month, day, missing_share) for every date of the year, over all given rows or those of each `by`.

    Places that are no date, such as 31 June, are left out unless a row has a mark there. Marks are counted as one
    vector of 372 places, so a task hands on one row for each `by`, and only these rows become rows by place.
    """
    marked = F.transform(F.split(days, ""), lambda status: F.when(status == v.MISSING, 0.0).otherwise(1.0))
    keys = [F.col(f"`{c}`") for c in by]
    places = sequences.select(*keys, array_to_vector(F.slice(marked, 1, calendar.YEAR_POSITIONS)).alias("__marked"))
    counted = places.groupBy(*by).agg(
        vector_to_array(Summarizer.numNonZeros(F.col("__marked"))).alias("__n"), F.count(F.lit(1)).alias("__rows")
    ).filter(F.col("__rows") > 0)
    per_day = counted.select(*keys, "__rows", F.posexplode("__n").alias("pos", "__n")).select(
        *keys, "pos", ((F.col("__rows") - F.col("__n")) / F.col("__rows")).alias("missing_share")
    )
    month = (F.floor(F.col("pos") / calendar.MONTH_DAYS).cast("int") + 5) % 12 + 1
    return per_day.filter(F.col("pos").isin(calendar.real_positions()) | (F.col("missing_share") < 1)).select(
        *keys, "pos", month.alias("month"), (F.col("pos") % calendar.MONTH_DAYS + 1).alias("day"), "missing_share"
    )


def valid_days(
    sequences: DataFrame,
    holidays: DataFrame | None = None,
    acad_year: str | None = None,
    max_missing: float = v.MAX_MISSING,
    days: str = "days",
) -> DataFrame:
    """Dates of the year that are no holiday and are missing for less than `max_missing` of the rows.

    Evaluated on the rows given, so each split has its own valid days unless the caller
    passes one split's on to the others.
    """
    shares = missing_shares(sequences, days).filter(F.col("missing_share") < max_missing)
    if holidays is not None:
        off = holidays if acad_year is None else holidays.filter(F.col("acad_year") == acad_year)
        shares = shares.join(off.select("month", "day"), ["month", "day"], "left_anti")
    return shares.select("month", "day", "pos", "missing_share")


def positions_of(valid: DataFrame) -> list[int]:
    """The valid positions in calendar order: at most 372 numbers."""
    return sorted(row.pos for row in valid.select("pos").collect())


def positions_in(positions: Sequence[int], months: Sequence[int]) -> list[int]:
    """The positions that fall in the given months, in calendar order."""
    wanted = set(months)
    return [p for p in positions if calendar.month_day(p)[0] in wanted]


def partition_bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of `parts` equal stretches; the last also takes the remainder."""
    size, rest = divmod(length, parts)
    if size == 0:
        raise ValueError(f"{length} days cannot be cut into {parts} partitions")
    return [(i * size, size + (rest if i == parts - 1 else 0)) for i in range(parts)]


def pattern_fractions(
    seq: Column, length: int, partitions: Sequence[int], patterns: Sequence[str], prefix: str
) -> dict[str, Column]:
    """Occurrences of every pattern in every partition, as a share of the most that could fit."""
    found = {}
    for n in partitions:
        for i, (start, size) in enumerate(partition_bounds(length, n), 1):
            part = F.substring(seq, start + 1, size)
            for pattern in patterns:
                most = text.max_overlaps(size, pattern)
                name = f"{prefix}_partns_{n}_partn_{i}_frac_{pattern}"
                # A pattern longer than its partition never occurs; the bound may then be 0 or less.
                found[name] = (
                    text.count_overlapping(part, pattern).cast("double") / F.lit(float(most))
                    if most != 0
                    else F.lit(None).cast("double")
                )
    return found


def last_occurrence(seq: Column, prefix: str) -> dict[str, Column]:
    """Relative position of the last day of every status; 0 where there is none."""
    return {
        f"{prefix}_last_{c}": text.last_position(seq, c) / (F.length(seq) + F.lit(1e-10))
        for c in v.STATUSES
    }


def binary_absence(seq: Column, thresholds: Sequence[int]) -> dict[str, Column]:
    """1.0 where the last t days hold no present day, else 0.0.

    A shorter history counts whole, and so does every history for t = 0.
    """
    last = lambda t: F.right(seq, F.lit(t)) if t else seq
    return {
        f"binary_absence_{t}": F.when(F.instr(last(t), v.PRESENT) > 0, 0.0).otherwise(1.0)
        for t in thresholds
    }


def group_sequences(
    df: DataFrame, positions: Sequence[int], groups: Mapping[str, Sequence[int]], days: str = "days"
) -> tuple[DataFrame, dict[str, int]]:
    """Add `seq_<group>` with the valid days of each month group; returns the lengths too.

    Groups without valid days are left out.
    """
    chosen = {g: positions_in(positions, months) for g, months in groups.items()}
    chosen = {g: p for g, p in chosen.items() if p}
    added = df.withColumns({f"seq_{g}": text.pick_runs(F.col(days), text.runs_of(p)) for g, p in chosen.items()})
    return added, {g: len(p) for g, p in chosen.items()}


def attendance_features(
    df: DataFrame, positions: Sequence[int], config: SequenceConfig = SequenceConfig(), days: str = "days"
) -> DataFrame:
    """Add all configured features to a frame with a `days` string and drop the string.

    `positions` are the valid days (`positions_of`); none at all is an error.
    """
    if not positions:
        raise ValueError("no valid attendance days")
    groups = {**config.month_groups, "__binary": config.binary_months}
    with_seqs, lengths = group_sequences(df, positions, groups, days)
    patterns = text.pattern_strings(config.char_combinations)
    made: dict[str, Column] = {}
    for group in config.month_groups:
        if group in lengths:
            seq = F.col(f"seq_{group}")
            made.update(pattern_fractions(seq, lengths[group], config.partitions, patterns, group))
            made.update(last_occurrence(seq, group))
    if "__binary" in lengths:
        made.update(binary_absence(F.col("seq___binary"), config.absence_thresholds))
    kept = [F.col(f"`{c}`") for c in df.columns if c != days]
    return with_seqs.select(*kept, *[column.alias(name) for name, column in made.items()])


def features_from_long(
    long: DataFrame,
    by: str | Sequence[str],
    holidays: DataFrame | None = None,
    acad_year: str | None = None,
    config: SequenceConfig = SequenceConfig(),
) -> DataFrame:
    """Rows (id.., month, day, status) to one row of features per id.

    The sequences are written to the checkpoint folder: the valid days and the features
    both read them, and the long rows are read once.
    """
    sequences = cut_lineage(build_sequence(long, by))
    valid = valid_days(sequences, holidays, acad_year, config.max_missing)
    return attendance_features(sequences, positions_of(valid), config)


def valid_positions(
    df: DataFrame, holidays: DataFrame | None, acad_year: str, max_missing: float, dates: Sequence[int]
) -> list[int]:
    """Valid days of a frame with a `days` string, among the `dates` it has columns for.

    Other days are all missing, which only matters if `max_missing` exceeds 1.
    """
    own = set(dates)
    return [p for p in positions_of(valid_days(df, holidays, acad_year, max_missing)) if p in own]


def engineer(
    df: DataFrame,
    holidays: DataFrame | None,
    acad_year: str,
    config: SequenceConfig = SequenceConfig(),
    drop: Sequence[str] = (),
    groups: Mapping[str, Sequence[str]] | None = None,
    index: str = v.INDEX,
    label: str | None = v.LABEL,
    dates: Sequence[int] | None = None,
    positions: Sequence[int] | None = None,
) -> tuple[DataFrame, list[str], list[str]]:
    """Cleaned frame to features; returns it with its categorical and numerical features.

    The frame has day columns, or a `days` string made from them together with `dates`,
    the positions that had a column. The valid days are its own unless `positions` brings
    those of another frame.
    """
    if dates is None:
        dates = column_positions(df)
        df = sequence_from_wide(df)
    if positions is None:
        positions = valid_positions(df, holidays, acad_year, config.max_missing, dates)
    features = cleaning.drop_columns(attendance_features(df, positions, config), drop, groups)
    categorical, numerical = cleaning.split_features(features, index, label)
    return features, categorical, numerical
