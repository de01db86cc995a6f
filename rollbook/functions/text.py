"""Column expressions over status strings. Everything here runs inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_strings(combos: Iterable[tuple[int, Sequence[str]]]) -> list[str]:
    """All strings up to the given length over each alphabet, sorted, each once; blank ones are no patterns."""
    found: set[str] = set()
    for longest, alphabet in combos:
        level = {""}
        while level and len(next(iter(level))) < longest:
            level = {s + c for s in level for c in alphabet}
            found |= level
    return sorted(s for s in found if not s.isspace())


def border(pattern: str) -> int:
    """Length of the longest proper prefix that is also a suffix."""
    return next((k for k in range(len(pattern) - 1, 0, -1) if pattern.endswith(pattern[:k])), 0)


def max_overlaps(length: int, pattern: str) -> int:
    """How often `pattern` can occur, overlaps included, in a string of `length` characters."""
    step = len(pattern) - border(pattern)
    return 1 + (length - len(pattern)) // step


def count_overlapping(text: Column, pattern: str) -> Column:
    """Occurrences of `pattern` in `text`, overlapping ones included.

    A pattern that cannot overlap itself is counted by the length its removal takes
    away, which needs no regular expression; the rest use a lookahead.
    """
    if border(pattern) == 0:
        removed = F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))
        return removed if len(pattern) == 1 else (removed / F.lit(len(pattern))).cast("int")
    return F.regexp_count(text, F.lit("(?=" + re.escape(pattern) + ")"))


def last_position(text: Column, char: str) -> Column:
    """1-based position of the last `char` in `text`, 0 where it does not occur."""
    return F.length(text) - F.length(F.substring_index(text, char, -1))


def pick_runs(text: Column, runs: Sequence[tuple[int, int]]) -> Column:
    """Concatenate the (start, length) stretches of `text`; starts count from 0."""
    pieces = [F.substring(text, start + 1, length) for start, length in runs]
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def runs_of(positions: Sequence[int]) -> list[tuple[int, int]]:
    """Merge neighbouring positions into (start, length) stretches, keeping their order."""
    runs: list[list[int]] = []
    for pos in positions:
        if runs and pos == runs[-1][0] + runs[-1][1]:
            runs[-1][1] += 1
        else:
            runs.append([pos, 1])
    return [(start, length) for start, length in runs]


def null_if_nan(value: Column) -> Column:
    """NaN becomes NULL, so comparisons and means ignore it."""
    return F.when(~F.isnan(value), value)
