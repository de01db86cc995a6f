import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollbook.functions import text


def brute_count(s, pattern):
    return sum(s[i : i + len(pattern)] == pattern for i in range(len(s) - len(pattern) + 1))


def test_pattern_strings_are_sorted_and_distinct():
    assert text.pattern_strings([(1, ["a", "m", "p"])]) == ["a", "m", "p"]
    assert text.pattern_strings([(2, ["p", "a"]), (1, ["a"])]) == ["a", "aa", "ap", "p", "pa", "pp"]


@given(st.text("amp", min_size=1, max_size=6), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_max_overlaps_is_reached_by_the_best_string(pattern, extra):
    length = len(pattern) + extra
    step = len(pattern) - text.border(pattern)
    best = pattern
    while len(best) < length:
        best += pattern[-step:]
    assert brute_count(best[:length], pattern) == text.max_overlaps(length, pattern)


def test_counts_overlaps_like_brute_force(spark):
    strings = ["", "a", "aaaa", "ppamapmmpa", "papap", "pppppp", "amamamam"]
    patterns = ["".join(p) for n in (1, 2, 3) for p in itertools.product("amp", repeat=n)]
    rows = spark.createDataFrame([(s,) for s in strings], "s string").select(
        "s", *[text.count_overlapping(F.col("s"), p).alias(p) for p in patterns]
    )
    for row in rows.collect():
        for p in patterns:
            assert row[p] == brute_count(row.s, p), (row.s, p)


def test_special_characters_are_literal(spark):
    row = spark.createDataFrame([("a..a.",)], "s string").select(
        text.count_overlapping(F.col("s"), "..").alias("dots"), text.count_overlapping(F.col("s"), ".").alias("dot")
    ).first()
    assert (row.dots, row.dot) == (1, 3)


@pytest.mark.parametrize("s", ["ppamapmmpa", "aaa", "", "p"])
def test_last_position(spark, s):
    row = spark.createDataFrame([(s,)], "s string").select(
        *[text.last_position(F.col("s"), c).alias(c) for c in "amp"]
    ).first()
    assert [row[c] for c in "amp"] == [s.rfind(c) + 1 for c in "amp"]


def test_runs_keep_order():
    assert text.runs_of([3, 4, 5, 9, 1, 2]) == [(3, 3), (9, 1), (1, 2)]
    assert text.runs_of([]) == []
