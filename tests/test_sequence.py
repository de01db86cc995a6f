import random

import pytest
from conftest import plan_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollbook.operators import sequence as S
from rollbook.sources import calendar


def long_rows(spark, text, id_="s", first=0):
    """One row per day from position `first` on; m days have no row."""
    days = [(id_, *calendar.month_day(first + i), c) for i, c in enumerate(text) if c != "m"]
    return spark.createDataFrame(days, "id string, month int, day int, status string")


def features(spark, text, **config):
    days = S.build_sequence(long_rows(spark, text), "id")
    config = {"month_groups": {"full": list(range(1, 13))}, "binary_months": list(range(1, 13)), **config}
    return S.attendance_features(days, list(range(len(text))), S.SequenceConfig(**config)).first()


def test_worked_example(spark):
    row = features(
        spark, "ppamapmmpa", char_combinations=[(2, ["a", "m", "p"])], absence_thresholds=[1, 2, 60]
    )
    expected = {
        1: dict(a=1 / 3, m=0 / 3, p=2 / 3, mm=0 / 2, pa=1 / 1, pp=1 / 2),
        2: dict(a=1 / 3, m=1 / 3, p=1 / 3, mm=0 / 2, pa=0 / 1, pp=0 / 2),
        3: dict(a=1 / 4, m=2 / 4, p=1 / 4, mm=1 / 3, pa=1 / 2, pp=0 / 3),
    }
    for part, values in expected.items():
        for pattern, value in values.items():
            assert row[f"full_partns_3_partn_{part}_frac_{pattern}"] == value, (part, pattern)
    assert row.full_last_a == 10 / (10 + 1e-10)
    assert row.full_last_m == 8 / (10 + 1e-10)
    assert row.full_last_p == 9 / (10 + 1e-10)
    assert (row.binary_absence_1, row.binary_absence_2, row.binary_absence_60) == (1.0, 0.0, 0.0)


def test_defaults_make_19_features(spark):
    days = S.build_sequence(long_rows(spark, "pam" * 100), "id")
    got = S.attendance_features(days, list(range(300)))
    assert len(got.columns) == 1 + 9 + 3 + 7


def test_shares_of_single_statuses_sum_to_one(spark):
    rng = random.Random(5)
    row = features(spark, "".join(rng.choice("amp") for _ in range(101)), partitions=[1, 3, 7])
    for n in (1, 3, 7):
        for i in range(1, n + 1):
            assert abs(sum(row[f"full_partns_{n}_partn_{i}_frac_{c}"] for c in "amp") - 1) < 1e-12


def test_doubled_days_missing_statuses_and_other_statuses(spark):
    rows = [
        ("a", 6, 1, "a"), ("a", 6, 1, "p"), ("a", 6, 2, "m"), ("a", 6, 2, "a"), ("a", 6, 3, None),
        ("a", 6, 4, "x"), ("a", 6, 4, "m"), ("a", 5, 31, "p"), ("b", 7, 1, "a"),
    ]
    df = spark.createDataFrame(rows, "id string, month int, day int, status string")
    got = {r.id: r.days for r in S.build_sequence(df, "id").collect()}
    assert got["a"] == "pamx" + "m" * 367 + "p"
    assert got["b"] == "m" * 31 + "a" + "m" * 340
    with pytest.raises(Exception, match="one Latin-1 character"):
        S.build_sequence(df.withColumn("status", F.lit("absent")), "id").collect()


def test_an_id_with_a_third_of_all_rows(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"),
        (F.col("id") % 12 + 1).cast("int").alias("month"),
        (F.floor(F.col("id") / 12) % 28 + 1).cast("int").alias("day"),
        F.lit("p").alias("status"),
    )
    got = S.build_sequence(df, "id")
    assert got.count() == 20_001
    assert got.filter("id = 0").first().days.count("p") == 4 * 28


def test_wide_and_long_agree(spark):
    df = spark.createDataFrame([("s1", "p", None, "a"), ("s2", None, None, "m")], "id string, `12_2` string, `6_1` string, `5_31` string")
    wide = {r.id: r.days for r in S.sequence_from_wide(df).collect()}
    long = {r.id: r.days for r in S.build_sequence(S.to_long(df, "id"), "id").collect()}
    assert wide == long
    assert wide["s1"][6 * 31 + 1] == "p" and wide["s1"][371] == "a" and len(wide["s1"]) == 372


def test_valid_days(spark):
    df = S.sequence_from_wide(
        spark.createDataFrame(
            [("1", "p", "m", "p", "p"), ("2", "a", "m", "m", "p")], "id string, `6_1` string, `6_2` string, `6_3` string, `6_4` string"
        )
    )
    off = spark.createDataFrame([("2223", 6, 4), ("2324", 6, 1)], "acad_year string, month int, day int")
    assert S.positions_of(S.valid_days(df)) == [0, 2, 3]
    assert S.positions_of(S.valid_days(df, off, "2223")) == [0, 2]
    assert S.positions_of(S.valid_days(df, off, "2223", max_missing=0.5)) == [0]


def test_month_groups_keep_calendar_order_and_skip_empty_ones(spark):
    text = ["m"] * 372
    for month, day, status in ((12, 1, "a"), (1, 1, "p"), (6, 1, "p"), (5, 1, "a")):
        text[S.calendar_position(month, day)] = status
    days = spark.createDataFrame([("".join(text),)], "days string")
    valid = [S.calendar_position(m, 1) for m in (6, 12, 1, 5)]
    got, lengths = S.group_sequences(days, valid, {"g": [5, 6, 1], "none": [2]})
    assert got.first().seq_g == "ppa" and lengths == {"g": 3}


def test_engineer_drops_days_and_groups(spark):
    df = spark.createDataFrame(
        [("1", 1, "x", "p", "a", 0.5), ("2", 0, "y", "a", "p", 0.7)],
        "studentid string, target int, district string, `6_1` string, `12_1` string, share double",
    )
    config = S.SequenceConfig(partitions=[2])
    got, cats, nums = S.engineer(df, None, "2223", config, ["geo"], {"geo": ["district"]})
    assert cats == [] and nums[0] == "share" and "6_1" not in got.columns and "days" not in got.columns
    assert "full_partns_2_partn_2_frac_p" in nums and "binary_absence_10" in nums
    with pytest.raises(ValueError, match="cannot be cut"):
        S.engineer(df, None, "2223", S.SequenceConfig(partitions=[3]))
    every = spark.createDataFrame([("2223", 6, 1), ("2223", 12, 1)], "acad_year string, month int, day int")
    with pytest.raises(ValueError, match="no valid"):
        S.engineer(df, every, "2223", config)
    late = S.engineer(df.drop("12_1"), None, "2223", S.SequenceConfig(partitions=[1]))[2]
    assert not [c for c in late if c.startswith("binary")]


@given(st.integers(1, 400), st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_partitions_cover_everything(length, parts):
    if parts > length:
        with pytest.raises(ValueError):
            S.partition_bounds(length, parts)
        return
    bounds = S.partition_bounds(length, parts)
    assert bounds[0][0] == 0 and sum(size for _, size in bounds) == length
    assert all(a + n == b for (a, n), (b, _) in zip(bounds, bounds[1:]))
    assert len({n for _, n in bounds[:-1]}) <= 1


def test_features_are_one_projection(spark):
    days = spark.createDataFrame([("p" * 372,)], "days string")
    plan = plan_of(S.attendance_features(days, list(range(372))))
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("columns", [["6_1", "13_1"], ["6_32", "7_1"], ["0_1"], ["6_0"], ["6_1", "06_1"]])
def test_day_columns_without_a_place_of_their_own_are_refused(spark, columns):
    df = spark.createDataFrame([("x", *["p"] * len(columns))], ["id", *columns])
    with pytest.raises(ValueError, match=columns[-1] if columns[-1] != "7_1" else "6_32"):
        S.sequence_from_wide(df)


def test_dates_that_do_not_exist(spark):
    for month, day in ((13, 1), (6, 32)):
        long = spark.createDataFrame([(1, month, day, "p")], "id int, month int, day int, status string")
        with pytest.raises(Exception, match="outside the year"):
            S.build_sequence(long, "id").collect()
    marked = S.sequence_from_wide(spark.createDataFrame([("x", "p", "m")], ["id", "6_31", "2_30"]))
    shares = {(r.month, r.day): r.missing_share for r in S.missing_shares(marked).collect()}
    assert shares[6, 31] == 0.0 and (2, 30) not in shares and len(shares) == 367
