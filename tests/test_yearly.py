import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from rollbook.operators import sequence as S
from rollbook.operators import yearly as Y
from rollbook.sources import calendar

LONG = "id string, year int, month int, day int, status string"


def string(**marks):
    """`days` with the given marks, named like d6_1."""
    text = ["m"] * 372
    for name, status in marks.items():
        text[S.calendar_position(*map(int, name[1:].split("_")))] = status
    return "".join(text)


def test_each_year_has_its_own_valid_days(spark):
    long = spark.createDataFrame([("a", 2022, 6, 1, "p"), ("a", 2023, 7, 1, "a"), ("b", 2023, 6, 1, "p")], LONG)
    config = S.SequenceConfig(partitions=[1], month_groups={"full": list(range(1, 13)), "july": [7]}, binary_months=[7])
    got = {(r.id, r.year): r for r in Y.features_from_long(long, ["id", "year"], "year", None, config).collect()}
    assert got["a", 2022].full_partns_1_partn_1_frac_p == 1.0 and got["a", 2022].full_partns_1_partn_1_frac_m == 0.0
    assert got["a", 2023].full_partns_1_partn_1_frac_a == 0.5 and got["b", 2023].full_partns_1_partn_1_frac_p == 0.5
    # No valid day in July 2022: no value, rather than one made up.
    assert got["a", 2022].july_last_a is None and got["a", 2022].binary_absence_10 is None
    assert got["a", 2023].binary_absence_10 == 1.0 and got["a", 2023].july_last_a == 1 / (1 + 1e-10)


def test_holidays_of_each_year(spark):
    days = spark.createDataFrame(
        [("a", 2022, string(d6_1="p", d6_2="a")), ("b", 2023, string(d6_1="p", d6_2="a"))], "id string, year int, days string"
    )
    off = spark.createDataFrame([("2223", 6, 1), ("2324", 6, 2), ("2425", 6, 1)], "acad_year string, month int, day int")
    valid = {(r.year, r.pos) for r in Y.valid_days(days, "year", off).collect()}
    assert valid == {(2022, 1), (2023, 0)}
    named = days.withColumn("year", F.when(F.col("year") == 2022, "2223").otherwise("2324"))
    assert {(r.year, r.pos) for r in Y.valid_days(named, "year", off).collect()} == {("2223", 1), ("2324", 0)}
    assert [r.pos for r in Y.valid_days(days, "year", off, dates=[0]).collect()] == [0]


def test_one_year_equals_the_single_year_functions(spark):
    text = "ppamapmmpaamp" * 20
    long = spark.createDataFrame(
        [(str(k), 2022, *calendar.month_day(i), c) for k in range(3) for i, c in enumerate(text[k:]) if c != "m"], LONG
    )
    config = S.SequenceConfig(char_combinations=[(2, ["a", "m", "p"])], partitions=[1, 3], month_groups={"full": list(range(1, 13)), "g": [6, 8]})
    one = S.features_from_long(long.drop("year"), "id", config=config)
    many = Y.features_from_long(long, ["id", "year"], "year", None, config).drop("year")
    assert sorted(one.columns) == sorted(many.columns)
    assert sorted(map(tuple, one.select(*sorted(one.columns)).collect())) == sorted(map(tuple, many.select(*sorted(one.columns)).collect()))


def test_runs_and_lengths(spark):
    valid = spark.createDataFrame([(1, p, *calendar.month_day(p)) for p in (0, 1, 2, 31, 33, 371)], "year int, pos int, month int, day int")
    row = Y.day_masks(valid, "year", {"all": range(1, 13), "june": [6], "none": [9]}).first()
    assert [tuple(r) for r in row.runs_all] == [(0, 3), (31, 1), (33, 1), (371, 1)] and row.len_all == 6
    assert [tuple(r) for r in row.runs_june] == [(0, 3)] and row.len_none == 0


def test_errors(spark):
    empty = spark.createDataFrame([("a", 2022, "m" * 372)], "id string, year int, days string")
    with pytest.raises(ValueError, match="no valid"):
        Y.attendance_features(empty, Y.valid_days(empty, "year"), "year")
    short = spark.createDataFrame([("a", 2022, string(d6_1="p"))], "id string, year int, days string")
    with pytest.raises(Exception, match="cannot be cut"):
        Y.attendance_features(short, Y.valid_days(short, "year"), "year").collect()
    many = spark.range(1001).select(F.col("id").cast("string").alias("id"), F.col("id").cast("int").alias("year"), F.lit(string(d6_1="p")).alias("days"))
    with pytest.raises(ValueError, match="no academic year"):
        Y.attendance_features(many, Y.valid_days(many, "year"), "year", S.SequenceConfig(partitions=[1]))


def test_engineer_by_year(spark):
    df = spark.createDataFrame(
        [("1", "2223", 1, "p", "a"), ("2", "2324", 0, None, "p"), ("3", None, 0, "p", "p")], "studentid string, acad_year string, target int, `6_1` string, `12_1` string"
    )
    got, cats, nums = Y.engineer(df, None, "acad_year", S.SequenceConfig(partitions=[1]))
    rows = {r.studentid: r for r in got.collect()}
    assert cats == [] and "acad_year" not in got.columns and "binary_absence_10" in nums
    assert rows["1"].full_partns_1_partn_1_frac_p == 0.5 and rows["2"].full_partns_1_partn_1_frac_p == 1.0
    assert rows["3"].full_partns_1_partn_1_frac_p == 1.0  # rows without a year are a year of their own


def test_plans(spark):
    days = spark.createDataFrame([("a", 2022, string(d6_1="p"))], "id string, year int, days string")
    valid = Y.valid_days(days, "year")
    features = plan_of(Y.attendance_features(days, valid, "year", S.SequenceConfig(partitions=[1])))
    assert "SortMergeJoin" not in features and "Python" not in features and "hashpartitioning" not in features
    shares = plan_of(Y.missing_shares(days, "year"))
    assert shares.index("Generate") < shares.index("Aggregate")  # rows by place come after the sums
