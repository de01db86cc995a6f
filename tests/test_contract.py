import json

import pytest
from pyspark.sql import functions as F

from rollbook import vocabulary as v
from rollbook.sources import calendar, contract, frames

GOOD = {
    "studentid": ["string", "id"],
    "target": ["int", "label"],
    "6_1": ["string", "day", "all_attendances"],
    "maths_score": ["float", "score", "exam_score_subwise"],
    "maths_attnd": ["string", "seat", "exam_attnd_subwise"],
    "jun_agg_attnd": ["float", "share", "month_agg_attnd"],
    "district": ["string", "place", "geo"],
}


def test_a_good_contract_has_no_problems():
    assert contract.check_contract(GOOD) == []


@pytest.mark.parametrize(
    "change, words",
    [
        ({"target": ["float", "x"]}, "must be of type 'int'"),
        ({"6_1": ["float", "x", "all_attendances"]}, "'6_1': type must be 'string'"),
        ({"6_1": ["string", "x", "geo"]}, "'6_1': group must be 'all_attendances'"),
        ({"jun_agg_attnd": ["string", "x", "exam_attnd_subwise"]}, "'jun_agg_attnd': type must be 'float'"),
        ({"maths_attnd": ["string", "x"]}, "'maths_attnd': group must be"),
        ({"district": ["text", "x", "geo"]}, "type 'text' is not one of"),
        ({"district": ["string", "", "geo"]}, "description must be non-empty"),
        ({"district": ["string"]}, "an entry holds"),
        ({"district": ["string", "x", "geo", "more"]}, "an entry holds"),
    ],
)
def test_breaches_are_named(change, words):
    assert any(words in p for p in contract.check_contract({**GOOD, **change}))


def test_all_breaches_are_collected():
    bad = {k: e for k, e in GOOD.items() if k != "target"} | {"x_score": ["int", ""], "y_score": ["int", "y"]}
    assert len(contract.check_contract(bad)) == 4


def test_groups_follow_contract_order_and_survive_in_the_schema():
    groups = contract.column_groups(GOOD)
    assert groups == contract.column_groups(contract.contract_schema(GOOD))
    assert groups["geo"] == ["district"] and "studentid" not in sum(groups.values(), [])


def test_columns_are_checked_and_narrowed(spark):
    df = spark.createDataFrame([("a", "1", 1)], "studentid string, `6_1` string, target int")
    narrowed, groups = contract.check_columns(df, GOOD, {"studentid", "target"})
    assert list(narrowed) == ["studentid", "target", "6_1"]
    assert groups["all_attendances"] == ["6_1"] and groups["geo"] == []
    with pytest.raises(ValueError, match="without a contract entry"):
        contract.check_columns(df.withColumn("other", F.lit(1)), GOOD)
    with pytest.raises(ValueError, match="in no group"):
        contract.check_columns(df, GOOD, {"target"})


def test_status_map_needs_exactly_three_keys():
    assert contract.status_map({"missing": ["nan", "5", "0"], "present": ["1"], "absent": ["2"]}) == {
        "nan": "m", "5": "m", "0": "m", "1": "p", "2": "a",
    }
    with pytest.raises(ValueError):
        contract.status_map({"present": ["1"], "absent": ["2"]})


def test_positions_cover_the_year():
    assert [calendar.month_day(p) for p in (0, 30, 31, 371)] == [(6, 1), (6, 31), (7, 1), (5, 31)]
    real = calendar.real_positions()
    assert len(real) == 366 and calendar.month_day(real[-1]) == (5, 31)


def test_holidays_merge_categories(spark, tmp_path):
    document = {"2223": {"6": {"sundays": [5, 12], "vacation": [1, 5], "extra": []}, "13": {"odd": [1]}}, "2324": {"1": {"festive": [26]}}}
    (tmp_path / "calendar.json").write_text(json.dumps(document, indent=2))
    got = calendar.read_holidays(spark, str(tmp_path / "calendar.json"))
    assert sorted(map(tuple, got.collect())) == [("2223", 6, 1), ("2223", 6, 5), ("2223", 6, 12), ("2324", 1, 26)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_reading_takes_year_and_grade_from_the_path(spark, tmp_path, fmt):
    df = spark.createDataFrame([("s1", "1")], "studentid string, `6_1` string")
    path = f"{tmp_path}/ay2223_grade3.{fmt}"
    df.write.format(fmt).option("header", True).save(path)
    back = contract.read_unified(spark, path, fmt)
    assert back.select("studentid", "6_1", "acad_year", "grade").first() == ("s1", "1", "2223", "3")
    assert contract.one_year(back, "2223").columns == ["studentid", "6_1"]
    assert contract.one_year(back, "2324").count() == 0
    bad = f"{tmp_path}/nothing"
    df.write.parquet(bad)
    with pytest.raises(Exception, match="no academic year"):
        contract.read_unified(spark, bad).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0.5, 1)], "auc double, n int")
    frames.write_metrics(frames.metrics_long(df, "val"), f"{tmp_path}/m")
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/m").select("split", "metric", "value").collect())) == [
        ("val", "auc", 0.5), ("val", "n", 1.0),
    ]
    frames.write_frames({"train": df, "val": df}, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").groupBy("split").count().count() == 2
    frames.write_scores(df, f"{tmp_path}/s")
    assert spark.read.csv(f"{tmp_path}/s", header=True).columns == ["auc", "n"]


def test_fixed_names():
    assert v.MONTHS[0] == 6 and len(set(v.MONTHS)) == 12
