import math

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from rollbook.operators import cleaning
from rollbook.sources.contract import status_map

MAP = status_map({"missing": ["nan", "5", "0"], "present": ["1"], "absent": ["2"]})


def test_statuses(spark):
    raw = ["1", "2", "0", "5", "nan", None, "x"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, `6_1` string")
    got = cleaning.fill_status(cleaning.recode_status(df, ["6_1"], MAP), ["6_1"]).orderBy("i")
    assert [r["6_1"] for r in got.collect()] == ["p", "a", "m", "m", "m", "m", "x"]


def test_exam_attendance_and_scores(spark):
    df = spark.createDataFrame(
        [(1, None), (2, 0.0), (3, 35.0), (4, float("nan")), (5, -1.0)], "i int, `social science_score` double"
    ).withColumn("social science_attnd", F.lit("?"))
    got = cleaning.rectify_exam_attendance(df, ["social science_attnd", "absent_attnd"])
    got = cleaning.fill_exam_scores(got, ["social science_score"]).orderBy("i").collect()
    assert [r["social science_attnd"] for r in got] == ["m", "a", "p", "m", "a"]
    assert [r["social science_score"] for r in got] == [0.0, 0.0, 35.0, 0.0, -1.0]


def test_means_ignore_null_and_nan(spark):
    df = spark.createDataFrame([(2.0,), (None,), (4.0,), (float("nan"),)], "x double")
    assert cleaning.float_means(df, ["x"]) == {"x": 3.0}
    assert sorted(r.x for r in cleaning.fill_float_means(df, ["x"]).collect()) == [2.0, 3.0, 3.0, 4.0]
    assert [r.x for r in cleaning.fill_float_means(df, ["x"], {"x": 9.0}).collect()].count(9.0) == 2
    empty = spark.createDataFrame([(None,)], "x double")
    assert cleaning.fill_float_means(empty, ["x"]).first().x is None


@pytest.mark.parametrize("limit", [500_000, 0])
def test_first_row_per_id(spark, monkeypatch, limit):
    monkeypatch.setattr(cleaning, "BROADCAST_IDS", limit)
    rows = [("a", 3, "late"), ("a", 1, "first"), ("b", 2, "only"), (None, 5, "later"), (None, 4, "none")]
    # One id holds a third of the rows.
    rows += [("hot", 100 + i, f"h{i}") for i in range(300)] + [(f"u{i}", 1000 + i, "u") for i in range(600)]
    df = spark.createDataFrame(rows, "id string, ord int, v string").repartition(7)
    got = {r.id: r.v for r in cleaning.dedup_first(df, "id", "ord").collect()}
    assert (got["a"], got["b"], got[None], got["hot"], len(got)) == ("first", "only", "none", "h0", 604)


def test_rows_stay_in_place_when_few_ids_have_copies(spark):
    df = spark.range(1000).select((F.col("id") % 990).alias("id"), F.col("id").alias("ord"))
    assert "hashpartitioning" not in plan_of(cleaning.dedup_first(df, "id", "ord"))


def test_filters(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None)], "a string, b string")
    got = cleaning.apply_filters(df, {"in": {"a": ["1", "2"], "zz": ["q"]}, "notin": {"b": ["y"]}})
    assert [tuple(r) for r in got.collect()] == [("1", "x")]
    assert cleaning.apply_filters(df, {"notin": {"b": ["y"]}}).count() == 2
    assert cleaning.apply_filters(df, None) is df


def test_names_and_columns(spark):
    df = spark.createDataFrame([(1, 2)], "A int, b int")
    assert cleaning.lower_names(df).columns == ["a", "b"]
    with pytest.raises(ValueError, match="differ only in case"):
        cleaning.lower_names(df.toDF("A", "a"))
    kept = cleaning.drop_columns(df.toDF("a", "geo"), ["geo", "gone"], {"geo": ["a"]})
    assert kept.columns == ["geo"]


def test_types_and_features(spark):
    df = spark.createDataFrame([("7", "1.5", 3, "nan")], "target string, x string, name int, y string")
    rules = {"target": ["int", ""], "y": ["float", ""], "x": ["float", ""], "name": ["string", ""]}
    cast = cleaning.cast_to_contract(df, rules)
    assert cast.dtypes == [("name", "string"), ("y", "double"), ("x", "double"), ("target", "bigint")]
    assert tuple(cast.first()) == ("3", None, 1.5, 7)
    assert cleaning.split_features(cast, "id", "target") == (["name"], ["y", "x"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cleaning.cast_to_contract(spark.createDataFrame([("q",)], "x string"), rules).collect()


CONTRACT = {
    "studentid": ["string", "id"],
    "target": ["int", "label"],
    "district": ["string", "place", "geo"],
    "6_1": ["string", "day", "all_attendances"],
    "jun_agg_attnd": ["float", "share", "month_agg_attnd"],
}


def test_quality_report(spark):
    df = spark.createDataFrame(
        [("s1", "1", None, "1", "0.5"), ("s1", "2", "d", "9", "oops"), ("s2", "x", "d", None, None)],
        "studentid string, target string, district string, `6_1` string, jun_agg_attnd string",
    )
    got = {(r["column"], r["check"]): r.n for r in cleaning.quality_report(df, CONTRACT, statuses=MAP).collect()}
    assert got["studentid", "duplicate_ids"] == 1
    assert got["district", "null"] == 1 and got["6_1", "null"] == 1
    assert got["6_1", "unknown_status"] == 1
    assert got["target", "bad_cast"] == 1 and got["target", "bad_label"] == 2
    assert got["jun_agg_attnd", "bad_cast"] == 1


def test_preprocess_in_order(spark):
    df = spark.createDataFrame(
        [
            (3, "s1", 1, "late", "1", 0.9),
            (1, "s1", 1, "north", "2", None),
            (2, "s2", 0, None, None, 0.4),
            (4, "s3", 0, "south", "1", 0.8),
        ],
        "Ord int, StudentID string, target int, district string, `6_1` string, jun_agg_attnd double",
    )
    clean, groups, means = cleaning.preprocess(df, CONTRACT, MAP, "ord", {"notin": {"district": ["south"]}})
    got = {r.studentid: r for r in clean.collect()}
    # The mean is over the first rows per id, before the filter.
    assert math.isclose(means["jun_agg_attnd"], 0.6)
    assert set(got) == {"s1", "s2"}
    assert (got["s1"].district, got["s1"]["6_1"], got["s1"].jun_agg_attnd) == ("north", "a", means["jun_agg_attnd"])
    assert (got["s2"].district, got["s2"]["6_1"]) == ("nan", "m")
    assert groups["all_attendances"] == ["6_1"] and "ord" not in clean.columns
    with pytest.raises(ValueError, match="contract"):
        cleaning.preprocess(df, {"studentid": ["string", "id"]}, MAP, "ord")


def test_preprocess_of_an_empty_table(spark):
    df = spark.createDataFrame([], "ord int, studentid string, district string, `6_1` string, jun_agg_attnd double")
    clean, _, means = cleaning.preprocess(df, CONTRACT, MAP, "ord")
    assert clean.count() == 0 and means == {"jun_agg_attnd": None}


def test_null_and_tied_order_keys(spark):
    rows = [("a", None, "x"), ("a", None, "y"), ("a", 1, "z"), ("b", 2, "same"), ("b", 2, "same"), ("b", 3, "late"), ("c", 1, "p"), ("c", 1, "q"), ("d", None, "lone")]
    rows += [(None, 7, "n"), (None, 7, "n")] + [("hot", 5, f"h{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id string, ord int, v string")
    got = [tuple(r) for r in cleaning.dedup_first(df.repartition(5), "id", "ord").collect()]
    again = [tuple(r) for r in cleaning.dedup_first(df.repartition(3), "id", "ord").collect()]
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == 6
    by = {r[0]: r for r in got}
    assert by["a"][1] is None and by["a"][2] in "xy" and by["b"] == ("b", 2, "same") and by["d"] == ("d", None, "lone") and by[None] == (None, 7, "n")
