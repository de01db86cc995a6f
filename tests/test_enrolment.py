from pyspark.sql import functions as F

from rollbook.operators import enrolment


def test_dropout_label(spark):
    rows = [(1, 2020), (1, 2020), (1, 2021), (2, 2020), (2, 2022), (3, 2022)]
    got = enrolment.dropout_label(spark.createDataFrame(rows, "id int, year int"), "id", "year")
    assert sorted(map(tuple, got.collect())) == [(1, 2020, 0), (1, 2021, 1), (2, 2020, 1)]


def test_label_with_a_given_last_year(spark):
    rows = [(1, 2020), (1, 2021), (2, 2021)]
    got = enrolment.dropout_label(spark.createDataFrame(rows, "id int, year int"), "id", "year", last_year=2022)
    assert sorted(map(tuple, got.collect())) == [(1, 2020, 0), (1, 2021, 1), (2, 2021, 1)]


def test_unify_keeps_every_enrolled_id(spark):
    enrol = spark.createDataFrame([(1, "x"), (2, "y")], "id int, place string")
    days = spark.createDataFrame([(1, "pp"), (3, "aa")], "id int, days string")
    exams = spark.createDataFrame([(2, "maths", 5.0), (2, "maths", 7.0), (2, "art", 1.0)], "id int, s string, v double")
    wide = enrolment.exams_wide(exams, "id", "s", "v", ["maths", "evs"])
    got = {r.id: r for r in enrolment.unify(enrol, days, wide, "id").collect()}
    assert set(got) == {1, 2}
    assert (got[1].days, got[1].maths_score) == ("pp", None)
    assert (got[2].days, got[2].maths_score, got[2].evs_score) == (None, 7.0, None)


def test_label_needs_one_shuffle(spark):
    from conftest import plan_of

    df = spark.range(100).select(F.col("id") % 7, F.lit(2020).alias("year")).toDF("id", "year")
    assert plan_of(enrolment.dropout_label(df, "id", "year", 2022)).count("Exchange hashpartitioning") == 1
