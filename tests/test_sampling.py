import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from rollbook.operators import sampling


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(1000).select(
        F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"), (1000 - F.col("id")).alias("ord")
    )


def counts(df):
    return {r.y: r.n for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize(
    "p, expected", [(0.05, {0: 900, 1: 48}), (0.5, {0: 100, 1: 100}), ("actual", {0: 900, 1: 100}), (0.1, {0: 900, 1: 100})]
)
def test_sizes(spark, people, p, expected):
    assert counts(sampling.prevalence_sample(people, "y", p, "ord")) == expected


def test_the_first_rows_are_kept(spark, people):
    got = sampling.prevalence_sample(people, "y", 0.05, "ord").filter("y = 1")
    assert sorted(r.ord for r in got.collect()) == sorted(1000 - i for i in range(0, 1000, 10))[:48]


def test_a_seed_changes_the_rows_but_not_their_number(spark, people):
    a, b = (sampling.prevalence_sample(people, "y", 0.05, "id", seed=s) for s in (1, 2))
    ids = [{r.id for r in x.collect()} for x in (a, b)]
    assert ids[0] != ids[1] and len(ids[0]) == len(ids[1]) == 948


def test_rows_are_filtered_in_place(spark, people):
    assert "Exchange" not in plan_of(sampling.prevalence_sample(people, "y", 0.05, "ord"))


def test_split_is_exact_and_complete(spark, people):
    train, val = sampling.stratified_split(people, "y", "id", 0.7, 42)
    assert counts(train) == {0: 630, 1: 70} and counts(val) == {0: 270, 1: 30}
    assert {r.id for r in train.collect()}.isdisjoint({r.id for r in val.collect()})
    again, _ = sampling.stratified_split(people.repartition(3), "y", "id", 0.7, 42)
    assert {r.id for r in again.collect()} == {r.id for r in train.collect()}
    other, _ = sampling.stratified_split(people, "y", "id", 0.7, 43)
    assert {r.id for r in other.collect()} != {r.id for r in train.collect()}


def test_split_sizes_by_largest_remainder():
    assert sampling.split_sizes({0: 7, 1: 4}, 0.5) == {0: 3, 1: 2}
    assert sum(sampling.split_sizes({0: 13, 1: 6}, 0.7).values()) == 13
    with pytest.raises(ValueError):
        sampling.split_sizes({0: 1, 1: 0}, 0.5)


def test_other_labels_are_an_error(spark):
    with pytest.raises(ValueError, match="0 or 1"):
        sampling.class_counts(spark.createDataFrame([(2,)], "y int"), "y")


def test_one_class_only(spark):
    df = spark.range(10).select("id", F.lit(0).alias("y"))
    assert sampling.prevalence_sample(df, "y", "actual", "id").count() == 10
