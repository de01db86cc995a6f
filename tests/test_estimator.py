import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from rollbook.operators import cleaning
from rollbook.operators.estimator import EarlyWarningClassifier

PARAMS = {"maxIter": 2, "maxDepth": 2, "seed": 1}


@pytest.fixture(scope="module")
def people(spark):
    df = spark.range(600).select(
        F.col("id"),
        ((F.col("id") * 7 % 10) < F.col("id") % 5).cast("int").alias("y"),
        (F.col("id") % 5).cast("double").alias("x"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("c"),
        F.when(F.col("id") % 4 == 0, True).alias("held"),
    )
    return df


def test_stage_is_saved_loaded_and_applied_to_a_stream(spark, people, tmp_path):
    stage = EarlyWarningClassifier(
        categorical=["c"], numerical=["x"], labelCol="y", idCol="id", validationIndicatorCol="held", treeParams=PARAMS, bins=5
    )
    stage.write().save(f"{tmp_path}/stage")
    assert EarlyWarningClassifier.load(f"{tmp_path}/stage").extractParamMap().values().__len__() == len(stage.extractParamMap())
    fitted = Pipeline(stages=[stage]).fit(people)
    fitted.write().save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    assert loaded.stages[0].uid == fitted.stages[0].uid and loaded.stages[0].getOrDefault("labelCol") == "y"
    expected = sorted(map(str, fitted.transform(people).collect()))
    assert sorted(map(str, loaded.transform(people).collect())) == expected

    people.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(people.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (
        loaded.transform(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress")
        .trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == expected


def test_missing_features_are_told(spark, people):
    stage = EarlyWarningClassifier(numerical=["x"], labelCol="y", idCol="id", validationIndicatorCol="held", treeParams=PARAMS)
    with pytest.raises(ValueError, match="lacks features"):
        stage.fit(people).transform(people.drop("x"))


def test_watched_cleaning_counts_what_the_report_counts(spark, tmp_path):
    rows = [("a", 1, "P?", 1.0, 1), ("a", 0, None, None, 2), ("b", 0, "p", float("nan"), 3), ("c", None, "x", 2.0, 4), ("d", 1, "p", 1.0, 5)]
    df = spark.createDataFrame(rows, "studentid string, target int, `6_1` string, price double, arrival int")
    rules = {"studentid": ["string", "id"], "target": ["int", "label"], "6_1": ["string", "day", "all_attendances"], "price": ["float", "price", "money"]}
    watch = cleaning.QualityWatch()
    with pytest.raises(ValueError):
        watch.report()
    clean, _, _ = cleaning.preprocess(df, rules, {"x": "a"}, "arrival", {"notin": {"studentid": ["d"]}}, watch=watch)
    clean.write.parquet(f"{tmp_path}/clean")
    wanted = cleaning.quality_report(df, rules, statuses={"x": "a"})
    assert sorted(map(tuple, watch.report().collect())) == sorted(map(tuple, wanted.collect()))
    assert spark.read.parquet(f"{tmp_path}/clean").count() == 3
