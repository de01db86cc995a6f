import math
import random
from dataclasses import replace

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rollbook.operators import attribution, calibration, encoding, model
from rollbook.operators import sequence as S
from rollbook.plans.explaining import explain
from rollbook.plans.inference import infer
from rollbook.plans.training import DataSettings, FitSettings, train_and_evaluate
from rollbook.sources import contract as contracts

DAYS = [(6, d) for d in range(1, 31)] + [(12, d) for d in range(1, 32)]
CONTRACT = {
    "studentid": ["string", "id"],
    "target": ["int", "label"],
    "districtid": ["string", "district", "geo"],
    **{f"{m}_{d}": ["string", "day", "all_attendances"] for m, d in DAYS},
    "maths_score": ["float", "score", "exam_score_subwise"],
    "maths_attnd": ["string", "seat", "exam_attnd_subwise"],
    "jun_agg_attnd": ["float", "share", "month_agg_attnd"],
}
STATUSES = contracts.status_map({"missing": ["nan", "5", "0"], "present": ["1"], "absent": ["2"]})
DATA = DataSettings(CONTRACT, STATUSES, "2223", "ord", drop=["month_agg_attnd"])


def students(spark, n, seed):
    rng = random.Random(seed)
    schema = contracts.contract_schema(CONTRACT).add("ord", "long").add("acad_year", "string").add("grade", "string")
    rows = []
    for i in range(n):
        p = rng.random()
        row = {
            "studentid": f"s{i % (n - 5)}", "target": int(p + rng.gauss(0, 0.15) > 0.6), "districtid": rng.choice("ABC"),
            "maths_score": rng.choice([None, 0.0, 35.0, 80.0]), "maths_attnd": None,
            "jun_agg_attnd": rng.choice([None, 0.5, 0.9]), "ord": i, "acad_year": "2223", "grade": "3",
            **{f"{m}_{d}": rng.choices(["1", "2", "5", None], [1 - p, p, 0.05, 0.05])[0] for m, d in DAYS},
        }
        rows.append(tuple(row[f.name] for f in schema))
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run"))
    holidays = spark.createDataFrame([("2223", 6, 5), ("2223", 6, 12)], "acad_year string, month int, day int")
    fit = FitSettings(
        params={"maxIter": 3, "balanced": True},
        tune={"independent": {"maxDepth": {"dtype": "int", "tuning_space": {"low": 2, "high": 3}}}},
        n_trials=2,
    )
    return train_and_evaluate(students(spark, 305, 1), holidays, DATA, fit, path), path, holidays


def test_training_leaves_everything_behind(spark, run):
    result, path, _ = run
    assert result.frames["train"].count() == 210 and result.frames["val"].count() == 90
    best = {r.key: r.value for r in result.summary.collect()}
    # Fixed parameters are kept next to the tuned ones.
    assert '"balanced": true' in best["best_params"] and '"maxDepth"' in best["best_params"]
    assert result.fit.trials.count() == 2 and result.fit.losses.count() >= 1
    assert not [f for f in result.model.features if "agg_attnd" in f or "12_1" in f]
    assert spark.read.parquet(f"{path}/frames").groupBy("split").count().count() == 2
    assert spark.read.csv(f"{path}/scores_before", header=True).count() == 90
    metrics = {r.metric: r.value for r in spark.read.json(f"{path}/metrics/val").collect()}
    assert 0.6 < metrics["auc"] <= 1 and metrics["prevalence"] > 0


def test_scored_frames_are_consistent(run):
    result, _, _ = run
    rows = result.frames["val"].select("preds_proba_0", "preds_proba_1", "preds").collect()
    assert all(abs(r.preds_proba_0 + r.preds_proba_1 - 1) < 1e-12 for r in rows)
    assert all(r.preds == int(r.preds_proba_1 >= result.model.threshold) for r in rows)


def test_calibration_is_monotone(run):
    result, _, _ = run
    before = {r.studentid: r.preds_proba_1 for r in result.fit.val_scores_before.collect()}
    after = {r.studentid: r.preds_proba_1 for r in result.fit.val_scores_after.collect()}
    ordered = [after[k] for k in sorted(before, key=before.get)]
    assert all(a <= b for a, b in zip(ordered, ordered[1:]))


def test_a_saved_model_scores_the_same(spark, run):
    result, path, _ = run
    loaded = model.EwsModel.load(f"{path}/model")
    plain = result.frames["val"].drop("preds_proba_0", "preds_proba_1", "preds")
    a = {r.studentid: r.preds_proba_1 for r in loaded.transform(plain).collect()}
    b = {r.studentid: r.preds_proba_1 for r in result.frames["val"].collect()}
    assert a == b and loaded.features == result.model.features


def test_inference_with_and_without_label(spark, run):
    _, path, holidays = run
    new = students(spark, 60, 2)
    labelled = infer(new, holidays, DATA, f"{path}/model", "new", f"{path}/new")
    assert "summary" in labelled.evaluations["new"]
    bare = infer(new.drop("target"), holidays, DATA, f"{path}/model", "new")
    assert set(bare.evaluations["new"]) == {"histogram", "flag_rate"}
    assert bare.frames["new"].count() == 55
    # Categories the model has not seen are scored too.
    other = new.withColumn("districtid", F.lit("Z"))
    assert infer(other, holidays, DATA, f"{path}/model", "z").frames["z"].filter("preds_proba_1 is null").count() == 0


def test_attributions_add_up_to_the_margin(spark, run):
    result, path, _ = run
    _, base = attribution.model_trees(result.model, f"{path}/model")
    val = result.frames["val"]
    shap = attribution.shap_values(result.model, val, f"{path}/model")
    total = sum((F.col("shap").getField(f) for f in result.model.features), F.lit(base))
    margins = result.model.classifier.transform(val).select("studentid", (2 * vector_to_array("__margin")[1]).alias("m"))
    worst = shap.select("studentid", total.alias("t")).join(margins, "studentid").agg(F.max(F.abs(F.col("t") - F.col("m"))))
    assert worst.first()[0] < 1e-9


def test_explanation(run):
    result, path, _ = run
    groups = {"geo": ["districtid"], "attendance": [f for f in result.model.features if "full_" in f], "exam": ["maths_score", "maths_attnd"]}
    val = result.frames["val"]
    got = explain(val, f"{path}/model", groups, target_recall=0.8, validation=val, wide=True, path=f"{path}/explained")
    assert {"shap[districtid]", "predictor_group_3_top_driver", "preds"} <= set(got.columns)
    assert {r.preds for r in got.select("preds").distinct().collect()} <= {"dropout", "notdropout"}
    with pytest.raises(ValueError, match="threshold"):
        explain(val, f"{path}/model", groups)


def test_shared_valid_days_and_sampling_by_order(spark, tmp_path):
    data = replace(DATA, share_valid_days=True)
    fit = FitSettings(prevalence=0.3, params={"maxIter": 2, "maxDepth": 2})
    df = students(spark, 205, 4)
    result = train_and_evaluate(df, None, data, fit, str(tmp_path))
    assert result.model.valid_days == [S.calendar_position(*d) for d in DAYS]
    new = infer(students(spark, 40, 5), None, data, f"{tmp_path}/model", "new")
    assert new.model.valid_days == result.model.valid_days
    # The kept positives are the first ones by arrival, not by id.
    rows = {}
    for r in sorted(df.select("ord", "studentid", "target").collect()):
        rows.setdefault(r.studentid, (r.ord, r.target))
    negatives = sum(1 for _, t in rows.values() if t == 0)
    wanted = math.ceil(negatives * 0.3 / 0.7)
    first = sorted((o, i) for i, (o, t) in rows.items() if t == 1)[:wanted]
    kept = {r.studentid for f in result.frames.values() for r in f.filter("target = 1").collect()}
    assert kept == {i for _, i in first}


def test_isotonic_on_bins(spark):
    df = spark.createDataFrame([(0.1, 0.3), (0.2, 0.1), (0.6, 0.7)], "mean_score double, positive_rate double")
    fitted = calibration.fit_bins(df)
    scores = spark.createDataFrame([(0.0,), (0.15,), (0.4,), (0.9,)], "s double")
    got = [round(r.c, 12) for r in calibration.calibrate(fitted, scores, "s", "c").collect()]
    assert got == [0.2, 0.2, 0.45, 0.7]


def test_drawn_parameters():
    space = {
        "independent": {
            "grow": {"dtype": "categorical", "tuning_space": {"choices": ["x", "None"]}},
            "n": {"dtype": "int", "tuning_space": {"low": 2, "high": 10, "step": 4}},
            "rate": {"dtype": "float", "tuning_space": {"low": 0.01, "high": 1.0, "log": True}},
        },
        "dependent": {
            "extra": {"dependent_on_param": "grow", "dependent_on_value": ["x"], "dtype": "float", "tuning_space": {"low": 0.0, "high": 1.0}}
        },
    }
    rng = random.Random(0)
    drawn = [model.draw_params(rng, {"fixed": 1}, space) for _ in range(200)]
    assert {d["n"] for d in drawn} == {2, 6, 10}
    assert all(0.01 <= d["rate"] <= 1.0 and d["fixed"] == 1 for d in drawn)
    assert all(("extra" in d) == (d.get("grow") == "x") for d in drawn) and any("grow" not in d for d in drawn)
    with pytest.raises(ValueError):
        model.draw_params(rng, {}, {"independent": {"a": {"dtype": "text", "tuning_space": {"low": 0, "high": 1}}}})


@pytest.mark.parametrize("limit", [200_000, 0])
def test_category_means(spark, monkeypatch, limit):
    monkeypatch.setattr(encoding, "BROADCAST_CATEGORIES", limit)
    rows = [("hot", i % 2) for i in range(300)] + [(f"c{i}", int(i < 100)) for i in range(600)]
    df = spark.createDataFrame(rows, "`a b` string, y int").repartition(5)
    fitted = encoding.fit_category_means(df, ["a b"], "y", smoothing=1.0)
    overall = 250 / 900
    got = {r["a b"]: r["__mean_a b"] for r in fitted.transform(spark.createDataFrame([("hot",), ("c1",), ("new",)], "`a b` string")).collect()}
    assert fitted.sizes == {"a b": 601}
    assert got == {"hot": pytest.approx((150 + overall) / 301), "c1": pytest.approx((1 + overall) / 2), "new": pytest.approx(overall)}


def test_loss_is_the_documented_one(spark, run):
    result, _, _ = run
    last = result.fit.losses.orderBy(F.col("iteration").desc()).first()
    scored = model.with_weights(
        result.model.classifier.transform(result.frames["train"]), "target", model.class_weights(result.frames["train"], "target")
    )
    margin = vector_to_array("__margin")[1]
    each = 2 * F.log1p(F.exp(-2 * (2 * F.col("target") - 1) * margin))
    mean = scored.agg(F.sum(each * F.col("__weight")) / F.sum("__weight")).first()[0]
    assert abs(mean - last.trn) < 1e-9


def test_missing_numbers_are_lowest_in_fit_and_score(spark):
    rows = [(i, None if i % 3 == 0 else float("nan") if i % 3 == 1 else float(i), None, int(i % 3 != 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x double, empty double, y int")
    fitted = model.fit_classifier(df, df, "y", [], ["x", "empty"], {"maxIter": 2, "maxDepth": 1, "balanced": "SqrtBalanced"})
    low = {r.y: r[1] for r in fitted.transform(df).groupBy("y").agg({"preds_proba_1": "min"}).collect()}
    assert low[1] > 0.5 > low[0]
    assert model.class_weights(df, "y", "SqrtBalanced") == {0: pytest.approx(2**0.5), 1: 1.0}
    with pytest.raises(ValueError, match="class weights"):
        model.class_weights(df, "y", "Sqrt")
