import math
import random

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from rollbook.functions.ordering import descending_totals, range_edges, with_range
from rollbook.operators import curves, thresholds


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.7, 1), (4, 0.6, 0)], "id int, s double, y int")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_worked_curves(spark, four):
    t = curves.score_table(four, "s", "y")
    pr = {r.threshold: (r.precision, r.recall) for r in curves.pr_curve(t).collect()}
    assert pr == {0.6: (0.5, 1.0), 0.7: (2 / 3, 1.0), 0.8: (0.5, 0.5), 0.9: (1.0, 0.5), None: (1.0, 0.0)}
    area = curves.areas(t).first()
    assert area.roc_auc == 0.75
    assert math.isclose(area.avg_precision, 0.8333333333333333) and math.isclose(area.pr_auc, 0.7916666666666666)
    best = thresholds.max_f1(t).first()
    assert best.threshold == 0.7 and math.isclose(best.f1, 0.8, abs_tol=1e-6)
    assert rows(curves.confusion(t, 0.7)) == [(1, 1, 0, 2)]


def random_scored(spark, n, seed, distinct):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        # A third of the rows share one score.
        s = 0.5 if i % 3 == 0 else rng.randint(0, distinct) / distinct
        data.append((i, s, int(rng.random() < 0.2 + 0.6 * s)))
    return data, spark.createDataFrame(data, "id int, s double, y int").repartition(5)


def brute_pr(data):
    positives = sum(y for *_, y in data)
    found = []
    for t in sorted({s for _, s, _ in data}):
        chosen = [y for _, s, y in data if s >= t]
        found.append((t, sum(chosen) / len(chosen), sum(chosen) / positives))
    return found + [(None, 1.0, 0.0)]


def brute_recall(data, ks):
    ordered = [y for _, _, y in sorted(data, key=lambda r: (-r[1], r[0]))]
    positives = sum(ordered)
    return [(int(len(data) * k), sum(ordered[: int(len(data) * k)]) / positives) for k in ks]


@pytest.mark.parametrize("n, distinct", [(700, 1000), (1500, 7), (40, 3)])
def test_against_brute_force(spark, n, distinct):
    data, df = random_scored(spark, n, n, distinct)
    t = curves.score_table(df, "s", "y")
    pr = brute_pr(data)
    assert sorted(rows(curves.pr_curve(t)), key=lambda r: (r[0] is None, r[0])) == pr
    y = np.array([r[2] for r in data])
    s = np.array([r[1] for r in data])
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    area = curves.areas(t).first()
    assert math.isclose(area.roc_auc, sum(pairs) / len(pairs))
    recall, precision = [r[2] for r in pr], [r[1] for r in pr]
    assert math.isclose(area.pr_auc, -np.trapezoid(precision, recall))
    assert math.isclose(area.avg_precision, sum((a - b) * p for a, b, p in zip(recall, recall[1:], precision)))
    # Both variants of recall at k.
    p = min(n, 1000)
    capped = {r.point: (r.cut, r.recall) for r in curves.recall_at_k(df, "s", "y", "id", table=t).collect()}
    assert [capped[i] for i in range(p)] == brute_recall(data, [i / (p - 1) for i in range(p)])
    ks = np.linspace(0, 1, 1000)
    free = {r.point: (r.cut, r.recall, r.k) for r in curves.recall_at_k(df, "s", "y", "id", cap=False, table=t).collect()}
    assert [free[i][:2] for i in range(1000)] == brute_recall(data, ks)
    assert [free[i][2] for i in range(1000)] == list(ks)
    # Thresholds.
    f1 = [2 * p_ * r / (p_ + r + 1e-8) for _, p_, r in pr]
    lifts = [r - k for (_, r), k in zip(brute_recall(data, ks), ks)]
    target = brute_recall(data, ks)[int(np.argmax(lifts))][1]
    nearest = pr[int(np.argmin([abs(r - target) for _, _, r in pr[:-1]]))][0]
    assert rows(thresholds.best_thresholds(df, "s", "y", "id", table=t)) == [(pr[int(np.argmax(f1))][0], nearest)]


def test_roc_drops_points_on_straight_stretches_only(spark):
    data, df = random_scored(spark, 600, 9, 300)
    t = curves.score_table(df, "s", "y")
    full = sorted(rows(curves.roc_curve(t, drop_intermediate=False)), reverse=True)
    thin = sorted(rows(curves.roc_curve(t)), reverse=True)
    fp = np.cumsum([0] + [sum(1 for _, s, y in data if s == th and y == 0) for th, *_ in full[1:]])
    tp = np.cumsum([0] + [sum(1 for _, s, y in data if s == th and y == 1) for th, *_ in full[1:]])
    bent = (np.diff(fp[1:], 2) != 0) | (np.diff(tp[1:], 2) != 0)
    keep = [True, True, *bent, True]
    assert thin == [p for p, k in zip(full, keep) if k]
    assert full[0][1:] == (0.0, 0.0) and full[-1][1:] == (1.0, 1.0)


def test_sweeps_against_brute_force(spark):
    data, df = random_scored(spark, 500, 4, 99)
    t = curves.score_table(df, "s", "y")
    ppv = {r.threshold: (r.ppv, r.npv) for r in curves.ppv_npv(t).collect()}
    rate = {r.threshold: r.rate for r in curves.flag_rate(t).collect()}
    edges = [float(e) for e in np.linspace(0, 1, 100)]
    assert sorted(ppv) == edges == sorted(rate)
    for e in edges:
        hit = [y for _, s, y in data if s >= e]
        miss = [y for _, s, y in data if s < e]
        assert ppv[e] == (sum(hit) / len(hit) if hit else None, miss.count(0) / len(miss) if miss else None)
        assert rate[e] == len(hit) / len(data)


def test_calibration_edges_belong_to_the_lower_bin(spark):
    scores = [0.0, 0.05, 0.0501, 0.1, 0.15, 0.95, 0.9500001, 1.0, 0.3, 0.35, 0.6]
    df = spark.createDataFrame([(s, 1) for s in scores], "s double, y int")
    t = curves.score_table(df, "s", "y")
    got = {r.bin: r.n for r in curves.calibration_bins(t).collect()}
    edges = np.linspace(0, 1, 21)[1:-1]
    expected = np.bincount(np.searchsorted(edges, scores), minlength=20)
    assert got == {i: n for i, n in enumerate(expected) if n}
    outside = curves.score_table(spark.createDataFrame([(1.5, 1)], "s double, y int"), "s", "y")
    with pytest.raises(Exception, match="between 0 and 1"):
        curves.calibration_bins(outside).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_histogram_matches_numpy(spark, seed):
    rng = random.Random(seed)
    values = [rng.gauss(0, 3) for _ in range(2000)] + [i / 50 for i in range(51)]
    df = spark.createDataFrame([(x, int(x > 0)) for x in values], "x double, y int")
    edges = np.histogram_bin_edges(values, 50)
    for y in (0, 1):
        expected, _ = np.histogram([x for x in values if int(x > 0) == y], bins=edges)
        got = {r.bin: r.n for r in curves.histogram(df, "x", by="y").filter(F.col("y") == y).collect()}
        assert got == {i: n for i, n in enumerate(expected) if n}


def test_histogram_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert rows(curves.histogram(df, "x")) == [(25, 2.0, 2.02, 2)]
    assert curves.histogram(df.limit(0), "x").count() == 0


def test_error_scores(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0)], "s double, y int")
    got = df.select(
        curves.error_score(F.col("s"), F.col("y")).alias("e"), curves.error_score(F.col("s"), F.col("y"), True).alias("d")
    ).collect()
    assert [round(r.e, 12) for r in got] == [-0.1, 0.2] and [round(r.d, 12) for r in got] == [-0.1, 0.8]


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_only(spark, label):
    df = spark.createDataFrame([(i, i / 10, label) for i in range(5)], "id int, s double, y int")
    t = curves.score_table(df, "s", "y")
    assert {r.recall for r in curves.curve_points(t).collect()} == ({1.0} if label == 0 else {0.2, 0.4, 0.6, 0.8, 1.0})
    assert curves.auc_roc(t).first().roc_auc is None
    assert curves.recall_at_k(df, "s", "y", "id", table=t).count() == 5
    assert thresholds.summary(t).first().prevalence == label


def test_one_row(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], "id int, s double, y int")
    assert rows(curves.recall_at_k(df, "s", "y", "id")) == [(0, 0.0, 0, 0.0, 0.0)]
    assert set(thresholds.evaluate(df, "s", "y", "id")) >= {"pr_curve", "summary"}


def test_labels_must_be_binary(spark):
    with pytest.raises(Exception, match="must be 0 or 1"):
        curves.score_table(spark.createDataFrame([(0.5, 2)], "s double, y int"), "s", "y")


def test_evaluate_with_and_without_label(spark, four):
    tables = thresholds.evaluate(four, "s", "y", "id", {"max_f1 (val)": 0.65, "max_lift (val)": None})
    named = {r.name: (r.threshold, r.precision, r.recall) for r in tables["thresholds"].collect()}
    assert named["max_f1"][0] == 0.7 and named["max_f1 (val)"] == (0.65, 2 / 3, 1.0) and "max_lift (val)" not in named
    assert all(t.count() for t in tables.values())
    assert set(thresholds.evaluate(four.drop("y"), "s", "y", "id")) == {"histogram", "flag_rate"}


def test_threshold_for(spark, four):
    t = curves.score_table(four, "s", "y")
    assert thresholds.threshold_for(t) == 0.7
    assert thresholds.threshold_for(t, 0.45) == 0.8
    assert thresholds.threshold_for(t, 0.0) == 0.8  # never the end point


def test_tables_are_read_from_the_written_scores(spark, four):
    t = curves.score_table(four, "s", "y")
    assert "LocalTableScan" not in plan_of(curves.pr_curve(t)) and "CartesianProduct" not in plan_of(curves.ppv_npv(t))
    assert "NestedLoop" not in plan_of(curves.recall_at_k(four, "s", "y", "id", table=t))


@pytest.mark.parametrize("odd", [None, float("nan"), float("inf")])
def test_histograms_refuse_values_that_are_no_number(spark, odd):
    df = spark.createDataFrame([(1.0,), (2.0,), (odd,)], "x double")
    with pytest.raises(ValueError, match="finite"):
        curves.histogram(df, "x")


def test_score_table_ranks_without_range_shuffle_and_curves_without_join(spark):
    df = spark.range(1000).select((F.col("id") % 97 / 97).alias("s"), (F.col("id") % 2).cast("int").alias("y"))
    rows = curves.score_rows(df, "s", "y")
    counts = with_range(rows, "score", range_edges(rows, "score")).groupBy("__range", "score").agg(F.sum("n").alias("n"))
    plan = descending_totals(counts, "score", {"n": "n"}, {"n": "next_n"})._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and plan.count("Join") == 1  # the join is that with one row a range
    assert "Join" not in curves.roc_curve(curves.score_table(df, "s", "y"))._jdf.queryExecution().optimizedPlan().toString()
