import itertools
import math
import random

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from rollbook.operators import attribution, explanation

GROUPS = {"A": ["x", "y"], "B": ["z"]}


def explained(spark, values, threshold=0.5):
    df = spark.createDataFrame([(*v, p) for *v, p in values], "x double, y double, z double, preds_proba_1 double")
    df = df.select(F.struct("x", "y", "z").alias("shap"), "preds_proba_1")
    return explanation.explain_groups(df, GROUPS, threshold)


def test_worked_example(spark):
    row = explained(spark, [(0.3, -0.1, -0.5, 0.6)]).first()
    assert (row.predictor_group_1_for_dropout, row.predictor_group_1_for_dropout_top_driver) == ("A", "x")
    assert (row.predictor_group_2_for_dropout, row.predictor_group_2_for_dropout_top_driver) == ("B", None)
    assert (row.predictor_group_1_for_notdropout, row.predictor_group_1_for_notdropout_top_driver) == ("B", "z")
    assert (row.predictor_group_2_for_notdropout, row.predictor_group_2_for_notdropout_top_driver) == ("A", "y")
    assert (row.preds, row.predictor_group_1, row.predictor_group_1_top_driver) == ("dropout", "A", "x")


def reference_rank(values, label):
    result = []
    for g, members in GROUPS.items():
        kept = [(f, s if label else abs(s)) for f in members for s in [values[f]] if (s > 0 if label else s <= 0)]
        top = max(kept, key=lambda e: e[1])[0] if kept else None
        result.append((g, sum(s for _, s in kept), top))
    return [(g, top) for g, _, top in sorted(result, key=lambda e: e[1], reverse=True)]


def test_ties_zeros_and_random_values(spark):
    choices = [-0.5, -0.25, 0.0, 0.25, 0.5]
    values = [(*v, float(i % 2)) for i, v in enumerate(itertools.product(choices, repeat=3))]
    for row in explained(spark, values).collect():
        named = row.shap.asDict()
        for label, text in ((1, "dropout"), (0, "notdropout")):
            got = [(row[f"predictor_group_{i}_for_{text}"], row[f"predictor_group_{i}_for_{text}_top_driver"]) for i in (1, 2)]
            assert got == reference_rank(named, label)
        chosen = reference_rank(named, int(row.preds == "dropout"))
        assert [(row[f"predictor_group_{i}"], row[f"predictor_group_{i}_top_driver"]) for i in (1, 2)] == chosen


def test_no_shuffle_and_no_python(spark):
    plan = plan_of(explained(spark, [(0.3, -0.1, -0.5, 0.6)]))
    assert "Exchange" not in plan and "Python" not in plan


def test_groups_are_checked():
    with pytest.warns(UserWarning, match="ignored"):
        assert explanation.check_groups({"a": ["x", "gone"], "b": ["gone2"]}, ["x"]) == {"a": ["x"]}
    for bad, words in (
        ({"": ["x"]}, "non-empty text"), ({"a": []}, "is empty"), ({"a": ["x"], "b": ["x"]}, "more than one"),
    ):
        with pytest.raises(ValueError, match=words):
            explanation.check_groups(bad, ["x"])
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="no group"):
        explanation.check_groups({"a": ["y"]}, ["x"])


def random_tree(rng, depth, n_features):
    nodes = []

    def grow(d, cover):
        i = len(nodes)
        nodes.append(dict(id=i, prediction=rng.uniform(-2, 2), cover=cover, left=-1, right=-1, feature=-1, threshold=None))
        if d:
            nodes[i].update(feature=rng.randrange(n_features), threshold=rng.random())
            part = rng.uniform(0.1, 0.9)
            nodes[i]["left"] = grow(d - 1, cover * part)
            nodes[i]["right"] = grow(d - 1, cover * (1 - part))
        return i

    grow(depth, 100.0)
    return nodes


def expectation(nodes, x, known, i=0):
    n = nodes[i]
    if n["left"] < 0:
        return n["prediction"]
    left, right = nodes[n["left"]], nodes[n["right"]]
    if n["feature"] in known:
        return expectation(nodes, x, known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
    return (
        left["cover"] * expectation(nodes, x, known, n["left"]) + right["cover"] * expectation(nodes, x, known, n["right"])
    ) / n["cover"]


def shapley(nodes, x, m):
    out = []
    for f in range(m):
        others = [g for g in range(m) if g != f]
        total = 0.0
        for size in range(m):
            for s in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                total += w * (expectation(nodes, x, {*s, f}) - expectation(nodes, x, set(s)))
        out.append(total)
    return out


def test_tree_attribution_equals_brute_force(spark):
    rng = random.Random(11)
    m = 4
    trees = [random_tree(rng, depth, m) for depth in (4, 6, 6)]
    weights = [1.0, 0.1, 0.3]
    made = [attribution.tree_of(nodes, w) for nodes, w in zip(trees, weights)]
    base = sum(expected for _, expected in made)
    points = [[rng.random() for _ in range(m)] for _ in range(30)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "i int, inputs array<double>").repartition(3)
    names = [f"f{j}" for j in range(m)]
    inputs = {n: F.col("inputs")[j] for j, n in enumerate(names)}
    for row in attribution.tree_shap(df, [t for t, _ in made], inputs).collect():
        x = points[row.i]
        expected = np.sum([w * np.array(shapley(t, x, m)) for t, w in zip(trees, weights)], axis=0)
        assert np.allclose([row.shap[n] for n in names], expected, atol=1e-12)
        total = sum(w * expectation(t, x, set(range(m))) for t, w in zip(trees, weights))
        assert math.isclose(sum(row.shap) + base, total, abs_tol=1e-12)


def test_deep_trees_are_small_and_add_up():
    rng = random.Random(5)
    m = 12
    forest = [random_tree(rng, 10, m) for _ in range(5)]
    columns = [np.array([rng.random() for _ in range(200)]) for _ in range(m)]
    columns[3][:20] = math.nan  # goes right, as in the trees themselves
    out = [np.zeros(200) for _ in range(m)]
    base = 0.0
    for nodes in forest:
        tree, expected = attribution.tree_of(nodes, 1.0)
        base += expected
        assert tree.points <= 5 and all(len(x) == len(nodes) for x in (tree.left, tree.value, tree.share))
        attribution.add_contributions(tree, columns, out)
    for i in range(0, 200, 7):
        x = [c[i] for c in columns]
        total = sum(expectation(nodes, x, set(range(m))) for nodes in forest)
        assert math.isclose(base + sum(o[i] for o in out), total, abs_tol=1e-9)


def test_a_child_that_no_row_reached():
    leaf = dict(left=-1, right=-1, feature=-1, threshold=None)
    nodes = [
        dict(id=0, prediction=0.0, cover=4.0, left=1, right=2, feature=0, threshold=0.5),
        dict(id=1, prediction=1.0, cover=4.0, **leaf),
        dict(id=2, prediction=0.0, cover=0.0, left=3, right=4, feature=1, threshold=0.5),
        dict(id=3, prediction=5.0, cover=0.0, **leaf),
        dict(id=4, prediction=7.0, cover=0.0, **leaf),
    ]
    tree, base = attribution.tree_of(nodes, 1.0)
    out = [np.zeros(1), np.zeros(1)]
    attribution.add_contributions(tree, [np.array([0.2]), np.array([0.2])], out)
    assert base == 1.0 and [float(o[0]) for o in out] == [0.0, 0.0]
