"""Feature attributions of a tree ensemble (exact Shapley values over its paths).

A leaf's game is a product over the features of its path: a feature counts 1 or 0 (its tests are met or not) if it is
known and its cover share if not. The Shapley weights are integrals of t^s (1 - t)^(m - 1 - s), so a feature's
contribution is the integral over t of the product of "share (1 - t) + met t" of the others. That is a polynomial,
and Gauss-Legendre points give it exactly. Sums over leaves are carried up the tree, so a tree costs nodes x points.

The forest goes to the tasks as arrays, linear in its nodes; the rows stay where they are and are processed a batch at
a time with NumPy.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.operators.model import EwsModel, numeric_input

# The function travels with its tasks, so executors need no installed copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Tree:
    """A tree as arrays over its nodes, the root first; leaves have no children (-1).

    `share` is a node's part of its parent's cover; `points` are enough for its longest path.
    """

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    share: np.ndarray
    points: int


def tree_of(nodes: Sequence, weight: float) -> tuple[Tree, float]:
    """One tree and its expected value, both times `weight`.

    `nodes` are rows (id, prediction, cover, left, right, feature, threshold) with the
    root at id 0; a test is met by values <= threshold, all others (NaN too) go right.
    """
    by_id = {n["id"]: n for n in nodes}
    place = {i: k for k, i in enumerate(sorted(by_id))}
    left, right, feature = (np.full(len(place), -1, np.int64) for _ in range(3))
    threshold, value = np.zeros(len(place)), np.zeros(len(place))
    share = np.ones(len(place))
    base, longest = 0.0, 1
    todo = [(by_id[0], 1.0, frozenset())]
    while todo:
        node, reach, tested = todo.pop()
        k = place[node["id"]]
        if node["left"] < 0:
            value[k] = weight * node["prediction"]
            base += value[k] * reach
            longest = max(longest, len(tested))
            continue
        left[k], right[k] = place[node["left"]], place[node["right"]]
        feature[k], threshold[k] = node["feature"], node["threshold"]
        for child in (by_id[node["left"]], by_id[node["right"]]):
            part = child["cover"] / node["cover"] if node["cover"] else 0.0
            share[place[child["id"]]] = part
            todo.append((child, reach * part, tested | {node["feature"]}))
    return Tree(left, right, feature, threshold, value, share, (longest + 1) // 2), base


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """top / bottom, 0 where bottom is: no row reaches what lies behind a share of 0."""
    return np.divide(top, bottom, out=np.zeros(np.broadcast_shapes(top.shape, bottom.shape)), where=bottom > 0)


def add_contributions(tree: Tree, columns: Sequence[np.ndarray], out: Sequence[np.ndarray]) -> None:
    """Add a tree's contributions to `out`, one array per feature. Arrays inside are points x rows."""
    at, weights = np.polynomial.legendre.leggauss(tree.points)
    known, weights = ((at + 1) / 2)[:, None], weights / 2

    def below(node: int, product: np.ndarray, path: dict) -> np.ndarray:
        """Sum over the leaves under `node` of value times product; `path` has each tested feature's state."""
        if tree.left[node] < 0:
            return tree.value[node] * product
        f = int(tree.feature[node])
        met_before, share_before, factor_before, gain_before = path.get(f, (True, 1.0, None, 0.0))
        passed = columns[f] <= tree.threshold[node]
        total = 0.0
        for child, here in ((tree.left[node], passed), (tree.right[node], ~passed)):
            met, share = here & met_before, tree.share[child] * share_before
            unmet = share * (1 - known)
            factor = np.where(met, unmet + known, unmet)
            gain = _ratio(met - share, factor)
            step = factor if factor_before is None else _ratio(factor, factor_before)
            part = below(child, product * step, {**path, f: (met, share, factor, gain)})
            # What is under this test counts with its own state of the feature instead of the one above.
            out[f] += weights @ ((gain - gain_before) * part)
            total = total + part
        return total

    below(0, np.ones((tree.points, len(out[0]))), {})


def forest_rows(saved: DataFrame) -> DataFrame:
    """(tree, id, prediction, cover, left, right, feature, threshold) from Spark's saved tree table."""
    node = F.col("nodeData")
    return saved.select(
        F.col("treeID").alias("tree"),
        node["id"].alias("id"),
        node["prediction"].alias("prediction"),
        F.get(node["impurityStats"], F.lit(0)).alias("cover"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    )


def forest_trees(forest: DataFrame, weights: Sequence[float]) -> tuple[list[Tree], float]:
    """All trees and the base value; the forest's size is set by its training, not by the data."""
    found: dict[int, list] = {}
    for row in forest.collect():
        found.setdefault(row.tree, []).append(row)
    made = [tree_of(nodes, weights[tree]) for tree, nodes in found.items()]
    return [tree for tree, _ in made], sum(base for _, base in made)


def tree_shap(df: DataFrame, trees: Sequence[Tree], inputs: Mapping[str, Column]) -> DataFrame:
    """Add `shap`, a struct with one number per feature.

    `inputs` gives the model's input of every feature, in the model's order. No shuffle:
    only those columns cross to Python, as Arrow batches, and the row they belong to waits
    in the JVM.
    """
    # Plain values, which workers can read without this library.
    shared = df.sparkSession.sparkContext.broadcast([vars(tree) for tree in trees])
    names = list(inputs)
    kind = T.StructType([T.StructField(name, T.DoubleType()) for name in names])

    @F.pandas_udf(kind)
    def contributions(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        made = [Tree(**fields) for fields in shared.value]
        for batch in batches:
            columns = [c.to_numpy(dtype=float) for c in batch]
            out = [np.zeros(len(columns[0])) for _ in names]
            for tree in made:
                add_contributions(tree, columns, out)
            yield pd.DataFrame(dict(zip(names, out)), columns=names)

    return df.withColumn("shap", contributions(*[c.cast("double") for c in inputs.values()]))


def model_trees(model: EwsModel, path: str) -> tuple[list[Tree], float]:
    """Trees and base value of a model saved below `path`, in log-odds (twice Spark's margin)."""
    trees = model.classifier.trees
    saved = SparkSession.active().read.parquet(f"{path}/stages/stages/1_{trees.uid}/data")
    return forest_trees(forest_rows(saved), [2.0 * w for w in trees.treeWeights])


def shap_values(model: EwsModel, df: DataFrame, path: str) -> DataFrame:
    """Add `shap` in log-odds to a frame with the model's feature columns."""
    trees, _ = model_trees(model, path)
    encoded = model.classifier.means.transform(df)
    inputs = {
        **{c: F.col(f"`__mean_{c}`") for c in model.categorical},
        **{c: numeric_input(c) for c in model.numerical},
    }
    return tree_shap(encoded, trees, inputs).select(*[F.col(f"`{c}`") for c in df.columns], "shap")
