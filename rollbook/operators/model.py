"""Training, tuning, calibrating and applying the boosted-tree classifier.

`pyspark.ml` does the fitting; this module fixes the contracts around it: how
categories enter, how trials are drawn and scored, and which columns a scored frame has.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook import vocabulary as v
from rollbook.functions.ordering import cut_lineage
from rollbook.operators import calibration, curves, sampling, thresholds
from rollbook.operators.encoding import CategoryMeans, fit_category_means, with_ordered_numbers

_WEIGHT = "__weight"
_IS_VALIDATION = "__is_validation"
_FEATURES = "__features"
_NUMBER = "__number_"
#: What missing numbers are to the trees.
MISSING_NUMBER = -1e300
#: Version of what `save` writes; `load` refuses others.
STATE_VERSION = 2
#: Values of `balanced`, and the power of the class ratio that each uses.
WEIGHTINGS = {True: 1.0, "Balanced": 1.0, "SqrtBalanced": 0.5}


@dataclass
class Classifier:
    """Category means, assembly and trees."""

    means: CategoryMeans
    stages: PipelineModel
    balanced: bool | str | None = False

    @property
    def trees(self) -> GBTClassificationModel:
        return self.stages.stages[-1]

    def inputs(self, df: DataFrame) -> DataFrame:
        """Add the vector the trees read."""
        assembler = self.stages.stages[0]
        numbers = [c.removeprefix(_NUMBER) for c in assembler.getInputCols() if c.startswith(_NUMBER)]
        return assembler.transform(_with_numbers(self.means.transform(df), numbers))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the trees' output columns and the probability of class 1."""
        return _with_probability(self.trees.transform(self.inputs(df)))


@dataclass
class EwsModel:
    """A fitted classifier with its calibrator, threshold and feature lists."""

    classifier: Classifier
    calibrator: IsotonicRegressionModel
    threshold: float
    categorical: list[str]
    numerical: list[str]
    params: dict = field(default_factory=dict)
    threshold_max_lift: float | None = None
    valid_days: list[int] | None = None
    #: Column means of the training table, and the contract it was cleaned by.
    means: dict[str, float | None] | None = None
    contract: str | None = None

    @property
    def features(self) -> list[str]:
        return [*self.categorical, *self.numerical]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add preds_proba_0, preds_proba_1 and preds to the rows themselves."""
        scored = calibration.calibrate(self.calibrator, self.classifier.transform(df), v.PROBA_1, v.PROBA_1)
        return scored.withColumns(
            {
                v.PROBA_0: F.lit(1.0) - F.col(v.PROBA_1),
                v.PREDICTION: (F.col(v.PROBA_1) >= F.lit(self.threshold)).cast("int"),
            }
        ).select(*df.columns, v.PROBA_0, v.PROBA_1, v.PREDICTION)

    def save(self, path: str) -> None:
        """Write category means, trees, calibrator and settings below `path`."""
        self.classifier.means.save(f"{path}/means")
        self.classifier.stages.write().overwrite().save(f"{path}/stages")
        self.calibrator.write().overwrite().save(f"{path}/calibrator")
        settings = json.dumps(
            {
                "threshold": self.threshold,
                "threshold_max_lift": self.threshold_max_lift,
                "categorical": self.categorical,
                "numerical": self.numerical,
                "params": self.params,
                "valid_days": self.valid_days,
                "means": self.means,
                "contract": self.contract,
                "version": STATE_VERSION,
                "overall": self.classifier.means.overall,
                "sizes": self.classifier.means.sizes,
            }
        )
        spark = SparkSession.active()
        spark.range(1).select(F.lit(settings).alias("value")).coalesce(1).write.mode("overwrite").text(
            f"{path}/settings"
        )

    @classmethod
    def load(cls, path: str) -> EwsModel:
        """Read what `save` wrote."""
        settings = json.loads(SparkSession.active().read.text(f"{path}/settings").first().value)
        version = settings.pop("version", None)
        if version != STATE_VERSION:
            raise ValueError(f"the model below {path} has state version {version}, not {STATE_VERSION}")
        means = CategoryMeans.load(f"{path}/means", settings.pop("overall"), settings.pop("sizes"))
        classifier = Classifier(means, PipelineModel.load(f"{path}/stages"))
        return cls(classifier, IsotonicRegressionModel.load(f"{path}/calibrator"), **settings)


def class_weights(df: DataFrame, label: str, kind: bool | str = True) -> dict[int, float]:
    """Per class: rows of the largest class over rows of this class, for "SqrtBalanced" the root of it."""
    if kind not in WEIGHTINGS:
        raise ValueError(f"class weights are one of {list(WEIGHTINGS)}, not {kind!r}")
    counts = sampling.class_counts(df, label)
    return {c: (max(counts.values()) / n) ** WEIGHTINGS[kind] for c, n in counts.items() if n}


def with_weights(df: DataFrame, label: str, weights: Mapping[int, float]) -> DataFrame:
    """Add each row's class weight."""
    weight = F.when(F.col(label) == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0))
    return df.withColumn(_WEIGHT, weight.cast("double"))


def numeric_input(name: str) -> Column:
    """A number as the trees read it: missing values (null or NaN) lie below all others, in fitting and scoring alike."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(MISSING_NUMBER)).otherwise(x)


def _with_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{_NUMBER}{c}": numeric_input(c) for c in names})


def _encode(
    train: DataFrame, val: DataFrame, label: str, categorical: Sequence[str], numerical: Sequence[str], smoothing: float,
    id: str | None = None, seed: int = 0,
) -> tuple[CategoryMeans, VectorAssembler, DataFrame]:
    """Category means of the training rows, the assembler, and rows (label, features, validation or not) of both.

    With an `id` training rows get the means of the rows before them in its seeded order; without one they get the means
    themselves, which hold their own labels. Validation rows always get the means, as rows to be scored do.
    """
    means = fit_category_means(train, categorical, label, smoothing)
    assembler = VectorAssembler(
        inputCols=[*[f"__mean_{c}" for c in categorical], *[f"{_NUMBER}{c}" for c in numerical]], outputCol=_FEATURES
    )
    if id is None:
        own = means.transform(train)
    else:
        own = with_ordered_numbers(train, categorical, label, id, seed, max(1.0, smoothing))
    both = own.withColumn(_IS_VALIDATION, F.lit(False)).unionByName(
        means.transform(val).withColumn(_IS_VALIDATION, F.lit(True))
    )
    encoded = assembler.transform(_with_numbers(both, numerical))
    return means, assembler, encoded.select(label, _FEATURES, _IS_VALIDATION)


def _fit_trees(rows: DataFrame, label: str, params: Mapping, balanced: bool | str | None) -> GBTClassificationModel:
    tree = GBTClassifier(
        featuresCol=_FEATURES, labelCol=label, predictionCol="__prediction",
        validationIndicatorCol=_IS_VALIDATION, **params,
    )
    tree.setProbabilityCol("__probability").setRawPredictionCol("__margin")
    if balanced:
        rows = with_weights(rows, label, class_weights(rows.filter(~F.col(_IS_VALIDATION)), label, balanced))
        tree.setWeightCol(_WEIGHT)
    return tree.fit(rows)


def _with_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn(v.PROBA_1, vector_to_array("__probability")[1])


def _split_params(params: Mapping) -> tuple[dict, float, bool | str | None]:
    params = dict(params)
    return params, params.pop("smoothing", 0.0), params.pop("balanced", False)


def fit_classifier(
    train: DataFrame, val: DataFrame, label: str, categorical: Sequence[str], numerical: Sequence[str], params: Mapping,
    id: str | None = None,
) -> Classifier:
    """Category means from the training rows only, then boosting with `val` as validation set.

    With a unique `id` the trees are fitted on ordered means, in which no row's own label is.

    `params` are those of `GBTClassifier`, and `smoothing` (rows) of the means and
    `balanced` (class weights, a key of `WEIGHTINGS`). Missing numbers count as lower than all others.
    """
    params, smoothing, balanced = _split_params(params)
    # Read once for each level of each tree.
    means, assembler, rows = _encode(train, val, label, categorical, numerical, smoothing, id, params.get("seed") or 0)
    rows = cut_lineage(rows) if id is not None else rows
    return Classifier(means, PipelineModel([assembler, _fit_trees(rows, label, params, balanced)]), balanced)


def loss_table(model: Classifier, train: DataFrame, val: DataFrame, label: str) -> DataFrame:
    """(iteration, trn, val): Spark's log loss 2*log(1+exp(-2yF)) after each tree, weighted as the fit was."""
    tree = model.trees
    weights = class_weights(train, label, model.balanced or True) if tree.isDefined(tree.weightCol) else {}
    losses = [tree.evaluateEachIteration(with_weights(model.inputs(d), label, weights)) for d in (train, val)]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(*losses))]
    return train.sparkSession.createDataFrame(rows, "iteration int, trn double, val double")


def _draw(rng: random.Random, dtype: str, space: Mapping):
    space = {k: (None if x == "None" else x) for k, x in space.items()}
    if dtype == "categorical":
        value = rng.choice(list(space["choices"]))
        return None if value == "None" else value
    low, high, step = space["low"], space["high"], space.get("step")
    if dtype == "int":
        if space.get("log"):
            return min(high, max(low, round(math.exp(rng.uniform(math.log(low), math.log(high))))))
        return rng.randrange(low, high + 1, step or 1)
    if dtype == "float":
        if space.get("log"):
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        if step:
            return low + step * rng.randrange(int(round((high - low) / step, 9)) + 1)
        return rng.uniform(low, high)
    raise ValueError(f"a parameter is int, float or categorical, not '{dtype}'")


def draw_params(rng: random.Random, fixed: Mapping, tune: Mapping) -> dict:
    """One trial: fixed values, independent draws, then draws whose parent has a trigger value."""
    params = dict(fixed)
    for name, rule in tune.get("independent", {}).items():
        params[name] = _draw(rng, rule["dtype"], rule["tuning_space"])
    for name, rule in tune.get("dependent", {}).items():
        if params.get(rule["dependent_on_param"]) in rule["dependent_on_value"]:
            params[name] = _draw(rng, rule["dtype"], rule["tuning_space"])
    return {k: x for k, x in params.items() if x is not None}


def random_search(
    train: DataFrame,
    val: DataFrame,
    label: str,
    categorical: Sequence[str],
    numerical: Sequence[str],
    fixed: Mapping,
    tune: Mapping,
    n_trials: int,
    seed: int = 0,
    id: str | None = None,
) -> tuple[dict, DataFrame]:
    """Seeded random search for the largest trapezoid area under the precision-recall curve on `val`.

    Returns the best parameters (fixed ones included) and the log (trial, params, score). Rows are encoded and
    written once for each value of `smoothing`, not in each trial.
    """
    rng = random.Random(seed)
    trials, encoded = [], {}
    for trial in range(n_trials):
        params = draw_params(rng, fixed, tune)
        own, smoothing, balanced = _split_params(params)
        if smoothing not in encoded:
            encoded[smoothing] = cut_lineage(_encode(train, val, label, categorical, numerical, smoothing, id, seed)[2])
        rows = encoded[smoothing]
        scored = _with_probability(_fit_trees(rows, label, own, balanced).transform(rows.filter(_IS_VALIDATION)))
        narrow = cut_lineage(scored.select(v.PROBA_1, label))
        area = curves.auc_pr(curves.score_table(narrow, v.PROBA_1, label)).first()[0]
        trials.append((trial, params, area))
    best = max(trials, key=lambda t: t[2])[1]
    log = train.sparkSession.createDataFrame(
        [(t, {k: str(x) for k, x in p.items()}, float(a)) for t, p, a in trials],
        "trial int, params map<string,string>, score double",
    )
    return best, log


@dataclass
class TrainingResult:
    """What a fit leaves behind besides the model."""

    model: EwsModel
    trials: DataFrame | None
    losses: DataFrame
    val_scores_before: DataFrame
    val_scores_after: DataFrame


def train(
    df_train: DataFrame,
    df_val: DataFrame,
    label: str,
    id: str,
    categorical: Sequence[str],
    numerical: Sequence[str],
    params: Mapping,
    tune: Mapping | None = None,
    n_trials: int = 10,
    bins: int = v.CALIBRATION_BINS,
    seed: int = 0,
) -> TrainingResult:
    """Tune (optional), fit, score the validation rows, calibrate and choose thresholds."""
    params, trials = {"seed": seed, **params}, None
    if tune:
        params, trials = random_search(
            df_train, df_val, label, categorical, numerical, params, tune, n_trials, seed, id
        )
    classifier = fit_classifier(df_train, df_val, label, categorical, numerical, params, id)
    slim = classifier.transform(df_val).select(
        id, (F.lit(1.0) - F.col(v.PROBA_1)).alias(v.PROBA_0), v.PROBA_1, label
    )
    before = cut_lineage(slim)
    calibrator = calibration.fit_calibrator(before, v.PROBA_1, label, bins)
    after = calibration.calibrate(calibrator, before, v.PROBA_1, v.PROBA_1).withColumn(
        v.PROBA_0, F.lit(1.0) - F.col(v.PROBA_1)
    )
    best = thresholds.best_thresholds(after, v.PROBA_1, label, id).first()
    model = EwsModel(
        classifier, calibrator, best.max_f1, list(categorical), list(numerical), dict(params), best.max_lift
    )
    return TrainingResult(model, trials, loss_table(classifier, df_train, df_val, label), before, after)
