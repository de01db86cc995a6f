"""One training run: clean, sample, split, engineer, fit, evaluate and write."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rollbook import vocabulary as v
from rollbook.functions.ordering import cut_lineage
from rollbook.operators import cleaning, model, sampling, sequence, thresholds
from rollbook.sources import frames
from rollbook.sources.contract import fingerprint, one_year


_ORDER = "__order"


@dataclass(frozen=True)
class DataSettings:
    """How a unified table becomes features.

    `share_valid_days` uses the training split's valid days everywhere, so all splits
    have sequences of the same length; otherwise each table has its own. `share_means`
    fills numbers without a value by the training table's means at inference, too.
    """

    contract: Mapping[str, list]
    statuses: Mapping[str, str]
    acad_year: str
    order_key: str
    index: str = v.INDEX
    label: str = v.LABEL
    filters: Mapping | None = None
    sequences: sequence.SequenceConfig = sequence.SequenceConfig()
    drop: Sequence[str] = ()
    share_valid_days: bool = False
    share_means: bool = False


@dataclass(frozen=True)
class FitSettings:
    """How the model is fitted."""

    prevalence: float | str = "actual"
    sample_seed: int | None = None
    train_fraction: float = 0.7
    split_seed: int = 0
    params: Mapping = field(default_factory=dict)
    tune: Mapping | None = None
    n_trials: int = 10
    bins: int = v.CALIBRATION_BINS


@dataclass
class Run:
    """What a run produces."""

    model: model.EwsModel
    frames: dict[str, DataFrame]
    evaluations: dict[str, dict[str, DataFrame]]
    summary: DataFrame
    fit: model.TrainingResult | None = None


def train_and_evaluate(
    df: DataFrame, holidays: DataFrame | None, data: DataSettings, fit: FitSettings, path: str | None = None
) -> Run:
    """Run everything on a unified table; with a `path`, write model, frames, scores and metrics there."""
    clean, groups, means = cleaning.preprocess(
        one_year(df, data.acad_year), data.contract, data.statuses, data.order_key, data.filters, data.index, data.label,
        keep_order=_ORDER,
    )
    # Read by the class counts, the rank search, the valid days of both splits and the
    # features; written with one string instead of a column per day.
    dates = sequence.column_positions(clean)
    clean = cut_lineage(sequence.sequence_from_wide(clean))
    sampled = sampling.prevalence_sample(clean, data.label, fit.prevalence, _ORDER, fit.sample_seed).drop(_ORDER)
    halves = sampling.stratified_split(sampled, data.label, data.index, fit.train_fraction, fit.split_seed)
    splits, categorical, numerical, shared = {}, None, None, None
    if data.share_valid_days:
        shared = sequence.valid_positions(halves[0], holidays, data.acad_year, data.sequences.max_missing, dates)
    for name, half in zip(("train", "val"), halves):
        features, cats, nums = sequence.engineer(
            half, holidays, data.acad_year, data.sequences, data.drop, groups, data.index, data.label, dates, shared
        )
        if categorical is None:
            categorical, numerical = cats, nums
        splits[name] = cut_lineage(features)
    fitted = model.train(
        splits["train"], splits["val"], data.label, data.index, categorical, numerical,
        fit.params, fit.tune, fit.n_trials, fit.bins,
    )
    fitted.model.valid_days = shared
    fitted.model.means, fitted.model.contract = means, fingerprint(data.contract)
    scored = {name: cut_lineage(fitted.model.transform(part)) for name, part in splits.items()}
    run = score_splits(fitted.model, scored, data.label, data.index)
    run.fit = fitted
    run.summary = training_summary(fitted.model, splits["train"])
    if path is not None:
        fitted.model.save(f"{path}/model")
        frames.write_scores(fitted.val_scores_before, f"{path}/scores_before")
        frames.write_scores(fitted.val_scores_after, f"{path}/scores_after")
        write_run(run, path)
    return run


def score_splits(fitted: model.EwsModel, scored: Mapping[str, DataFrame], label: str, index: str) -> Run:
    """Evaluate scored splits, with the training thresholds as named ones."""
    named = {"max_f1 (val)": fitted.threshold, "max_lift (val)": fitted.threshold_max_lift}
    evaluations = {
        name: thresholds.evaluate(part, v.PROBA_1, label, index, named) for name, part in scored.items()
    }
    return Run(fitted, dict(scored), evaluations, training_summary(fitted))


def training_summary(fitted: model.EwsModel, train: DataFrame | None = None) -> DataFrame:
    """Rows (key, value) that describe the fit."""
    rows = {
        "best_params": fitted.params,
        "val_threshold_max_f1": fitted.threshold,
        "val_threshold_max_lift": fitted.threshold_max_lift,
        "categorical_features": fitted.categorical,
        "n_categorical_features": len(fitted.categorical),
        "numerical_features": fitted.numerical,
        "n_numerical_features": len(fitted.numerical),
    }
    if train is not None:
        rows["shape_training_data"] = [train.count(), len(train.columns)]
    return SparkSession.active().createDataFrame(
        [(k, json.dumps(x)) for k, x in rows.items()], "key string, value string"
    )


def write_run(run: Run, path: str) -> None:
    """Write the scored splits, their evaluation tables, their summary metrics and the run's summary."""
    frames.write_frames(run.frames, f"{path}/frames")
    for split, tables in run.evaluations.items():
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/evaluation/{split}/{name}")
        if "summary" in tables:
            frames.write_metrics(frames.metrics_long(tables["summary"], split), f"{path}/metrics/{split}")
    frames.write_metrics(run.summary, f"{path}/summary")
