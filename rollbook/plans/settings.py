"""Settings from an experiment's configuration as plain dictionaries.

Keys the trees of `pyspark.ml` have no counterpart for are left out with a warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from rollbook import vocabulary as v
from rollbook.operators.sequence import SequenceConfig
from rollbook.plans.training import DataSettings, FitSettings

# Names of a configuration's model parameters and what they are called here.
PARAM_NAMES = {
    "iterations": "maxIter",
    "depth": "maxDepth",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    "random_seed": "seed",
    "auto_class_weights": "balanced",
}
# Parameters that hold for these trees anyway, or concern the machine.
SETTLED = {"loss_function", "task_type", "devices"}


def _weighting(value):
    """Full balancing is True and none is False, so that fixed, drawn and triggering values are the same."""
    return {"Balanced": True, "None": False, None: False}.get(value, value)


def _values(name: str, rule: Mapping, key: str) -> dict:
    """A tuning rule whose list of class weights under `key` is written as everywhere else."""
    if name != "auto_class_weights" or key not in rule:
        return dict(rule)
    return {**rule, key: [_weighting(x) for x in rule[key]]}


def _params(given: Mapping) -> dict:
    kept = {}
    for name, value in given.items():
        if name in PARAM_NAMES:
            kept[PARAM_NAMES[name]] = _weighting(value) if name == "auto_class_weights" else value
        elif name not in SETTLED:
            warnings.warn(f"model parameter without a counterpart is ignored: {name}", stacklevel=3)
    return kept


def _tune(given: Mapping | None) -> dict | None:
    if not given:
        return None
    def space(name: str, rule: Mapping) -> dict:
        return {**rule, "tuning_space": _values(name, rule["tuning_space"], "choices")}

    known = {PARAM_NAMES[n]: space(n, rule) for n, rule in given.get("independent", {}).items() if _params({n: None})}
    dependent = {}
    for name, rule in given.get("dependent", {}).items():
        parent = rule["dependent_on_param"]
        if parent not in PARAM_NAMES:
            warnings.warn(f"{name} depends on a parameter without a counterpart and is ignored: {parent}", stacklevel=3)
        elif _params({name: None}):
            own = space(name, _values(parent, rule, "dependent_on_value"))
            dependent[PARAM_NAMES[name]] = {**own, "dependent_on_param": PARAM_NAMES[parent]}
    return {"independent": known, "dependent": dependent}


def sequence_config(given: Mapping) -> SequenceConfig:
    """The sequence features of a configuration; missing keys take the defaults."""
    names = {
        "groups_of_months": "month_groups",
        "combs_of_chars": "char_combinations",
        "partitions": "partitions",
        "disc_cols_miss_frxn": "max_missing",
        "months_for_binary": "binary_months",
        "absence_thresholds": "absence_thresholds",
    }
    unknown = sorted(set(given) - set(names))
    if unknown:
        raise ValueError(f"unknown settings of sequence features: {unknown}")
    return SequenceConfig(**{names[k]: x for k, x in given.items()})


def from_config(
    config: Mapping, contract: Mapping[str, list], statuses: Mapping[str, str], acad_year: str, order_key: str
) -> tuple[DataSettings, FitSettings]:
    """The sections `data` and `model` of a configuration as settings of a run."""
    data, fit = config["data"], config["model"]
    sample, split, params = data.get("sample", {}), data["split"], fit["params"]
    if not split.get("shuffle", True):
        raise ValueError("a stratified split needs shuffle")
    return (
        DataSettings(
            contract=contract,
            statuses=statuses,
            acad_year=acad_year,
            order_key=order_key,
            index=data.get("index", v.INDEX),
            label=data.get("label", v.LABEL),
            filters=data.get("column_filters"),
            sequences=sequence_config(data.get("engineer_features", {})),
            drop=data.get("drop_columns_or_groups") or (),
        ),
        FitSettings(
            prevalence=sample.get("p", "actual"),
            train_fraction=split["train_size"],
            split_seed=split.get("random_state", 0),
            params=_params(params["fixed"]),
            tune=_tune(params.get("tune")),
            n_trials=fit.get("n_trials", 10),
            bins=fit.get("calibration_nbins") or v.CALIBRATION_BINS,
        ),
    )
