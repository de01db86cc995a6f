import pytest

from rollbook.plans.settings import from_config

CONFIG = {
    "exp": {"title": "t"},
    "data": {
        "index": "sid",
        "label": "target",
        "column_filters": {"in": {"schcat": ["1"]}},
        "sample": {"p": 0.5, "seed": 5},
        "split": {"train_size": 0.8, "random_state": 42, "shuffle": True},
        "engineer_features": {"groups_of_months": {"sem1": [6, 7]}, "combs_of_chars": [[2, ["a", "p"]]], "partitions": [1, 2]},
        "drop_columns_or_groups": ["geo"],
    },
    "model": {
        "n_trials": 3,
        "calibration_nbins": 10,
        "params": {
            "fixed": {"loss_function": "Logloss", "random_seed": 0, "auto_class_weights": "Balanced", "iterations": 9, "rsm": 1},
            "tune": {
                "independent": {"depth": {"dtype": "int", "tuning_space": {"low": 2, "high": 4}}},
                "dependent": {
                    "subsample": {"dependent_on_param": "depth", "dependent_on_value": [2], "dtype": "float", "tuning_space": {"low": 0.5, "high": 1}}
                },
            },
        },
    },
}


def test_a_configuration_becomes_settings():
    with pytest.warns(UserWarning, match="rsm"):
        data, fit = from_config(CONFIG, {}, {}, "2223", "ord")
    assert (data.index, data.filters, list(data.drop)) == ("sid", {"in": {"schcat": ["1"]}}, ["geo"])
    assert data.sequences.month_groups == {"sem1": [6, 7]} and data.sequences.max_missing == 1.0
    assert (fit.prevalence, fit.train_fraction, fit.split_seed, fit.bins, fit.n_trials) == (0.5, 0.8, 42, 10, 3)
    assert fit.params == {"seed": 0, "balanced": True, "maxIter": 9}
    assert set(fit.tune["independent"]) == {"maxDepth"}
    assert fit.tune["dependent"]["subsamplingRate"]["dependent_on_param"] == "maxDepth"


def test_bad_settings_are_errors():
    bad = {**CONFIG, "data": {**CONFIG["data"], "split": {"train_size": 0.8, "shuffle": False}}}
    with pytest.raises(ValueError, match="shuffle"):
        from_config(bad, {}, {}, "2223", "ord")
    bad = {**CONFIG, "data": {**CONFIG["data"], "engineer_features": {"typo": 1}}}
    with pytest.raises(ValueError, match="typo"):
        from_config(bad, {}, {}, "2223", "ord")


def _with_tuning(independent, dependent):
    params = {"fixed": {"auto_class_weights": "SqrtBalanced"}, "tune": {"independent": independent, "dependent": dependent}}
    return {**CONFIG, "model": {**CONFIG["model"], "params": params}}


def test_class_weights_read_the_same_everywhere():
    weights = {"auto_class_weights": {"dtype": "categorical", "tuning_space": {"choices": ["Balanced", "SqrtBalanced", "None"]}}}
    rule = {"dependent_on_param": "auto_class_weights", "dependent_on_value": ["Balanced"], "dtype": "int", "tuning_space": {"low": 2, "high": 4}}
    _, fit = from_config(_with_tuning(weights, {"depth": rule}), {}, {}, "2223", "ord")
    assert fit.params == {"balanced": "SqrtBalanced"}
    assert fit.tune["independent"]["balanced"]["tuning_space"]["choices"] == [True, "SqrtBalanced", False]
    assert fit.tune["dependent"]["maxDepth"]["dependent_on_value"] == [True]


def test_a_rule_on_an_unknown_parameter_is_told():
    rule = {"dependent_on_param": "rsm", "dependent_on_value": [1], "dtype": "int", "tuning_space": {"low": 2, "high": 4}}
    with pytest.warns(UserWarning, match="depends on"):
        _, fit = from_config(_with_tuning({}, {"depth": rule}), {}, {}, "2223", "ord")
    assert fit.tune["dependent"] == {}
