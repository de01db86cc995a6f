"""Scoring a new unified table with a saved model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rollbook.functions.ordering import cut_lineage
from rollbook.operators import cleaning, sequence
from rollbook.operators.model import EwsModel
from rollbook.plans.training import DataSettings, Run, score_splits, write_run
from rollbook.sources.contract import check_input, fingerprint, one_year


def infer(
    df: DataFrame, holidays: DataFrame | None, data: DataSettings, model_path: str, name: str, path: str | None = None
) -> Run:
    """Clean the whole table as one split, score it and, if it has the label, evaluate it.

    Float means and valid days are those of this table, unless the settings share the
    training table's means or its split's valid days. A contract with other names, types or
    groups than the model's is an error. With a `path` the results are written there.
    """
    fitted = EwsModel.load(model_path)
    if fitted.contract not in (None, fingerprint(data.contract)):
        raise ValueError("the contract is not the one the model was trained by")
    if data.share_means and fitted.means is None:
        raise ValueError("the model holds no training means")
    label = data.label if data.label in [c.lower() for c in df.columns] else None
    clean, groups, _ = cleaning.preprocess(
        one_year(df, data.acad_year), data.contract, data.statuses, data.order_key, data.filters, data.index, data.label
    )
    dates = sequence.column_positions(clean)
    clean = cut_lineage(sequence.sequence_from_wide(clean))
    features, _, _ = sequence.engineer(
        clean, holidays, data.acad_year, data.sequences, data.drop, groups, data.index, label, dates,
        fitted.valid_days if data.share_valid_days else None,
    )
    check_input(features, fitted.features)
    scored = {name: cut_lineage(fitted.transform(features))}
    run = score_splits(fitted, scored, data.label, data.index)
    if path is not None:
        write_run(run, path)
    return run
