"""The classifier as a stage of `pyspark.ml` pipelines: an estimator, and a model that can be saved and applied to streams."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook import vocabulary as v
from rollbook.operators import model
from rollbook.sources.contract import check_input


class _Columns(Params):
    """What estimator and model share."""

    categorical = Param(Params._dummy(), "categorical", "text columns", TypeConverters.toListString)
    numerical = Param(Params._dummy(), "numerical", "number columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "0 or 1", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique id of a row", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(categorical=[], numerical=[], labelCol=v.LABEL, idCol=v.INDEX)


class EarlyWarningClassifier(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees with calibration and a threshold, fitted by `model.train`.

    Rows where `validationIndicatorCol` is true calibrate the scores and choose the threshold; all others, null included,
    train. `treeParams` are the parameters of `model.fit_classifier`, `tune` and `nTrials` those of its search.
    """

    validationIndicatorCol = Param(Params._dummy(), "validationIndicatorCol", "true for rows held out", TypeConverters.toString)
    treeParams = Param(Params._dummy(), "treeParams", "parameters of the trees, smoothing and balanced", TypeConverters.identity)
    tune = Param(Params._dummy(), "tune", "search space; empty for none", TypeConverters.identity)
    nTrials = Param(Params._dummy(), "nTrials", "trials of the search", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of the calibration", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of fit and search", TypeConverters.toInt)

    def __init__(self, **values) -> None:
        super().__init__()
        self._defaults()
        self._setDefault(validationIndicatorCol="validation", treeParams={}, tune={}, nTrials=10, bins=v.CALIBRATION_BINS, seed=0)
        self._set(**values)

    def _fit(self, dataset: DataFrame) -> EarlyWarningModel:
        value = self.getOrDefault
        held_out = F.coalesce(F.col(value("validationIndicatorCol")).cast("boolean"), F.lit(False))
        fitted = model.train(
            dataset.filter(~held_out), dataset.filter(held_out), value("labelCol"), value("idCol"), value("categorical"), value("numerical"),
            value("treeParams"), value("tune") or None, value("nTrials"), value("bins"), value("seed"),
        ).model
        return self._copyValues(EarlyWarningModel(fitted))


class EarlyWarningModel(Model, _Columns, MLReadable, MLWritable):
    """Adds preds_proba_0, preds_proba_1 and preds to the rows of a table or a stream."""

    def __init__(self, fitted: model.EwsModel) -> None:
        super().__init__()
        self._defaults()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        check_input(dataset, self.fitted.features)
        return self.fitted.transform(dataset)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, instance: EarlyWarningModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.fitted.save(f"{path}/fitted")


class _ModelReader(MLReader):
    def load(self, path: str) -> EarlyWarningModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        loaded = EarlyWarningModel(model.EwsModel.load(f"{path}/fitted"))
        loaded._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(loaded, metadata)
        return loaded
