"""Recipes as a Spark ML stage: fitted in a Pipeline, saved and loaded with it."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spectra import ID, Y, Spectra
from .recipe import FittedRecipe, Step, compile_chain, fit_recipe, from_json, to_json


class _RecipeParams(HasInputCol, HasOutputCol):
    axis = Param(Params._dummy(), "axis", "axis points of the arrays", TypeConverters.toListFloat)
    recipe = Param(Params._dummy(), "recipe", "steps as JSON", TypeConverters.toString)

    def steps(self) -> list[Step]:
        return from_json(self.getOrDefault(self.recipe))


class RecipeEstimator(Estimator, _RecipeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a recipe (and the medians that fill gaps) on the arrays of ``inputCol``."""

    @keyword_only
    def __init__(self, *, axis=None, recipe=None, inputCol=Y, outputCol="processed"):
        super().__init__()
        self._setDefault(inputCol=Y, outputCol="processed")
        self._set(**self._input_kwargs)

    @staticmethod
    def of(axis: Sequence[float], steps: Sequence[Step], **columns: str) -> RecipeEstimator:
        return RecipeEstimator(axis=[float(v) for v in axis], recipe=to_json(steps), **columns)

    def _fit(self, dataset: DataFrame) -> RecipeModel:
        rows = dataset.select(F.monotonically_increasing_id().alias(ID), F.col(self.getInputCol()).alias(Y))
        fitted = fit_recipe(Spectra(rows, np.array(self.getOrDefault(self.axis))), self.steps())
        frozen = {
            "fill": None if fitted.fill is None else list(map(float, fitted.fill)),
            "state": {str(i): [list(map(float, part)) for part in parts] for i, parts in fitted.state.items()},
        }
        model = RecipeModel()
        self._copyValues(model)
        return model._set(frozen=json.dumps(frozen))


class RecipeModel(Model, _RecipeParams, DefaultParamsReadable, DefaultParamsWritable):
    """A recipe with frozen parameters; the whole chain is one column function."""

    frozen = Param(Params._dummy(), "frozen", "fitted parameters as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCol=Y, outputCol="processed")

    def fitted(self) -> FittedRecipe:
        frozen = json.loads(self.getOrDefault(self.frozen))
        fill = None if frozen["fill"] is None else np.array(frozen["fill"])
        state = {int(i): tuple(np.array(part) for part in parts) for i, parts in frozen["state"].items()}
        steps = self.steps()
        chain = compile_chain(np.array(self.getOrDefault(self.axis)), steps, state, fill)
        return FittedRecipe(tuple(steps), state, fill, chain)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self.fitted().chain.column(self.getInputCol()))
