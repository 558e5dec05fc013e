"""A facade for :mod:`pyspark.ml`: the model as an Estimator with tunable support and shrinkage."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml import Model as MLModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame

from lattica import model as core
from lattica.operators.graph import Graph


class _Options(Params):
    minimum_support = Param(Params._dummy(), "minimum_support", "rows that a class needs", TypeConverters.toInt)
    strength = Param(Params._dummy(), "strength", "strength of shrinkage by count; 0: none", TypeConverters.toFloat)

    def options(self) -> dict:
        strength = self.getOrDefault(self.strength)
        return {"minimum_support": self.getOrDefault(self.minimum_support), "shrinkage": "count" if strength else "none", "strength": strength}


class BackOffRegressor(Estimator, _Options):
    """Fits the class tables of the nodes given; their neighbourhoods come from ``edges``."""

    def __init__(self, config: core.Config, edges: DataFrame, minimum_support: int = 1, strength: float = 0.0):
        super().__init__()
        self.config, self.edges = config, edges
        self._setDefault(minimum_support=minimum_support, strength=strength)

    def _fit(self, nodes: DataFrame) -> BackOffModel:
        fitted = BackOffModel(core.Model.fit(self.config, Graph(nodes, self.edges)), self.edges)
        return self._copyValues(fitted)


class BackOffModel(MLModel, _Options):
    """Adds ``prediction`` to nodes."""

    def __init__(self, fitted: core.Model, edges: DataFrame):
        super().__init__()
        self.fitted, self.edges = fitted, edges
        self._setDefault(minimum_support=1, strength=0.0)

    def _transform(self, nodes: DataFrame) -> DataFrame:
        pred = self.fitted.with_params(**self.options()).predict(Graph(nodes, self.edges))
        return nodes.join(pred.selectExpr("node_id", "value AS prediction"), "node_id")
