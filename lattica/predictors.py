"""Predictors by name: what can be fitted on labelled nodes and asked for a value of others."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import model
from lattica.operators import lookup, stats
from lattica.operators.graph import Graph


class Predictor(Protocol):
    def fit(self, nodes: DataFrame, edges: DataFrame) -> Predictor: ...

    def predict(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """node_id and value, a row for every node."""


class GlobalMean:
    """The mean of all targets."""

    def fit(self, nodes: DataFrame, edges: DataFrame) -> GlobalMean:
        self.whole = stats.global_stats(nodes)
        return self

    def predict(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return nodes.select("node_id").crossJoin(F.broadcast(self.whole.select(F.col("mean").alias("value"))))  # one row


class BackOff:
    """The deepest class with enough support."""

    def __init__(self, levels: tuple[str, ...], depth: int, **options):
        self.config = model.Config(tuple(levels), depth, **options)

    def fit(self, nodes: DataFrame, edges: DataFrame) -> BackOff:
        self.model = model.Model.fit(self.config, Graph(nodes, edges))
        return self

    def predict_raw(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """All that is known of each prediction: level, class, support, variance."""
        return self.model.predict(Graph(nodes, edges))

    def predict(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return self.predict_raw(nodes, edges).select("node_id", "value")


class Prefix:
    """The longest prefix of a node's code with enough rows."""

    def __init__(self, code: str, separator: str, radius: int, minimum: int = 1):
        self.code, self.separator, self.radius, self.minimum = code, separator, radius, minimum

    def fit(self, nodes: DataFrame, edges: DataFrame) -> Prefix:
        self.sums = lookup.prefix_sums(nodes, self.code, "y", self.separator, self.radius)
        return self

    def predict(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return lookup.prefix_lookup(nodes, "node_id", self.code, self.sums, self.separator, self.radius, self.minimum).select("node_id", "value")


REGISTRY: dict[str, Callable[..., Predictor]] = {"global_mean": GlobalMean, "back_off": BackOff, "prefix": Prefix}


def register(name: str, builder: Callable[..., Predictor]) -> None:
    """Add a predictor; a name that is taken is an error."""
    if name in REGISTRY:
        raise ValueError(f"{name} is taken")
    REGISTRY[name] = builder


def build(name: str, **options) -> Predictor:
    if name not in REGISTRY:
        raise ValueError(f"no predictor {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**options)
