"""Incremental fitting: whole graphs arrive in micro-batches, and their class statistics join those written before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.model import Config, Model
from lattica.operators import stats
from lattica.operators.graph import Graph


def batch_writer(config: Config, path: str, to_graph: Callable[[DataFrame], Graph]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: fits the batch's graphs and writes their statistics under the batch's own number.

    A batch that runs again overwrites its own files, so every batch counts once.  A graph must arrive whole.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        model = Model.fit(config, to_graph(rows))
        model.classes.write.mode("overwrite").parquet(f"{path}/classes/batch={batch}")
        model.whole.write.mode("overwrite").parquet(f"{path}/whole/batch={batch}")
        rows.unpersist()

    return write


def read(spark: SparkSession, config: Config, path: str) -> Model:
    """The model of all batches so far."""
    classes = spark.read.parquet(f"{path}/classes").drop("batch")
    whole = spark.read.parquet(f"{path}/whole").drop("batch").selectExpr("*", "0 AS k")
    return Model(config, stats.merge([classes]), stats.merge([whole], ("k",)).drop("k"))
