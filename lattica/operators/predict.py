"""Back-off prediction: the deepest class that a node shares with the model and that has enough support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def back_off(labels: DataFrame, classes: DataFrame, fallback: DataFrame, minimum_support: int = 1, value: str = "mean") -> DataFrame:
    """node_id, value, matched_level, class_id, support, variance, threshold_bound for each node of ``labels``.

    Class chains have the prefix property, so one grouped ``max_by`` finds the deepest supported match.  Without one
    the level is -1 and the value that of ``fallback`` (one row of n, mean, msd).  ``threshold_bound``: a deeper
    class matched but lacked support.
    """
    found = labels.select("node_id", "level", "cid").join(classes.select("level", "cid", "n", F.col(value).alias("value"), "msd"), ["level", "cid"], "left")
    return _deepest(found, fallback, F.col("n") >= minimum_support)


def _deepest(found: DataFrame, fallback: DataFrame, enough: Column) -> DataFrame:
    best = F.max_by(F.struct("value", "cid", "n", "msd"), F.when(enough, F.col("level")))
    per = found.groupBy("node_id").agg(
        F.max(F.when(enough, F.col("level"))).alias("level"),
        best.alias("best"),
        F.max(F.when(F.col("n").isNotNull(), F.col("level"))).alias("deepest"),
    )
    whole = fallback.select(F.col("n").alias("gn"), F.col("mean").alias("gmean"), F.col("msd").alias("gmsd"))
    rows = per.crossJoin(F.broadcast(whole))  # one row
    hit = F.col("level").isNotNull()
    n = F.when(hit, F.col("best.n")).otherwise(F.col("gn"))
    msd = F.when(hit, F.col("best.msd")).otherwise(F.col("gmsd"))
    return rows.select(
        "node_id",
        F.when(hit, F.col("best.value")).otherwise(F.col("gmean")).alias("value"),
        F.coalesce("level", F.lit(-1)).alias("matched_level"),
        F.when(hit, F.col("best.cid")).alias("class_id"),
        n.alias("support"),
        F.when(n > 1, msd * n / (n - 1)).alias("variance"),
        (F.coalesce("deepest", F.lit(-1)) > F.coalesce("level", F.lit(-1))).alias("threshold_bound"),
    )


def leave_one_out(labels: DataFrame, classes: DataFrame, targets: DataFrame, fallback: DataFrame, minimum_support: int = 1, y: str = "y") -> DataFrame:
    """As :func:`back_off` on training nodes, each class without the node itself; the fallback keeps it."""
    rows = labels.select("node_id", "level", "cid").join(classes.select("level", "cid", "n", "mean", "msd"), ["level", "cid"])
    rows = rows.join(targets.select("node_id", F.col(y).cast("double").alias("y")), "node_id")
    left = F.col("n") - 1
    rows = rows.where(left > 0).withColumn("value", (F.col("n") * F.col("mean") - F.col("y")) / left).withColumn("n", left)
    nodes = targets.select("node_id").join(rows, "node_id", "left")
    return _deepest(nodes, fallback, F.col("n") >= minimum_support)
