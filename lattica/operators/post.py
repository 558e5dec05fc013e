"""Metrics and post-processing of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import order

#: Standard normal quantiles of the central 50, 90, 95 and 99 per cent.
COVERAGE = {50: 0.6744897501960817, 90: 1.6448536269514722, 95: 1.959963984540054, 99: 2.5758293035489004}
#: What a standard deviation that is missing or not positive counts as.
LEAST_STD = 0.1


def errors(pred: str | Column, true: str | Column) -> list[Column]:
    """Aggregates n, mae, rmse, r2, missing over pairs of which neither is missing or NaN."""
    p, t = (F.col(x) if isinstance(x, str) else x for x in (pred, true))
    fine = ~(p.isNull() | t.isNull() | F.isnan(p) | F.isnan(t))
    d = F.when(fine, p - t)
    return [
        F.count(d).alias("n"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        (1 - F.sum(d * d) / (F.count(d) * F.var_pop(F.when(fine, t)))).alias("r2"),
        F.count(F.when(~fine, 1)).alias("missing"),
    ]


def normalise(rows: DataFrame, group: str, x: str, total: str, std: str | None = None, power: int = 0, to: str = "normalised") -> DataFrame:
    """Spread each group's residual (``total`` less the sum of ``x``) over its rows in proportion to ``std`` ** ``power``."""
    w = Window.partitionBy(group)
    share = F.lit(1.0)
    if power:
        s = F.when(F.col(std) > 0, F.col(std)).otherwise(LEAST_STD)
        share = F.pow(s, F.lit(power))
    return rows.withColumn("_share", share).withColumn(to, F.col(x) + (F.col(total) - F.sum(x).over(w)) * F.col("_share") / F.sum("_share").over(w)).drop("_share")


def calibration(error: Column, variance: Column) -> list[Column]:
    """Aggregates nll, z2 and coverage of Gaussian predictions."""
    z2 = error * error / variance
    out = [F.avg(0.5 * (F.log(2 * F.pi() * variance) + z2)).alias("nll"), F.avg(z2).alias("z2")]
    return out + [F.avg((z2 < q * q).cast("double")).alias(f"within_{p}") for p, q in COVERAGE.items()]


def average_rank(rows: DataFrame, group: str, x: str, to: str) -> DataFrame:
    """Rank of ``x`` within its group, ties averaged, over the group's size."""
    ties, rank = Window.partitionBy(group, x), F.rank().over(Window.partitionBy(group).orderBy(x))
    return rows.withColumn(to, (rank + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(Window.partitionBy(group)))


def weighted_quantiles(rows: DataFrame, x: str, weight: str, at: list[float]) -> DataFrame:
    """Weighted quantiles by the midpoints of cumulative weight, with linear interpolation: (q, value).

    Equal values are summed before they are ordered, and only the bracketing rows of each quantile are kept.
    """
    one = rows.groupBy(F.col(x).alias("x")).agg(F.sum(weight).alias("w"))
    points = order.running(one, ["x"], "w", "before", "all").select("x", ((F.col("before") + F.col("w") / 2) / F.col("all")).alias("p"))
    asked = rows.sparkSession.createDataFrame([(float(q),) for q in at], "q double")
    near = points.crossJoin(F.broadcast(asked)).groupBy("q").agg(  # the quantiles asked for
        F.max_by(F.struct("x", "p"), F.when(F.col("p") <= F.col("q"), F.col("p"))).alias("lo"),
        F.min_by(F.struct("x", "p"), F.when(F.col("p") > F.col("q"), F.col("p"))).alias("hi"),
    )
    inside = F.col("lo.x") + (F.col("hi.x") - F.col("lo.x")) * (F.col("q") - F.col("lo.p")) / (F.col("hi.p") - F.col("lo.p"))
    return near.select("q", F.when(F.col("lo").isNull(), F.col("hi.x")).when(F.col("hi").isNull(), F.col("lo.x")).otherwise(inside).alias("value"))


def bundle(columns: dict[str, str], true: str) -> list[Column]:
    """Aggregates rmse and mae of several predictions of one target, named by their prefixes."""
    out = []
    for prefix, column in columns.items():
        d = F.col(column) - F.col(true)
        out += [F.sqrt(F.avg(d * d)).alias(f"{prefix}_rmse"), F.avg(F.abs(d)).alias(f"{prefix}_mae")]
    return out
