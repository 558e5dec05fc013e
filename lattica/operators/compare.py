"""Comparing methods over shared cross-validation samples: (method, repeat, fold, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import distributions as dist
from lattica.operators import order
from lattica.operators.rounds import settle


def unmatched(scores: DataFrame) -> DataFrame:
    """(method, repeat, fold) that some other method has and this one lacks: none, if samples can be paired."""
    methods, samples = scores.select("method").distinct(), scores.select("repeat", "fold").distinct()
    return samples.crossJoin(F.broadcast(methods)).join(scores, ["method", "repeat", "fold"], "left_anti").select("method", "repeat", "fold")  # methods are a handful


def sums_of_squares(scores: DataFrame) -> DataFrame:
    """Repeated-measures sums of squares, one row: k methods, n subjects, ss_method, ss_subject, ss_error."""
    grand = scores.agg(F.avg("value").alias("g"), F.count("*").alias("cells"), (F.var_pop("value") * F.count("*")).alias("ss_total"))
    by = lambda keys, name: scores.groupBy(*keys).agg(F.avg("value").alias("m"), F.count("*").alias("c")).agg(F.count("*").alias(name), (F.var_pop("m") * F.sum("c")).alias(f"ss_{name}"))
    rows = grand.crossJoin(by(["method"], "method")).crossJoin(by(["repeat", "fold"], "subject"))  # one row each
    return rows.select(F.col("method").alias("k"), F.col("subject").alias("n"), "ss_method", "ss_subject", (F.col("ss_total") - F.col("ss_method") - F.col("ss_subject")).alias("ss_error"))


def anova(scores: DataFrame) -> dict[str, float]:
    """F and its tail; F is infinite when the error alone has no spread, NaN when the methods have none either."""
    r = sums_of_squares(scores).first()
    df1, df2 = r["k"] - 1, (r["k"] - 1) * (r["n"] - 1)
    ms, me = r["ss_method"] / df1, max(0.0, r["ss_error"]) / df2
    f = ms / me if me > 0 else (math.inf if ms > 0 else math.nan)
    return {"f": f, "df1": df1, "df2": df2, "mse": me, "p": dist.f_tail(f, df1, df2) if not math.isnan(f) else math.nan}


def tukey(scores: DataFrame, level: float = 0.95) -> list[dict]:
    """All pairs of methods: difference of means, studentized-range p, and simultaneous interval."""
    a = anova(scores)
    means = {r["method"]: (r["m"], r["n"]) for r in scores.groupBy("method").agg(F.avg("value").alias("m"), F.count("*").alias("n")).collect()}  # a row per method
    k, out = len(means), []
    q = dist.studentized_range_quantile(level, k, a["df2"])
    names = sorted(means)
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            d, se = means[x][0] - means[y][0], math.sqrt(a["mse"] / means[x][1])
            p = 1 - dist.studentized_range_cdf(abs(d) / se, k, a["df2"]) if se else float(d == 0)
            out.append({"a": x, "b": y, "difference": d, "p": p, "low": d - q * se, "high": d + q * se})
    return out


def simultaneous_intervals(scores: DataFrame, level: float = 0.95) -> list[dict]:
    """Hochberg-Tamhane intervals: methods whose intervals do not overlap differ."""
    a = anova(scores)
    rows = scores.groupBy("method").agg(F.avg("value").alias("m"), F.count("*").alias("n")).orderBy("method").collect()  # a row per method
    q = dist.studentized_range_quantile(level, len(rows), a["df2"])
    return [{"method": r["method"], "mean": r["m"], "low": r["m"] - q / 2 * math.sqrt(a["mse"] / r["n"]), "high": r["m"] + q / 2 * math.sqrt(a["mse"] / r["n"])} for r in rows]


def corrected_se(values: DataFrame, group: list[str], ratio: float) -> DataFrame:
    """Mean and corrected resampled standard error sqrt((1 / k + n_test / n_train) s^2) of each group's k values."""
    return values.groupBy(*group).agg(F.count("*").alias("k"), F.avg("value").alias("mean"), F.sqrt((1 / F.count("*") + ratio) * F.var_samp("value")).alias("se"))


def paired_difference(scores: DataFrame, a: str, b: str, ratio: float) -> DataFrame:
    """Mean of a - b over shared samples, its corrected error, and how often a is smaller: one row."""
    x = scores.where(F.col("method") == a).select("repeat", "fold", F.col("value").alias("x"))
    y = scores.where(F.col("method") == b).select("repeat", "fold", F.col("value").alias("y"))
    d = F.col("x") - F.col("y")
    return x.join(y, ["repeat", "fold"]).agg(F.count("*").alias("k"), F.avg(d).alias("mean"), F.sqrt((1 / F.count("*") + ratio) * F.var_samp(d)).alias("se"), F.count(F.when(d < 0, 1)).alias("wins"))


def curve(scores: DataFrame, folds: int) -> DataFrame:
    """depth, mean, low, high, std over folds; depths that lack a fold are dropped."""
    out = scores.groupBy("depth").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
    return out.where(F.col("n") == folds)


def select_depth(curve_: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """The shallowest depth within ``tolerance`` of the best mean: one row."""
    best = curve_.agg(F.min("mean").alias("best"))
    return curve_.crossJoin(F.broadcast(best)).where(F.col("mean") <= F.col("best") * (1 + tolerance)).agg(F.min("depth").alias("depth"))  # one row


def interval(k: int, mean: float, se: float, level: float = 0.95) -> tuple[float, float]:
    """The t interval of a mean over ``k`` samples with the (corrected) error ``se``."""
    q = dist.t_quantile(0.5 + level / 2, k - 1)
    return mean - q * se, mean + q * se


def best_value(curve_: DataFrame, larger: bool = False) -> DataFrame:
    """The best mean over depths, and the shallowest depth that has it: one row."""
    key = F.struct((F.col("mean") if larger else -F.col("mean")).alias("m"), (-F.col("depth")).alias("d"))
    return curve_.agg(F.max_by("mean", key).alias("mean"), F.max_by("depth", key).alias("depth"))


def axis_order(labels: DataFrame, label: str) -> DataFrame:
    """``label`` and its place: by number if all labels are numbers, else by text."""
    once = labels.select(label).distinct().withColumn("_x", F.expr(f"try_cast(`{label}` AS double)"))
    text = once.agg(F.max(F.col("_x").isNull().cast("int")).alias("_text"))
    placed = once.crossJoin(F.broadcast(text)).withColumn("_key", F.when(F.col("_text") == 0, F.col("_x")))  # one row
    return order.numbered(settle(placed), [F.col("_key"), F.col(label)], "place").select(label, "place")
