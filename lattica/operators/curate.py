"""Curation: geometry flags, reasons for removal, successive generations, robust fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import order
from lattica.operators.rounds import discard, settle

#: Bond length, 1-3 contact and longer contact as ratios of the sum of radii.
LONG_BOND, CLOSE_13, CLOSE = 1.25, 1.05, 1.15


def contact_flags(atoms: DataFrame, hops: DataFrame, group: str = "graph_id") -> DataFrame:
    """For each group: the largest bond ratio, the least 1-3 and longer contact ratios, and whether one is out of range.

    ``atoms``: ``group``, node_id, x, y, z, radius.  ``hops``: a, b, hops for pairs a < b at most 3 edges apart.
    """
    a = atoms.select(group, F.col("node_id").alias("a"), *(F.col(c).alias(f"{c}a") for c in ("x", "y", "z", "radius")))
    b = atoms.select(group, F.col("node_id").alias("b"), *(F.col(c).alias(f"{c}b") for c in ("x", "y", "z", "radius")))
    pairs = a.join(b, group).where("a < b").join(hops, ["a", "b"], "left")
    d = F.sqrt(sum(((F.col(f"{c}a") - F.col(f"{c}b")) ** 2 for c in "xyz"), F.lit(0.0)))
    ratio = d / (F.col("radiusa") + F.col("radiusb"))
    far = F.coalesce("hops", F.lit(99))
    out = pairs.groupBy(group).agg(F.max(F.when(far == 1, ratio)).alias("bond"), F.min(F.when(far == 2, ratio)).alias("contact_13"), F.min(F.when(far >= 3, ratio)).alias("contact"))
    bad = F.coalesce(F.col("bond") > LONG_BOND, F.lit(False)) | F.coalesce(F.col("contact_13") < CLOSE_13, F.lit(False)) | F.coalesce(F.col("contact") < CLOSE, F.lit(False))
    return out.withColumn("geometry", bad)


def first_reason(reasons: dict[str, Column]) -> Column:
    """The name of the first condition that holds, else the empty text."""
    out = None
    for name, condition in reasons.items():
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return F.lit("") if out is None else out.otherwise(F.lit(""))


def reason_counts(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """reason, raised, removed: how often each condition holds, and for how many rows it is the first."""
    marked = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("reason"), F.coalesce(c, F.lit(False)).alias("raised"), (first_reason(reasons) == n).alias("removed")) for n, c in reasons.items()))).alias("r"))
    return marked.groupBy("r.reason").agg(F.count(F.when(F.col("r.raised"), 1)).alias("raised"), F.count(F.when(F.col("r.removed"), 1)).alias("removed"))


def generations(rows: DataFrame, key: str, step: str, value: str, apart: int) -> DataFrame:
    """Rows joined with those of their key ``apart`` steps later: key, step, parent, child, and whether the child is lower."""
    child = rows.select(key, (F.col(step) - apart).alias(step), F.col(value).alias("child"))
    return rows.select(key, step, F.col(value).alias("parent")).join(child, [key, step]).withColumn("lower", F.col("child") < F.col("parent"))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def robust_line(rows: DataFrame, group: str, x: str, y: str, rounds: int = 4, width: float = 4.0) -> DataFrame:
    """group, slope, intercept, n_used: least squares, refitted without rows beyond ``width`` robust deviations of the residuals.

    The spread is 1.4826 times the median absolute residual of the rows used before.
    """
    used, fit = rows.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), None
    for k in range(rounds):
        slope = F.covar_pop("x", "y") / F.var_pop("x")
        fit = settle(used.groupBy("g").agg(slope.alias("slope"), (F.avg("y") - slope * F.avg("x")).alias("intercept"), F.count("*").alias("n_used")))
        if k + 1 < rounds:
            off = used.join(fit, "g").select("g", "x", "y", F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")).alias("off"))
            middle = settle(order.group_quantiles(off, "g", "off", 0.5))
            before, used = used, settle(off.join(middle, "g").where(F.col("off") <= width * 1.4826 * F.col("quantile")).select("g", "x", "y"))
            if k:
                discard(before)
    return fit.withColumnRenamed("g", group)


def residual_scores(rows: DataFrame, fit: DataFrame, group: str, x: str, y: str, record: str) -> DataFrame:
    """``record``, n, rms of residuals from each group's line, over 1.4826 times the group's median absolute residual (of two middle ones the lower)."""
    off = rows.join(fit, group).withColumn("_off", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))
    middle = settle(order.group_quantiles(off.withColumn("_abs", F.abs("_off")), group, "_abs", 0.5, discrete=True))
    z = F.col("_off") / (1.4826 * F.col("quantile"))
    return off.join(middle, group, "left").groupBy(record).agg(F.count("*").alias("n"), F.sqrt(F.avg(z * z)).alias("rms"))


def text_ordinals(rows: DataFrame, group: str, index: str, to: str) -> DataFrame:
    """``rows`` with the place of ``index`` among its group's indexes in the order of their texts."""
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(group).orderBy(F.col(index).cast("string"))) - 1)


def stale(runs: DataFrame, sidecars: DataFrame, key: str, made: str, of: str) -> DataFrame:
    """Runs without a complete sidecar that is as new as they are: ``key``, and whether it is missing."""
    newest = sidecars.groupBy(key).agg(F.max(of).alias("_of"))
    return runs.join(newest, key, "left").where(F.col("_of").isNull() | (F.col("_of") < F.col(made))).select(key, F.col("_of").isNull().alias("missing"))


def verdict(perceived: Column, reported: Column) -> Column:
    """How two sets of elements compare: same, fewer, more, other, or none on both sides."""
    only_p, only_r = F.size(F.array_except(perceived, reported)), F.size(F.array_except(reported, perceived))
    return F.when((F.size(perceived) == 0) & (F.size(reported) == 0), "none").when((only_p == 0) & (only_r == 0), "same").when(only_p == 0, "fewer").when(only_r == 0, "more").otherwise("other")
