"""Cross-validation from one fit: shards are fitted once, fold models are merges of the shards that they train on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import sampling
from lattica.operators.rounds import settle
from lattica.operators.stats import left_out
from lattica.sources import stores


@dataclass(frozen=True)
class Variant:
    """How fold models are read: by what name, and with how many rows of support."""

    name: str
    minimum_support: int = 1


def plan(shards: DataFrame, folds: int, repeats: int) -> DataFrame:
    """repeat, fold, shard: for each repeat the shards in another order, cut into folds of about equal number."""
    out = None
    for k in range(repeats):
        one = sampling.graph_folds(shards.select("shard"), "shard", folds, k).select(F.lit(k).alias("repeat"), "fold", "shard")
        out = one if out is None else out.unionAll(one)
    return out


def fit_shards(rows: DataFrame) -> DataFrame:
    """Class statistics of each shard, from rows (shard, level, cid, parent, y)."""
    return rows.groupBy("shard", "level", "cid").agg(F.first("parent").alias("parent"), F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("msd"))


def fold_models(parts: DataFrame, plan_: DataFrame) -> DataFrame:
    """repeat, fold, level, cid, parent, n, mean, msd: of every fold the classes of all shards that it doesn't hold out.

    ``plan_``: repeat, fold, shard; a row for each shard and repeat, so it is broadcast.  Shards become folds' parts first; see
    :func:`lattica.operators.stats.left_out`.
    """
    folds = plan_.groupBy("repeat").agg(F.collect_set("fold").alias("_folds"))
    return left_out(parts.join(F.broadcast(plan_), "shard"), ["repeat"], "fold", folds)


def floors(rows: DataFrame, outer: list[str], inner: list[str], y: str, shard: str) -> DataFrame:
    """shard, n, sse, sse_outer: squared deviations from the means of two nested groupings, ``inner`` within ``outer``; additive over shards.

    Rows become a part for each group and shard in one pass; both means are merges of such parts.  Rows whose ``y`` is null take no part,
    null keys are keys like others, also in joins.
    """
    keys = [*outer, *(c for c in inner if c not in outer)]
    parts = settle(rows.where(F.col(y).isNotNull()).groupBy(*keys, shard).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("msd")))
    out = parts.withColumn("_i", F.struct(*keys))
    out = out.withColumn("_o", F.struct(*outer))
    mean = lambda at, to: out.groupBy(at).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias(to))
    out = out.join(mean("_i", "_mi"), "_i").join(mean("_o", "_mo"), "_o")
    about = lambda m: F.sum(F.col("n") * (F.col("msd") + (F.col("mean") - F.col(m)) * (F.col("mean") - F.col(m))))
    return out.groupBy(F.col(shard).alias("shard")).agg(F.sum("n").alias("n"), about("_mi").alias("sse"), about("_mo").alias("sse_outer"))


def training_floors(floors_: DataFrame, plan_: DataFrame) -> DataFrame:
    """repeat, fold, n, sse, sse_outer, within, within_outer: floors of the shards that a fold trains on, the variance within structures of its model.

    A plan has a row for each shard and repeat; folds' sums are met with one another, not subtracted from a total.
    """
    per = plan_.join(floors_, "shard").groupBy("repeat", "fold").agg(*(F.sum(c).alias(c) for c in ("n", "sse", "sse_outer")))
    others = F.filter("_all", lambda p: p["fold"] != F.col("fold"))
    met = per.groupBy("repeat").agg(F.collect_list(F.struct("fold", "n", "sse", "sse_outer")).alias("_all"))  # folds: a handful
    rows = plan_.select("repeat", "fold").distinct().join(met, "repeat").withColumn("_all", others)
    total = lambda c, zero: F.aggregate("_all", zero, lambda s, p: s + p[c])
    rows = rows.select("repeat", "fold", total("n", F.lit(0).cast("long")).alias("n"), *(total(c, F.lit(0.0)).alias(c) for c in ("sse", "sse_outer")))
    some = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    return rows.withColumn("within", some("sse")).withColumn("within_outer", some("sse_outer"))


def _rounded(parts: DataFrame) -> DataFrame:
    return parts.withColumns({c: F.format_string("%.9e", c) for c in ("mean", "msd")})


def _digest(table: DataFrame) -> str:
    """Rows and the sum of their hashes: the same for the same rows in any order."""
    n, total = table.agg(F.count("*"), F.sum(F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)"))).first()
    return f"{n}:{total}"


def run(rows: DataFrame, folds: int, repeats: int, depths: Sequence[int], variants: Sequence[Variant], cache: str | None = None) -> DataFrame:
    """variant, depth, repeat, fold, n, rmse, mae of held-out rows; ``rows``: node_id, shard, level, cid, parent, y, a row per level.

    With ``cache`` the fold models are written there once and read again by a later run over the same shard fits and plan;
    other fits or another plan there are an error.  Sums of floats may differ in a last digit from run to run, so digests
    are taken of means and variances rounded to nine digits.
    """
    spark = rows.sparkSession
    parts = settle(fit_shards(rows))
    plan_ = settle(plan(parts.select("shard").distinct(), folds, repeats))
    held = plan_.groupBy("repeat", "fold").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    models = stores.cached(spark, cache, {"folds": folds, "repeats": repeats, "plan": _digest(plan_), "parts": _digest(_rounded(parts))}, lambda: fold_models(parts, plan_)) if cache else settle(fold_models(parts, plan_))
    totals = parts.where("level = 0").groupBy("shard").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    outside = held.crossJoin(totals).where(~F.array_contains("shards", F.col("shard")))  # a row per shard and fold
    whole = outside.groupBy("repeat", "fold").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("whole"))
    asked = rows.select("node_id", "shard", "level", "cid", "y").join(F.broadcast(plan_), "shard")
    found = asked.join(models.select("repeat", "fold", "level", "cid", "n", "mean"), ["repeat", "fold", "level", "cid"], "left")
    arms = [(v, d) for v in variants for d in depths]
    best = [F.max_by("mean", F.when((F.col("level") <= d) & (F.col("n") >= v.minimum_support), F.col("level"))).alias(f"p{i}") for i, (v, d) in enumerate(arms)]
    pred = found.groupBy("repeat", "fold", "node_id").agg(F.first("y").alias("y"), *best).join(F.broadcast(whole), ["repeat", "fold"])
    sums = []
    for i in range(len(arms)):
        e = F.coalesce(f"p{i}", "whole") - F.col("y")
        sums.append(F.struct(F.lit(arms[i][0].name).alias("variant"), F.lit(arms[i][1]).alias("depth"), F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")).alias(f"a{i}"))
    out = pred.groupBy("repeat", "fold").agg(*sums)
    return out.select("repeat", "fold", F.explode(F.array(*(f"a{i}" for i in range(len(arms))))).alias("a")).select("a.variant", "a.depth", "repeat", "fold", "a.n", "a.rmse", "a.mae")
