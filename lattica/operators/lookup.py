"""Lookup baselines: statistics on the nodes of given paths, and on the prefixes of hierarchical codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.stats import merge


def path_stats(rows: DataFrame, path: str, y: str) -> DataFrame:
    """node, n, mean, std of the values below each node of the paths (arrays, root first)."""
    return rows.select(F.explode(path).alias("node"), F.col(y).alias("y")).groupBy("node").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"))


def path_lookup(rows: DataFrame, key: str, path: str, stats: DataFrame, depth: int | None = None) -> DataFrame:
    """The deepest node of each path that has statistics: ``key``, value, depth (missing if none has)."""
    steps = rows.select(key, F.posexplode(path).alias("pos", "node"))
    if depth is not None:
        steps = steps.where(F.col("pos") < depth)
    found = rows.select(key).join(steps.join(stats, "node"), key, "left")
    return found.groupBy(key).agg(F.max_by("mean", "pos").alias("value"), F.max("pos").alias("depth"))


def prefix_sums(rows: DataFrame, code: str, y: str, separator: str, radius: int) -> DataFrame:
    """radius, key, n, mean, msd over the prefixes of 1 to ``radius`` parts; a code of fewer parts counts for those it has."""
    parts = F.split(code, separator)
    steps = rows.select(parts.alias("p"), F.col(y).cast("double").alias("y")).select(F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(radius)))).alias("radius"), "p", "y")
    steps = steps.select("radius", F.array_join(F.slice("p", F.lit(1), F.col("radius")), separator).alias("key"), "y")
    return steps.groupBy("radius", "key").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("msd"))


def merge_sums(parts: list[DataFrame]) -> DataFrame:
    """Statistics by key together; a missing second moment stays missing."""
    return merge(parts, ("radius", "key"))


def prefix_lookup(rows: DataFrame, key: str, code: str, sums: DataFrame, separator: str, radius: int, minimum: int = 1) -> DataFrame:
    """The longest prefix with ``minimum`` rows: ``key``, value, radius; else the mean of all rows, radius 0."""
    parts = F.split(code, separator)
    steps = rows.select(key, parts.alias("p")).select(key, F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(radius)))).alias("radius"), "p")
    steps = steps.select(key, "radius", F.array_join(F.slice("p", F.lit(1), F.col("radius")), separator).alias("prefix"))
    good = sums.where(F.col("n") >= minimum).select("radius", F.col("key").alias("prefix"), "mean")
    found = rows.select(key).join(steps.join(good, ["radius", "prefix"]), key, "left").groupBy(key).agg(F.max_by("mean", "radius").alias("value"), F.max("radius").alias("radius"))
    whole = sums.where("radius = 1").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all"))
    return found.crossJoin(F.broadcast(whole)).select(key, F.coalesce("value", "all").alias("value"), F.coalesce("radius", F.lit(0)).alias("radius"))  # one row


def prefix_classes(sums: DataFrame, separator: str) -> DataFrame:
    """Prefix statistics as class tables: a prefix of k parts is a class of level k - 1 below the prefix of k - 1 parts."""
    parts = F.split("key", separator)
    parent = F.when(F.col("radius") > 1, F.array_join(F.slice(parts, F.lit(1), F.col("radius") - 1), separator))
    return sums.select((F.col("radius") - 1).alias("level"), F.col("key").alias("cid"), parent.alias("parent"), "n", "mean", "msd")


def merge_node_stats(parts: list[DataFrame]) -> DataFrame:
    """node, n, mean, std of several :func:`path_stats` together."""
    rows = [p.select("node", "n", "mean", (F.col("std") * F.col("std")).alias("msd")) for p in parts]
    return merge(rows, ("node",)).select("node", "n", "mean", F.sqrt("msd").alias("std"))


def exact_rows(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``keys`` with their one row of ``table``; a key with none or several is an error."""
    found = table.groupBy(*on).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in table.columns if c not in on))
    out = keys.join(found, on, "left")
    checked = F.when(F.coalesce("_n", F.lit(0)) == 1, True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("not one row for"), *(F.col(c).cast("string") for c in on))).cast("boolean"))
    return out.where(checked).drop("_n")


def digest(rows: DataFrame, ordinal: str, column: str) -> DataFrame:
    """n and digest of a column in its order: differs if a value or its place does; sums need no order of their own."""
    text = F.md5(F.concat_ws("|", F.col(ordinal).cast("string"), F.col(column).cast("string")))
    return rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(text, 1, 8), 16, 10).cast("long")).alias("digest"))
