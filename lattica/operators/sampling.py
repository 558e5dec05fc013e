"""Deterministic folds, partitions and samples, in the order of a hash that other engines can compute, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import order
from lattica.operators.rounds import settle

MULTIPLIER, MODULUS = 2654435761, 1 << 32


def hash_order(key: str | Column, seed: int = 0) -> Column:
    """A multiplicative hash of an integer key: (key + seed) * 2654435761 mod 2^32."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod((F.pmod(k + seed, F.lit(MODULUS)).cast("decimal(20,0)") * F.lit(MULTIPLIER)).cast("decimal(38,0)"), F.lit(MODULUS).cast("decimal(38,0)")).cast("long")


def graph_folds(graphs: DataFrame, key: str, folds: int, seed: int = 0) -> DataFrame:
    """``key``, fold: whole graphs dealt to folds whose sizes differ by one at most."""
    once = graphs.select(key).distinct().withColumn("_hash", hash_order(key, seed))
    placed = order.numbered(once, ["_hash", key], "_place").drop("_hash")
    n = placed.agg(F.count("*").alias("_n"))
    # As ntile: the first n mod folds folds have one graph more.
    small, more, place = F.floor(F.col("_n") / folds), F.col("_n") % folds, F.col("_place")
    fold = F.when(place < more * (small + 1), F.floor(place / (small + 1))).otherwise(more + F.floor((place - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return placed.crossJoin(F.broadcast(n)).select(key, fold.cast("int").alias("fold"))  # one row


def _in_strata(rows: DataFrame, key: str, strata: list[str], seed: int) -> DataFrame:
    """``rows`` with their place ``_place`` in a seeded order of their stratum, and the stratum's size ``_size_of``."""
    return order.numbered_within(rows, strata, [hash_order(key, seed), F.col(key)], "_place", "_size_of")


def partition(rows: DataFrame, key: str, strata: list[str], parts: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``part``: disjoint parts of every stratum, of sizes that differ by one at most."""
    placed = _in_strata(rows, key, strata, seed)
    small, more, place = F.floor(F.col("_size_of") / parts), F.col("_size_of") % parts, F.col("_place")
    part = F.when(place < more * (small + 1), F.floor(place / (small + 1))).otherwise(more + F.floor((place - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return placed.withColumn("part", part.cast("int")).drop("_place", "_size_of")


def stratified_sample(rows: DataFrame, key: str, strata: list[str], share: float, stores: int = 1, seed: int = 0) -> DataFrame:
    """``stores`` disjoint samples with ``share`` of every stratum: the rows that one of them takes, with ``store``."""
    target = F.floor(F.col("_size_of") * F.lit(share) + F.lit(0.5))
    out = _in_strata(rows, key, strata, seed).withColumn("_target", target).where(F.col("_place") < F.col("_target") * stores)
    return out.withColumn("store", F.floor(F.col("_place") / F.col("_target"))).drop("_target", "_place", "_size_of")


def capped(rows: DataFrame, group: list[str], key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each group: the operator's feature, a sample."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(hash_order(key, seed), key))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def by_cumulative_size(rows: DataFrame, by: str, size: str, parts: int) -> DataFrame:
    """``rows`` with ``part``: cut where the running size passes a multiple of its total over ``parts``."""
    out = order.running(rows, [by], size, "_before", "_total")
    return out.withColumn("part", F.least(F.floor(F.col("_before") * parts / F.col("_total")), F.lit(parts - 1))).drop("_before", "_total")


def sequential_fill(clusters: DataFrame, by: list[str], size: str, train: float, val: float) -> DataFrame:
    """``clusters`` with ``split``: in the order ``by`` to train, then val, then test.

    A split ends before the first cluster that would take it past its share of all rows; what is left is test.
    """
    rows = settle(order.running(clusters, by, size, "_before", "_total"))
    total = rows.agg(F.max("_total")).first()[0] or 0
    after = F.col("_before") + F.col(size)
    first = rows.where(after > train * total).agg(F.min("_before")).first()[0]
    if first is None:
        return rows.withColumn("split", F.lit("train")).drop("_before", "_total")
    second = rows.where((F.col("_before") >= first) & (after - first > val * total)).agg(F.min("_before")).first()[0]
    split = F.when(F.col("_before") < first, "train").when(F.lit(second is None) | (F.col("_before") < F.lit(second if second is not None else 0)), "val").otherwise("test")
    return rows.withColumn("split", split).drop("_before", "_total")
