"""Row numbers and running sums over a whole table, in range partitions: no task sees more than its range.

Ranges are written before they are used twice, so that both uses see the same.  Exact quantiles of groups, by counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.rounds import settle

#: Rows of a group that are sorted to end a search for its quantile; sketched cuts of a group; rounds that look for cuts.
FEW_ROWS, CUTS, MOST_ROUNDS = 1 << 18, 256, 8


def _ranged(rows: DataFrame, by: list[str | Column], weight: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their range ``_range``, and what each range has of ``weight`` before it: a row per range."""
    out = settle(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    sums = out.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")  # a row per range
    return out, sums.select("_range", before.alias("_ahead"), F.sum("_sum").over(Window.partitionBy()).alias("_whole"))


def numbered(rows: DataFrame, by: list[str | Column], to: str) -> DataFrame:
    """``rows`` with their place, from 0 on, in the order ``by``, which must tell rows apart."""
    out, offsets = _ranged(rows, by, F.lit(1).cast("long"))
    out = out.withColumn(to, F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1)
    return out.join(F.broadcast(offsets), "_range").withColumn(to, F.col(to) + F.col("_ahead")).drop("_range", "_ahead", "_whole")


def running(rows: DataFrame, by: list[str | Column], weight: str, before: str, total: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the rows before each in the order ``by``, and over all."""
    out, offsets = _ranged(rows, by, F.col(weight))
    frame = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)  # by rows: those with equal keys don't count each other
    inside = F.coalesce(F.sum(weight).over(frame), F.lit(0))
    out = out.withColumn(before, inside).join(F.broadcast(offsets), "_range")
    return out.withColumn(before, F.col(before) + F.col("_ahead")).withColumnRenamed("_whole", total).drop("_range", "_ahead")


def numbered_within(rows: DataFrame, groups: list[str], by: list[str | Column], to: str, size: str | None = None) -> DataFrame:
    """``rows`` with their place in their group, from 0 on, in the order ``by``, and the group's ``size``.

    Rows are numbered over all groups in range partitions, and a group's first number is taken away, so a group
    with most of the rows is no task of its own.  Null is a group like others.
    """
    same = F.struct(*(F.col(c) for c in groups)) if groups else F.struct(F.lit(0).alias("all"))
    out = settle(numbered(rows.withColumn("_group", same), ["_group", *by], to))
    sizes = out.groupBy("_group").agg(F.min(to).alias("_first"), F.count("*").alias("_size"))
    out = out.join(sizes, "_group").withColumn(to, F.col(to) - F.col("_first"))
    return (out.withColumn(size, F.col("_size")) if size else out).drop("_group", "_first", "_size")


def group_quantiles(rows: DataFrame, group: str, value: str, share: float, discrete: bool = False) -> DataFrame:
    """``group``, quantile: exactly the value at ``share`` of each group's rows in order; between two values by their distance, or ``discrete``.

    A group's values are never held at once.  A small sketch proposes two cuts around the wanted place, counts prove between
    which ends it is, and this repeats until few rows are between them; only those are grouped by value and added up in order.
    Rows without a group or a value don't count.  ``rows`` are read a few times.
    """
    data = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    place = F.greatest(F.ceil(F.col("n") * share) - 1, F.lit(0)).cast("double") if discrete else (F.col("n") - 1) * F.lit(share)
    now = data.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("place", place)
    now = settle(now.select("g", "place", F.floor("place").alias("r0"), F.ceil("place").alias("r1"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    between = lambda bounds: data.join(bounds, "g").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    for _ in range(MOST_ROUNDS):
        wide = (F.col("inside") > FEW_ROWS) & (F.col("lo") < F.col("hi"))
        if not now.where(wide).limit(1).count():
            break
        some = between(now.where(wide).select("g", "lo", "hi"))
        cuts = some.groupBy("g").agg(F.percentile_approx("v", [k / CUTS for k in range(CUTS + 1)], 20 * CUTS).alias("cuts"))
        at = lambda r, by: F.greatest(F.lit(1), F.least(F.lit(CUTS + 1), F.floor((F.col(r) - F.col("below")) * CUTS / F.col("inside")).cast("int") + 1 + by))
        cut = settle(cuts.join(now, "g").select("g", "lo", "hi", F.element_at("cuts", at("r0", -1)).alias("c0"), F.element_at("cuts", at("r1", 2)).alias("c1")))
        tally = lambda c: F.count(F.when(c, 1))
        v = F.col("v")
        counts = between(cut).groupBy("g").agg(tally(v < F.col("c0")).alias("lt0"), tally(v <= F.col("c0")).alias("le0"), tally(v < F.col("c1")).alias("lt1"), tally(v <= F.col("c1")).alias("le1"))
        got = now.join(cut.select("g", "c0", "c1"), "g", "left").join(counts, "g", "left")
        r0, r1 = (F.col(r) - F.col("below") for r in ("r0", "r1"))
        low = lambda a, b, c: F.when(F.col("c0").isNull() | (r0 < F.col("lt0")), a).when(r0 < F.col("le1"), b).otherwise(c)
        high = lambda a, b, c: F.when(F.col("c0").isNull() | (r1 >= F.col("le1")), a).when(r1 >= F.col("le0"), b).otherwise(c)
        under = low(F.lit(0).cast("long"), F.col("lt0"), F.col("lt1"))
        upto = high(F.col("inside"), F.col("le1"), F.col("le0"))
        now = settle(got.select("g", "place", "r0", "r1", low(F.col("lo"), F.col("c0"), F.col("c1")).alias("lo"), high(F.col("hi"), F.col("c1"), F.col("c0")).alias("hi"), (F.col("below") + under).alias("below"), (upto - under).alias("inside")))
    some = between(now.select("g", "lo", "hi")).groupBy("g", "v").agg(F.count("*").alias("k"))
    last = F.sum("k").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = some.withColumn("last", last).join(now.select("g", "place", "r0", "r1", "below"), "g").withColumn("last", F.col("last") + F.col("below"))
    ends = found.groupBy("g").agg(*(F.min(F.when(F.col("last") > F.col(r), F.col("v"))).alias(f"v{k}") for k, r in enumerate(("r0", "r1"))), F.max(F.col("place") - F.col("r0")).alias("part"))
    return ends.select(F.col("g").alias(group), F.when(F.col("part") > 0, F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")).otherwise(F.col("v0")).alias("quantile"))
