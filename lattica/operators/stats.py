"""Class statistics (count, mean, population variance) and their algebra.

Spark's variance aggregate carries count, mean and centred sum of squares, so its partial aggregation is the
merge of models: nothing is ever computed from raw power sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_stats(labels: DataFrame, targets: DataFrame, y: str = "y") -> DataFrame:
    """level, cid, parent, n, mean, msd of each class; ``targets``: node_id and ``y``."""
    rows = labels.join(targets.select("node_id", F.col(y).cast("double").alias("y")), "node_id")
    return rows.groupBy("level", "cid").agg(F.first("parent").alias("parent"), F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("msd"))


def class_stats_vector(labels: DataFrame, targets: DataFrame, y: str = "y") -> DataFrame:
    """As :func:`class_stats` for an array target: a row per class and dimension ``dim``."""
    rows = labels.join(targets.select("node_id", F.posexplode(y).alias("dim", "y")), "node_id")
    return rows.groupBy("level", "cid", "dim").agg(F.first("parent").alias("parent"), F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("msd"))


def global_stats(targets: DataFrame, y: str = "y") -> DataFrame:
    """n, mean, msd of the whole corpus: one row."""
    return targets.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("msd"))


def sample_variance(n: Column, msd: Column) -> Column:
    """Bessel-corrected; missing for a single row."""
    return F.when(n > 1, msd * n / (n - 1))


def combined(parts: Column) -> Column:
    """n, mean, msd of an array of (n, mean, msd) together: the spread of the means about the merged mean, without power sums."""
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["n"])
    mean = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"] * p["mean"]) / total
    whole = F.transform(F.array(F.struct(total.alias("n"), mean.alias("mean"))), lambda t: F.struct(t["n"].alias("n"), t["mean"].alias("mean"), (F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"] * (p["msd"] + (p["mean"] - t["mean"]) * (p["mean"] - t["mean"]))) / t["n"]).alias("msd")))
    return F.when(total > 0, whole[0])


def merge(models: list[DataFrame], keys: tuple[str, ...] = ("level", "cid")) -> DataFrame:
    """Statistics of several corpora together: counts add, moments combine, new classes are appended.

    One grouping: a class has a part from each corpus at most, and the parts are combined where they meet.
    """
    rows = reduce(DataFrame.unionByName, models)
    carried = [c for c in ("parent",) if c in rows.columns and c not in keys]
    parts = rows.groupBy(*keys).agg(*(F.first(c).alias(c) for c in carried), F.collect_list(F.struct("n", "mean", "msd")).alias("_parts"))
    return parts.select(*keys, *carried, combined(F.col("_parts")).alias("_all")).select(*keys, *carried, "_all.*")


def empty_like(stats: DataFrame) -> DataFrame:
    """The identity of :func:`merge`."""
    return stats.limit(0)


def _pair(a: Column, b: Column) -> Column:
    """n, mean, msd of two parts together, either of which may be of no rows."""
    n = a["n"] + b["n"]
    some, gap = n > 0, b["mean"] - a["mean"]
    mean = F.when(some, a["mean"] + gap * b["n"] / n).otherwise(0.0)
    msd = F.when(some, (a["n"] * a["msd"] + b["n"] * b["msd"]) / n + gap * gap * (a["n"] / n) * (b["n"] / n)).otherwise(0.0)
    return F.struct(n.alias("n"), mean.alias("mean"), msd.alias("msd"))


def _scan(parts: Column) -> Column:
    """The parts before each place of an array together, and all of them: one merge for each part."""
    nothing = F.array(F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("msd")))
    return F.aggregate(parts, nothing, lambda seen, p: F.concat(seen, F.array(_pair(F.element_at(seen, -1), p))))


def left_out(parts: DataFrame, keys: list[str], fold: str, folds: DataFrame) -> DataFrame:
    """``keys``, level, cid, parent, n, mean, msd of all of a class's parts but those of one fold, for each fold.

    ``parts``: ``keys``, ``fold``, level, cid, parent, n, mean, msd; any number of parts for a class and fold.  ``folds``: a row for
    each value of ``keys`` (one row without keys) with ``_folds``, an array of all its folds: few, so it is broadcast.  The parts of
    a fold are combined first.  What comes before a fold and what comes after it are scans in both directions, so that k folds
    take 3 k merges for a class, none of them a subtraction.  A class that a fold lacks is whole for it.
    """
    at = [*keys, "level", "cid"]
    placed = parts.repartition(*at)  # both groupings below keep to it
    one = placed.groupBy(*at, fold).agg(F.first("parent").alias("parent"), combined(F.collect_list(F.struct("n", "mean", "msd"))).alias("_part"))
    met = one.groupBy(*at).agg(F.first("parent").alias("parent"), F.array_sort(F.collect_list(F.struct(F.col(fold).alias("f"), F.col("_part").alias("p")))).alias("_all"))
    several = lambda x: F.transform(x, lambda y: y["p"])
    met = met.withColumn("_ahead", _scan(several(F.col("_all")))).withColumn("_behind", F.reverse(_scan(several(F.reverse("_all")))))
    k = F.size("_all")
    zipped = F.arrays_zip(F.transform("_all", lambda y: y["f"]).alias("f"), F.slice("_ahead", F.lit(1), k).alias("a"), F.slice("_behind", F.lit(2), k).alias("b"))
    present = F.transform(zipped, lambda z: F.struct(z["f"].alias("f"), _pair(z["a"], z["b"]).alias("s")))
    met = met.select(*at, "parent", present.alias("_out"), F.transform("_all", lambda y: y["f"]).alias("_had"), F.element_at("_ahead", -1).alias("_sum"))
    met = met.join(F.broadcast(folds), keys) if keys else met.crossJoin(F.broadcast(folds))  # a row for each value of the keys
    absent = F.transform(F.array_except("_folds", "_had"), lambda f: F.struct(f.alias("f"), F.col("_sum").alias("s")))
    rows = met.select(*at, "parent", F.explode(F.concat("_out", absent)).alias("_r")).where("_r.s.n > 0")
    return rows.select(*keys, F.col("_r.f").alias(fold), "level", "cid", "parent", "_r.s.*")


def leave_one_group_out(parts: DataFrame, group: str, groups: DataFrame) -> DataFrame:
    """fold, level, cid, parent, n, mean, msd of all groups but ``fold``, for each of ``groups`` (a table of group values): one job.

    ``parts``: class statistics with a column ``group``; see :func:`left_out`.
    """
    kind = parts.schema[group].dataType
    folds = groups.agg(F.collect_set(F.col(group).cast(kind)).alias("_folds"))  # one row: the folds are a handful
    return left_out(parts, [], group, folds).withColumnRenamed(group, "fold")


def truncate(stats: DataFrame, level: int) -> DataFrame:
    """A model without the levels beyond ``level``."""
    return stats.where(F.col("level") <= level)
