"""Equivalence groups of rows: floors, representatives, isolated values, pairs, triangles, and the copy rule."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.rounds import settle


def group_counts(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """``rows`` with n_rows and n_members (distinct) of their group."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct(member).alias("n_members"))
    return rows.join(sizes, keys)


def floor(rows: DataFrame, group: list[str], y: str, shard: str | Column) -> DataFrame:
    """shard, sse, n of the deviations from the group means: additive, the error that no model of the group key can avoid."""
    shard = F.col(shard) if isinstance(shard, str) else shard
    means = rows.groupBy(*group).agg(F.avg(y).alias("_mean"))
    d = F.col(y) - F.col("_mean")
    return rows.join(means, group).groupBy(shard.alias("shard")).agg(F.sum(d * d).alias("sse"), F.count("*").alias("n"))


def representatives(rows: DataFrame, group: list[str], order: list[str], y: str) -> DataFrame:
    """The first row of each group with the group's mean as target, and n, sse of the values that it stands for."""
    best = rows.groupBy(*group).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r"), F.avg(y).alias("target"), (F.var_pop(y) * F.count(y)).alias("within_sse"), F.count(y).alias("within_n"))
    return best.select("r.*", "target", "within_sse", "within_n")


def isolated(rows: DataFrame, group: list[str], y: str, threshold: float) -> DataFrame:
    """``rows`` with ``isolated``: the nearest other value of the group is ``threshold`` away at least; a single value isn't."""
    w = Window.partitionBy(*group).orderBy(y)
    gap = F.least(F.col(y) - F.lag(y).over(w), F.lead(y).over(w) - F.col(y))
    return rows.withColumn("isolated", F.coalesce(gap >= threshold, F.lit(False)))


def pairs(rows: DataFrame, key: str, row: str, value: str, most: int | None = None, order: Column | None = None) -> DataFrame:
    """Unordered pairs of rows of one key with the distance of their values: key, a, b, d; at most ``most`` for each key, in ``order``."""
    a = rows.select(key, F.col(row).alias("a"), F.col(value).alias("va"))
    b = rows.select(key, F.col(row).alias("b"), F.col(value).alias("vb"))
    out = a.join(b, key).where("a < b").select(key, "a", "b", F.abs(F.col("va") - F.col("vb")).alias("d"))
    if most is None:
        return out
    number = F.row_number().over(Window.partitionBy(key).orderBy(order if order is not None else F.xxhash64("a", "b"), "a", "b"))
    return out.withColumn("_n", number).where(F.col("_n") <= most).drop("_n")


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles a < b < c of an edge list (a, b, d), with sorted sides d1 <= d2 <= d3."""
    e = edges.select("a", "b", "d")
    ab, bc, ac = (e.select(F.col("a").alias(x), F.col("b").alias(y), F.col("d").alias(f"d_{x}{y}")) for x, y in ("ab", "bc", "ac"))
    out = ab.join(bc, "b").join(ac, ["a", "c"])
    return out.select("a", "b", "c", F.sort_array(F.array("d_ab", "d_bc", "d_ac")).alias("s")).select("a", "b", "c", F.col("s")[0].alias("d1"), F.col("s")[1].alias("d2"), F.col("s")[2].alias("d3"))


#: Edges of a block of :func:`shortest_sides`, about; paths of two edges that a task looks at together.
BLOCK_EDGES, STEP_PATHS = 1 << 17, 1 << 20


def shortest_sides(edges: DataFrame) -> DataFrame:
    """d1, n: how many triangles of an edge list (a, b, d), each edge once, have that shortest side.

    No path of two edges is ever a row: nodes have colours, the edges between two colours are a packed block, and for each
    three colours a task looks through their three blocks.  A task holds three blocks; the least colours take turns, so the
    blocks that meet at a time take the room of three copies of the edges, about, and are deleted then.
    """
    spark = edges.sparkSession
    e = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), F.col("d").cast("double").alias("d"))
    colours = math.ceil(math.sqrt(2 * e.count() / BLOCK_EDGES)) or 1
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(colours)).cast("int")
    e = e.withColumn("i", colour("a")).withColumn("j", colour("b"))
    turned = F.col("i") > F.col("j")
    end = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    blocks = e.select(end("i", "j"), end("j", "i"), end("a", "b"), end("b", "a"), "d").groupBy("i", "j").applyInArrow(_packed, "i int, j int, edges binary")
    blocks = settle(blocks, True)
    side = lambda x, y: blocks.select(F.col("i").alias(x), F.col("j").alias(y), F.col("edges").alias(x + y))
    out = None
    for least in range(colours):
        three = side("x", "y").where(F.col("x") == least).join(side("y", "z"), "y").join(side("x", "z").where(F.col("x") == least), ["x", "z"])
        spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (colours - least) * (colours - least + 1) // 4)
        found = three.select("y", "z", "xy", "yz", "xz").repartition(spread, "y", "z").mapInArrow(_closed, "d1 double, n long")
        found = settle(found.groupBy("d1").agg(F.sum("n").alias("n")), True)
        out = found if out is None else out.unionAll(found)
    return out.groupBy("d1").agg(F.sum("n").alias("n"))


def _packed(block: pa.Table) -> pa.Table:
    a, b, d = (block.column(c).to_numpy() for c in "abd")
    return pa.table({"i": block.column("i")[:1], "j": block.column("j")[:1], "edges": pa.array([np.concatenate((a, b, d.view(np.int64))).tobytes()], pa.binary())})


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d1 and n of the triangles of each row's three blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            (x, y, d_xy), (y2, z, d_yz), (x2, z2, d_xz) = ((e[0], e[1], e[2].view(np.float64)) for e in (np.frombuffer(batch.column(c)[k].as_py(), np.int64).reshape(3, -1) for c in ("xy", "yz", "xz")))
            xs, zs = np.unique(x2), np.unique(z2)
            keys = np.searchsorted(xs, x2) * len(zs) + np.searchsorted(zs, z2)
            by = np.argsort(keys)
            keys, d_xz = keys[by], d_xz[by]
            known = np.isin(z, zs)  # only what can close
            y2, z, d_yz = y2[known], np.searchsorted(zs, z[known]), d_yz[known]
            by = np.argsort(y2, kind="stable")
            y2, z, d_yz = y2[by], z[by], d_yz[by]
            known = np.isin(x, xs)
            x, y, d_xy = np.searchsorted(xs, x[known]), y[known], d_xy[known]
            low = np.searchsorted(y2, y)
            many = np.searchsorted(y2, y, "right") - low
            ends = np.cumsum(many)
            start = 0
            while start < len(x):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP_PATHS, "right")))
                times = many[start:stop]
                first = np.repeat(np.arange(start, stop), times)
                second = np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[start:stop], times)
                key = x[first] * len(zs) + z[second]
                at = np.searchsorted(keys, key)
                hit = at < len(keys)
                hit[hit] = keys[at[hit]] == key[hit]
                if hit.any():
                    d1, n = np.unique(np.minimum(np.minimum(d_xy[first[hit]], d_yz[second[hit]]), d_xz[at[hit]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(n.astype(np.int64))], names=["d1", "n"])
                start = stop


def witness_rule(edges: DataFrame, disagree: DataFrame, agree: float, score: DataFrame) -> DataFrame:
    """For each disagreeing pair (a, b): the row that the common neighbours speak against: a, b, loser.

    A neighbour within ``agree`` of one and beyond it of the other votes for the first.  Without a single verdict the
    row with the higher ``score`` (row, score) loses, of equals the larger.
    """
    near = edges.select("a", "b", "d").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    x = near.select(F.col("a").alias("a"), F.col("b").alias("w"), F.col("d").alias("da"))
    y = near.select(F.col("a").alias("b"), F.col("b").alias("w"), F.col("d").alias("db"))
    votes = disagree.select("a", "b").join(x, "a").join(y, ["b", "w"])
    vote = F.when((F.col("da") <= agree) & (F.col("db") > agree), F.col("b")).when((F.col("db") <= agree) & (F.col("da") > agree), F.col("a"))
    said = votes.groupBy("a", "b").agg(F.min(vote).alias("low"), F.max(vote).alias("high"))
    out = disagree.select("a", "b").join(said, ["a", "b"], "left")
    out = out.join(score.select(F.col("row").alias("a"), F.col("score").alias("sa")), "a").join(score.select(F.col("row").alias("b"), F.col("score").alias("sb")), "b")
    worse = F.when((F.col("sa") > F.col("sb")), F.col("a")).when(F.col("sb") > F.col("sa"), F.col("b")).otherwise(F.greatest("a", "b"))
    return out.select("a", "b", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(worse).alias("loser"))


def fold_leaves(nodes: DataFrame, edges: DataFrame, foldable: Column, y: str) -> DataFrame:
    """Add each foldable leaf's value to its only neighbour and drop the leaf; totals are conserved."""
    ends = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("k"), F.first("dst").alias("to"))
    leaves = nodes.where(foldable).join(ends.where("k = 1"), "node_id").select("node_id", "to", F.col(y).alias("_add"))
    heavy = leaves.join(nodes.where(~foldable).select(F.col("node_id").alias("to")), "to", "left_semi")
    sums = heavy.groupBy(F.col("to").alias("node_id")).agg(F.sum("_add").alias("_add"), F.count("*").alias("n_folded"))
    kept = nodes.join(heavy.select("node_id"), "node_id", "left_anti").join(sums, "node_id", "left")
    return kept.withColumn(y, F.col(y) + F.coalesce("_add", F.lit(0.0))).withColumn("n_folded", F.coalesce("n_folded", F.lit(0))).drop("_add")


def drawn_pairs(rows: DataFrame, key: str, order: list[str], row: str, value: str, most: int) -> DataFrame:
    """At most ``most`` unordered pairs of rows of each key, spread evenly over all of its pairs: key, a, b, d.

    Pairs are numbered, not made: of a key with more than ``most``, one is drawn from each of ``most`` equal ranges of
    numbers, and only the rows that it names are joined.
    """
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_pairs", (F.col("_n") * (F.col("_n") - 1) / 2).cast("long"))
    step = F.greatest(F.lit(1), F.floor(F.col("_pairs") / most))
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_pairs"), F.lit(most)) - 1))
    drawn = sizes.withColumn("_step", step).select(key, "_step", number.alias("_i")).withColumn("_t", F.col("_i") * F.col("_step") + F.pmod(F.col("_i") * 2654435761, F.col("_step")))
    high = F.floor((1 + F.sqrt(1 + 8 * F.col("_t").cast("double"))) / 2)
    drawn = drawn.withColumn("_b", high).withColumn("_a", (F.col("_t") - F.col("_b") * (F.col("_b") - 1) / 2).cast("long"))
    side = lambda a: placed.select(key, F.col("_place").cast("long").alias(f"_{a}"), F.col(row).alias(a), F.col(value).alias(f"_v{a}"))
    out = drawn.join(side("a"), [key, "_a"]).join(side("b"), [key, "_b"])
    return out.select(key, "a", "b", F.abs(F.col("_va") - F.col("_vb")).alias("d"))


def triangle_bounds(sides: DataFrame) -> DataFrame:
    """n, q999 and longest of the shortest sides of triangles, counted by :func:`shortest_sides`: one row."""
    return sides.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.percentile("d1", 0.999, F.col("n")).alias("q999"), F.max("d1").alias("longest"))


def size_report(groups: DataFrame, size: str, at: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """How group sizes are distributed: n, singles, largest, and percentiles: one row."""
    return groups.agg(F.count("*").alias("n"), F.count(F.when(F.col(size) == 1, 1)).alias("singles"), F.max(size).alias("largest"), *(F.percentile(size, q).alias(f"p{round(100 * q)}") for q in at))


def in_several(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Keys whose rows are in more than one group: none, where groups keep keys whole."""
    return rows.select(key, group).distinct().groupBy(key).agg(F.count("*").alias("n_groups")).where("n_groups > 1")


def sorted_discrepancy(x: Column, y: Column) -> Column:
    """The largest difference of two arrays' values in ascending order."""
    return F.array_max(F.zip_with(F.sort_array(x), F.sort_array(y), lambda a, b: F.abs(a - b)))


def separate(rows: DataFrame, subset: Column, keys: list[str], member: str, names: list[str]) -> dict[str, DataFrame]:
    """The rows of each subset, with n_rows and n_members of their groups within it."""
    marked = rows.withColumn("_subset", subset)
    return {name: group_counts(marked.where(F.col("_subset") == name).drop("_subset"), keys, member) for name in names}
