"""Labelled graphs as two tables: nodes (graph_id, node_id, attributes, target) and directed edges (src, dst, attributes)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import order
from lattica.operators.rounds import settle


@dataclass(frozen=True)
class Graph:
    """``nodes``: graph_id, node_id, attribute columns, optional target columns.  ``edges``: src, dst, attribute columns; every edge in both directions."""

    nodes: DataFrame
    edges: DataFrame


def violations(graph: Graph) -> DataFrame:
    """Rows that break each invariant: (invariant, n).

    Endpoints exist; every edge has its reverse, as a set (parallel edges and loops are legal); node ids are unique.
    """
    nodes, edges = graph.nodes.select("node_id"), graph.edges.select("src", "dst")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    dangling = ends.join(nodes, "node_id", "left_anti").agg(F.count("*").alias("n"))
    once = edges.distinct()
    lonely = once.join(once.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_anti").agg(F.count("*").alias("n"))
    repeated = nodes.groupBy("node_id").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n"))
    named = lambda df, what: df.select(F.lit(what).alias("invariant"), "n")
    return named(dangling, "endpoint exists").unionAll(named(lonely, "edge has its reverse")).unionAll(named(repeated, "node id is unique"))


def induced(graph: Graph, keep: DataFrame) -> Graph:
    """The subgraph of the nodes in ``keep`` (node_id): edges stay if both ends do.  Ids are global, so nothing is renumbered."""
    keep = keep.select("node_id").distinct()
    edges = graph.edges.join(keep.withColumnRenamed("node_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return Graph(graph.nodes.join(keep, "node_id", "left_semi"), edges)


def union(parts: dict[str, Graph]) -> Graph:
    """Disjoint union; ids of each part are made distinct by its name.  The parts must have the same columns."""
    nodes, edges = None, None
    for name, g in parts.items():
        fresh = lambda c, name=name: F.xxhash64(F.lit(name), c)
        n = g.nodes.withColumn("node_id", fresh("node_id")).withColumn("graph_id", fresh("graph_id"))
        e = g.edges.withColumn("src", fresh("src")).withColumn("dst", fresh("dst"))
        if nodes is not None and (set(n.columns) != set(nodes.columns) or set(e.columns) != set(edges.columns)):
            raise ValueError(f"{name} has other columns than the parts before it")
        nodes = n if nodes is None else nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    return Graph(nodes, edges)


def degrees(graph: Graph) -> DataFrame:
    """node_id, degree: 0 for a node without edges, parallel edges count."""
    out = graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return graph.nodes.select("node_id").join(out, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def within_hops(graph: Graph, marked: DataFrame, hops: int) -> DataFrame:
    """node_id, distance: nodes at most ``hops`` edges from a marked node."""
    out = marked.select("node_id", F.lit(0).alias("distance")).distinct()
    edge = graph.edges.select("src", "dst").distinct()
    front = out
    for k in range(1, hops + 1):
        front = front.join(edge, front.node_id == edge.src).select(F.col("dst").alias("node_id"), F.lit(k).alias("distance")).distinct()
        out = out.unionAll(front)
    return out.groupBy("node_id").agg(F.min("distance").alias("distance"))


def subset_masks(graph: Graph, marks: dict[str, DataFrame]) -> DataFrame:
    """node_id, mask: two bits for each set of marked nodes, in order: at most one edge away, at most two."""
    out = None
    for k, marked in enumerate(marks.values()):
        near = within_hops(graph, marked, 2)
        bits = near.select("node_id", (F.when(F.col("distance") <= 1, 3).otherwise(2) * (4**k)).cast("long").alias("bits"))
        out = bits if out is None else out.unionAll(bits)
    sums = out.groupBy("node_id").agg(F.bit_or("bits").alias("mask"))
    return graph.nodes.select("node_id").join(sums, "node_id", "left").select("node_id", F.coalesce("mask", F.lit(0)).alias("mask"))


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """Codes of a column's distinct values in order: (value, code); one more code, the number of values, means unknown."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return order.numbered(settle(values), ["value"], "code").select("value", F.col("code").cast("int").alias("code"))


def encode(rows: DataFrame, column: str, codes: DataFrame, to: str) -> DataFrame:
    """``rows`` with the code of ``column`` in ``to``; values that ``codes`` lacks get the code above all."""
    above = codes.agg(F.count("*").cast("int").alias("_above"))
    joined = rows.join(codes.select(F.col("value").alias(column), F.col("code").alias(to)), column, "left")
    return joined.crossJoin(F.broadcast(above)).withColumn(to, F.coalesce(to, "_above")).drop("_above")  # one row
