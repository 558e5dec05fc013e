"""Refinement: every node gets a chain of ever finer classes, attribute levels first, then neighbourhood rounds.

A class id is a hash of its content: the level, the class one level up, and the attribute or the multiset of
(neighbour class, edge code).  Ids of different corpora agree, so models merge by grouping and predict by joining.
The multiset enters by its size and the sums of two hashes' halves: sums are partial aggregates, so a hub needs no
list of its neighbours in one row.  A second hash, ``check``, verifies the first (:func:`collisions`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import Graph
from lattica.operators.rounds import settle

LOW = (1 << 32) - 1


def _pair(*parts: Column) -> list[Column]:
    return [F.xxhash64(*parts).alias("cid"), F.xxhash64(F.lit("check"), *parts).alias("check")]


def attribute_levels(nodes: DataFrame, levels: Sequence[str]) -> DataFrame:
    """node_id, level, cid, check, parent: one row per node and attribute level."""
    parent = F.lit(None).cast("long")
    out, cid = [], parent
    for k, column in enumerate(levels):
        parts = [F.lit(k), F.coalesce(cid, F.lit(0).cast("long")), F.col(column)]
        own, check = _pair(*parts)
        out.append(F.struct(F.lit(k).alias("level"), own.alias("cid"), check.alias("check"), cid.alias("parent")))
        cid = F.xxhash64(*parts)
    return nodes.select("node_id", F.explode(F.array(*out)).alias("r")).select("node_id", "r.*")


def _messages(labels: DataFrame, edges: DataFrame, codes: Sequence[str]) -> DataFrame:
    """For each node that has neighbours: their number and the hash sums of (class, edge code)."""
    seen = edges.join(labels.select(F.col("node_id").alias("dst"), "cid", "check"), "dst")
    h = [F.xxhash64("cid", *codes), F.xxhash64(F.lit(1), "check", *codes)]
    halves = [x for y in h for x in (y.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(y, 32))]
    return seen.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("m"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(halves)))


def _round(labels: DataFrame, edges: DataFrame, codes: Sequence[str], level: int, source: DataFrame | None = None) -> DataFrame:
    got = labels.join(_messages(labels if source is None else source, edges, codes), "node_id", "left")
    parts = [F.lit(level), F.col("cid"), *(F.coalesce(c, F.lit(0)) for c in ("m", "s0", "s1", "s2", "s3"))]
    own, check = _pair(*parts)
    return got.select("node_id", F.lit(level).alias("level"), own, check, F.col("cid").alias("parent"))


def refine(graph: Graph, levels: Sequence[str], depth: int, edge_codes: Sequence[str] = (), neighbour_level: int | None = None) -> DataFrame:
    """The full chain: node_id, level, cid, check, parent; ``depth`` rounds after the attribute levels.

    ``neighbour_level``: neighbours are seen by a coarser chain that starts from so many attribute levels; each fine
    round then pairs a node's class with its coarse class of the same round.
    """
    if not levels:
        raise ValueError("at least one attribute level is needed")
    if neighbour_level is not None and not 1 <= neighbour_level <= len(levels):
        raise ValueError("neighbour_level counts attribute levels")
    out = attribute_levels(graph.nodes, levels)
    last = len(levels) - 1
    now = out.where(F.col("level") == last)
    coarse = None
    if neighbour_level is not None and neighbour_level < len(levels) and depth:
        coarse = out.where(F.col("level") == neighbour_level - 1)
    for r in range(1, depth + 1):
        level = last + r
        if coarse is None:
            now = settle(_round(now, graph.edges, edge_codes, level))
        else:
            coarse = settle(_round(coarse, graph.edges, edge_codes, 1000 + r))
            both = now.join(coarse.select("node_id", F.col("cid").alias("g"), F.col("check").alias("gc")), "node_id")
            own, check = _pair(F.lit(level), F.col("cid"), F.col("g"))
            now = settle(both.select("node_id", F.lit(level).alias("level"), own, check, F.col("cid").alias("parent")))
        out = out.unionByName(now)
    return out


def collisions(labels: DataFrame) -> DataFrame:
    """Ids that stand for more than one class or have more than one parent: none, unless a hash collides."""
    return labels.groupBy("level", "cid").agg(F.min("check").alias("a"), F.max("check").alias("b"), F.min("parent").alias("p"), F.max("parent").alias("q")).where("a <> b OR p <> q")


def fingerprints(graph: Graph, attribute: str, radius: int, edge_codes: Sequence[str] = (), most: int = 8) -> DataFrame:
    """node_id, radius, fp: content fingerprints that do not depend on the batch; a degree above ``most`` is an error."""
    wide = graph.edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > most)
    if wide.limit(1).count():
        raise ValueError(f"a node has more than {most} neighbours")
    return refine(graph, [attribute], radius, edge_codes).select("node_id", F.col("level").alias("radius"), F.col("cid").alias("fp"))
