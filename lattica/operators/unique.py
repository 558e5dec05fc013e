"""Graphs that are equal under refinement: one stands for all, clusters are made of those, and rows get them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import similarity
from lattica.operators.rounds import settle

LOW = (1 << 32) - 1


def unique_graphs(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """graph_id, standing: the smallest id of the graphs with the same multiset of final classes.

    ``labels``: node_id, level, cid of a refinement of ``nodes`` (graph_id, node_id).  A graph's key is a hash of its
    number of nodes and of sums over its classes, so a large graph needs no list in one row.  Equal keys are verified
    class by class; a graph whose classes differ from those of the one with its key stands for itself.  Graphs without
    nodes have no row.  Rows with a null graph_id fall out.
    """
    owner = nodes.select("graph_id", "node_id").where("graph_id IS NOT NULL")
    last = labels.agg(F.max("level")).first()[0]
    final = labels.where(F.col("level") == F.lit(last)).select("node_id", "cid").join(owner, "node_id")
    counts = settle(final.groupBy("graph_id", "cid").agg(F.count("*").alias("n")))
    h = F.xxhash64("cid", "n")
    sums = [F.sum(x) for x in (h.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h, 32))]
    keys = counts.groupBy("graph_id").agg(F.xxhash64(F.sum("n"), *sums).alias("key"), F.count("*").alias("kinds"))
    keys = settle(keys)
    first = keys.groupBy("key").agg(F.min("graph_id").alias("standing"))
    met = settle(keys.join(first, "key").select("graph_id", "standing", "kinds"))
    other = met.where("graph_id <> standing")
    theirs = counts.select(F.col("graph_id").alias("standing"), "cid", F.col("n").alias("m"))
    theirs = theirs.join(other.select("standing").distinct(), "standing", "left_semi")
    agreed = counts.join(other, "graph_id").join(theirs, ["standing", "cid"]).where("n = m").groupBy("graph_id").agg(F.count("*").alias("agreed"))
    theirs_kinds = keys.select(F.col("graph_id").alias("standing"), F.col("kinds").alias("kinds_there"))
    checked = met.join(agreed, "graph_id", "left").join(theirs_kinds, "standing")
    fine = (F.col("graph_id") == F.col("standing")) | ((F.col("agreed") == F.col("kinds")) & (F.col("kinds") == F.col("kinds_there")))
    return checked.select("graph_id", F.when(F.coalesce(fine, F.lit(False)), F.col("standing")).otherwise(F.col("graph_id")).alias("standing"))


def class_bits(nodes: DataFrame, labels: DataFrame, standing: DataFrame) -> DataFrame:
    """key, bit: the classes of all levels that occur in each graph that stands for others or itself."""
    chosen = standing.where("graph_id = standing").select("graph_id")
    own = nodes.select("graph_id", "node_id").join(chosen, "graph_id", "left_semi")
    return labels.select("node_id", F.xxhash64("level", "cid").alias("bit")).join(own, "node_id").select(F.col("graph_id").alias("key"), "bit").distinct()


def cluster_graphs(nodes: DataFrame, labels: DataFrame, cutoff: float) -> DataFrame:
    """graph_id, standing, centre: Butina clusters of the distinct graphs, handed back to all.

    Two graphs are near if the sets of their classes of all levels are at a Tanimoto distance of ``cutoff`` at most.
    A graph that occurs a million times counts once: it gives its cluster no weight and meets no copy of itself.
    """
    standing = settle(unique_graphs(nodes, labels))
    bits = settle(class_bits(nodes, labels, standing))
    pairs = settle(similarity.tanimoto_pairs(bits, cutoff))
    centres = similarity.butina(bits.select("key").distinct(), pairs)
    return standing.join(centres.select(F.col("key").alias("standing"), "centre"), "standing").select("graph_id", "standing", "centre")
