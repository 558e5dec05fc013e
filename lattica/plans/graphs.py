"""Graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chain(rows: DataFrame, group: str, order: list[str], node: str) -> DataFrame:
    """Edges between neighbours of each group's order, in both directions."""
    nxt = F.lead(node).over(Window.partitionBy(group).orderBy(*order))
    forward = rows.select(F.col(node).alias("src"), nxt.alias("dst")).where("dst IS NOT NULL")
    return forward.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")


def events_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Paths: each user's events in order of time; label event_type, target value."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    nodes = rows.select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("node_id"), "event_type", F.col("value").alias("y"))
    return Graph(nodes, chain(rows, "user_id", ["ts", "event_id"], "event_id"))


def conversations_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Paths: each conversation's turns; label role, target length of the text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").withColumn("node_id", F.col("conv_id") * 100000 + F.col("turn"))
    nodes = rows.select(F.col("conv_id").alias("graph_id"), "node_id", "role", F.length("text").cast("double").alias("y"))
    return Graph(nodes, chain(rows, "conv_id", ["turn"], "node_id"))


def orders_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Stars: an order and its line items, numbered by all their columns; attributes kind and a, target y."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*items.columns))
    items = items.withColumn("node_id", F.col("l_orderkey") * 1000 + number)
    top = orders.select(F.col("o_orderkey").alias("graph_id"), (F.col("o_orderkey") * 1000).alias("node_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("a"), F.col("o_totalprice").alias("y"))
    leaf = items.select(F.col("l_orderkey").alias("graph_id"), "node_id", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("a"), F.col("l_extendedprice").alias("y"))
    edges = items.select(F.explode(F.array(F.struct((F.col("l_orderkey") * 1000).alias("src"), F.col("node_id").alias("dst")), F.struct(F.col("node_id").alias("src"), (F.col("l_orderkey") * 1000).alias("dst")))).alias("e")).select("e.*")
    return Graph(top.unionByName(leaf), edges)


def places_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """One tree: regions, nations, customers and suppliers by containment; label level, target account balance."""
    region, nation, customer, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    part = lambda df, key, base, level, up, y: df.select(F.lit(0).cast("long").alias("graph_id"), (F.col(key).cast("long") * 10 + base).alias("node_id"), F.lit(level).alias("level_tag"), y.cast("double").alias("y"), up.cast("long").alias("up"))
    none = F.lit(None)
    rows = part(region, "r_regionkey", 1, "region", none, none)
    rows = rows.unionAll(part(nation, "n_nationkey", 2, "nation", F.col("n_regionkey") * 10 + 1, none))
    rows = rows.unionAll(part(customer, "c_custkey", 3, "customer", F.col("c_nationkey") * 10 + 2, F.col("c_acctbal")))
    rows = rows.unionAll(part(supplier, "s_suppkey", 4, "supplier", F.col("s_nationkey") * 10 + 2, F.col("s_acctbal")))
    edges = rows.where("up IS NOT NULL").select(F.explode(F.array(F.struct(F.col("node_id").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("node_id").alias("dst")))).alias("e")).select("e.*")
    return Graph(rows.drop("up"), edges)
