"""Queries on curation and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import curate, stats
from lattica.plans import graphs
from lattica.queries.core import r

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(text: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


@query("""WITH a AS (SELECT o_custkey AS g, o_orderkey AS id, o_totalprice / 50000 AS x, dayofyear(o_orderdate) / 60.0 AS y, (o_orderkey % 7) / 2.0 AS z, 0.2 + (o_orderkey % 3) / 10.0 AS rad,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
p AS (SELECT a.g, abs(a.n - b.n) AS hops, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / (a.rad + b.rad) AS ratio FROM a JOIN a b ON a.g = b.g AND a.id < b.id),
f AS (SELECT g, max(ratio) FILTER (WHERE hops = 1) AS bond, min(ratio) FILTER (WHERE hops = 2) AS c13, min(ratio) FILTER (WHERE hops >= 3) AS c FROM p GROUP BY g)
SELECT coalesce(bond > 1.25, false) AS long_bond, coalesce(c13 < 1.05, false) AS close_13, coalesce(c < 1.15, false) AS close, coalesce(bond > 1.25, false) OR coalesce(c13 < 1.05, false) OR coalesce(c < 1.15, false) AS geometry, count(*) AS n FROM f GROUP BY ALL""")
def spatial_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact flags of customers' orders read as chains of points."""
    from pyspark.sql import Window

    o = graphs.table(spark, sf_dir, "orders")
    atoms = o.select(
        F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("node_id"), (F.col("o_totalprice") / 50000).alias("x"), (F.dayofyear("o_orderdate") / 60.0).alias("y"),
        (F.pmod("o_orderkey", F.lit(7)) / 2.0).alias("z"), (0.2 + F.pmod("o_orderkey", F.lit(3)) / 10.0).alias("radius"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"),
    )
    near = atoms.select("graph_id", F.col("node_id").alias("a"), F.col("n").alias("na")).join(atoms.select("graph_id", F.col("node_id").alias("b"), F.col("n").alias("nb")), "graph_id")
    hops = near.where("a < b AND nb - na <= 3").select("a", "b", (F.col("nb") - F.col("na")).alias("hops"))
    out = curate.contact_flags(atoms, hops)
    keys = [F.coalesce(F.col("bond") > curate.LONG_BOND, F.lit(False)).alias("long_bond"), F.coalesce(F.col("contact_13") < curate.CLOSE_13, F.lit(False)).alias("close_13"), F.coalesce(F.col("contact") < curate.CLOSE, F.lit(False)).alias("close"), "geometry"]
    return out.groupBy(*keys).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_quantity > 45 AS a, l_discount > 0.08 AS b, l_returnflag = 'R' AS c FROM lineitem)
SELECT 'quantity' AS reason, count(*) FILTER (WHERE a) AS raised, count(*) FILTER (WHERE a) AS removed FROM f UNION ALL SELECT 'discount', count(*) FILTER (WHERE b), count(*) FILTER (WHERE b AND NOT a) FROM f
UNION ALL SELECT 'returned', count(*) FILTER (WHERE c), count(*) FILTER (WHERE c AND NOT a AND NOT b) FROM f""")
def removal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason is raised, and is the first."""
    rows = graphs.table(spark, sf_dir, "lineitem")
    return curate.reason_counts(rows, {"quantity": F.col("l_quantity") > 45, "discount": F.col("l_discount") > 0.08, "returned": F.col("l_returnflag") == "R"})


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value FROM events)
SELECT count(*) AS n, round(avg(CASE WHEN c.value < p.value THEN 1.0 ELSE 0.0 END), 6) AS lower FROM e p JOIN e c ON p.user_id = c.user_id AND c.k = p.k + 25""")
def generation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the event 25 steps later is lower."""
    from pyspark.sql import Window

    rows = graphs.table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("k"), "value")
    return curate.generations(rows, "user_id", "k", "value", 25).agg(F.count("*").alias("n"), r(F.avg(F.col("lower").cast("double"))).alias("lower"))


_FIT = "SELECT g, covar_pop(x, y) / var_pop(x) AS slope, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS intercept, count(*) AS n FROM u{k} GROUP BY g"


def _robust_sql() -> str:
    out = ["WITH u0 AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem)"]
    for k in range(4):
        out.append(f"f{k} AS ({_FIT.format(k=k)})")
        if k < 3:
            out.append(f"o{k} AS (SELECT u.*, abs(y - slope * x - intercept) AS off FROM u{k} u JOIN f{k} USING (g))")
            out.append(f"u{k + 1} AS (SELECT g, x, y FROM (SELECT *, median(off) OVER (PARTITION BY g) AS m FROM o{k}) WHERE off <= 4.0 * 1.4826 * m)")
    return ",\n".join(out) + " SELECT g AS l_returnflag, round(slope, 3) AS slope, round(intercept, 2) AS intercept, n AS n_used FROM f3"


@query(_robust_sql())
def robust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by quantity, refitted without outliers."""
    out = curate.robust_line(graphs.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", r("slope", 3).alias("slope"), r("intercept", 2).alias("intercept"), "n_used")


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order."""
    return curate.keep_first(graphs.table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderpriority, round(CASE WHEN count(*) > 1 THEN var_pop(o_totalprice) * count(*) / (count(*) - 1) END / 1e6, 3) AS variance FROM orders GROUP BY o_orderpriority""")
def sample_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bessel-corrected variances from counts and population variances."""
    rows = graphs.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.var_pop("o_totalprice").alias("msd"))
    return rows.select("o_orderpriority", r(stats.sample_variance(F.col("n"), F.col("msd")) / 1e6, 3).alias("variance"))
