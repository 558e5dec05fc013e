"""Graphs that occur more than once and clusters of the distinct ones; floors in a plan of folds; parts of strata by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import crossval
from lattica.operators import refine, unique
from lattica.operators.rounds import settle
from lattica.plans import graphs
from lattica.queries.core import r
from lattica.queries.more import BUTINA_OF

QUERIES, ORACLE_SQL = {}, {}
CUTOFF = 0.3


def query(text: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, text
        return f

    return add


#: Orders as stars: equal if status and flags of the items are.
_STARS = """i AS (SELECT l_orderkey AS k, list_sort(list(l_returnflag)) AS flags FROM lineitem GROUP BY 1),
stars AS (SELECT coalesce(o_orderkey, k) AS k, o_orderstatus AS status, coalesce(flags, []) AS flags FROM orders FULL JOIN i ON k = o_orderkey),
u AS (SELECT status, flags, min(k) AS standing FROM stars GROUP BY ALL)"""


def _stars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = graphs.orders_graph(spark, sf_dir)
    return g.nodes, settle(refine.refine(g, ["kind"], 1))


@query(f"WITH {_STARS} SELECT standing, count(*) AS n FROM stars s JOIN u ON u.flags = s.flags AND u.status IS NOT DISTINCT FROM s.status GROUP BY 1")
def unique_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orders with their items, and how often each occurs."""
    return unique.unique_graphs(*_stars(spark, sf_dir)).groupBy("standing").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_STARS},
bits AS (SELECT standing AS k, unnest(list_concat(CASE WHEN status IS NULL THEN [] ELSE ['c' || status, 'd' || status || array_to_string(flags, ',')] END, list_transform(list_distinct(flags), lambda f: 'l' || f), list_transform(list_distinct(flags), lambda f: 'm' || f || coalesce(status, '-')))) AS bit FROM u),
sized AS (SELECT k, count(*) AS n FROM bits GROUP BY 1), met AS (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM bits x JOIN bits y ON x.bit = y.bit AND x.k < y.k GROUP BY ALL),
near AS MATERIALIZED (SELECT a, b FROM met JOIN sized p ON p.k = a JOIN sized q ON q.k = b WHERE shared >= (p.n + q.n - shared) * (1 - {CUTOFF}) - 1e-9), v AS (SELECT k AS vec_id FROM sized),
{BUTINA_OF}
SELECT s.k AS graph_id, standing, centre FROM stars s JOIN u ON u.flags = s.flags AND u.status IS NOT DISTINCT FROM s.status JOIN butina ON key = standing""")
def graph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the one that stands for it and the centre of that one's Butina cluster."""
    return unique.cluster_graphs(*_stars(spark, sf_dir), CUTOFF)


@query("""WITH sh AS (SELECT DISTINCT user_id % 10 AS shard FROM events), rp AS (SELECT unnest([0, 1]) AS repeat),
plan AS (SELECT repeat, shard, ntile(5) OVER (PARTITION BY repeat ORDER BY ((shard + repeat) * CAST(2654435761 AS HUGEINT)) % 4294967296, shard) - 1 AS fold FROM sh, rp),
fd AS (SELECT DISTINCT repeat, fold FROM plan),
g AS (SELECT user_id % 10 AS shard, (value - avg(value) OVER (PARTITION BY event_type, event_id % 50)) ** 2 AS di, (value - avg(value) OVER (PARTITION BY event_type)) ** 2 AS d FROM events)
SELECT CAST(fd.repeat AS INT) AS repeat, CAST(fd.fold AS INT) AS fold, CAST(count(*) AS BIGINT) AS n, round(avg(di), 4) AS within, round(avg(d), 4) AS within_outer FROM g JOIN plan p USING (shard) JOIN fd ON fd.repeat = p.repeat AND fd.fold <> p.fold GROUP BY ALL""")
def fold_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors that no model of a key can avoid, of two nested keys, over the shards that each fold trains on."""
    rows = graphs.table(spark, sf_dir, "events").select("event_type", F.pmod("event_id", F.lit(50)).alias("key"), F.pmod("user_id", F.lit(10)).alias("shard"), "value")
    sums = settle(crossval.floors(rows, ["event_type"], ["key"], "value", "shard"))
    plan = settle(crossval.plan(sums.select("shard"), 5, 2))
    out = crossval.training_floors(sums, plan)
    return out.select("repeat", "fold", "n", r("within", 4).alias("within"), r("within_outer", 4).alias("within_outer"))
