"""Queries on graphs, refinement, class statistics, prediction and estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import estimate, graph, predict, refine, stats
from lattica.operators.graph import Graph
from lattica.operators.rounds import settle
from lattica.plans import graphs
from lattica.queries import sql

DEPTH, LEVELS = 3, 4
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


def r(column, digits: int = 6):
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def _events(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> tuple[Graph, DataFrame]:
    g = graphs.events_graph(spark, sf_dir)
    return g, settle(refine.refine(g, ["event_type"], depth))


def _split(g: Graph) -> tuple[DataFrame, DataFrame]:
    return g.nodes.where("graph_id % 5 <> 0"), g.nodes.where("graph_id % 5 = 0")


def _model(labels: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return settle(stats.class_stats(labels, nodes)), stats.global_stats(nodes)


_EV = f"WITH {sql.EVENTS},\n{sql.labels(['a0'], DEPTH)}"
_SPLIT = "train AS (SELECT * FROM nodes WHERE graph_id % 5 <> 0),\ntest AS (SELECT * FROM nodes WHERE graph_id % 5 = 0)"
_ALL = f"{_EV},\n{sql.model()}"


@query(f"""{_EV},\n{_SPLIT},\n{sql.model('train')},\n{sql.predictions(2)}
SELECT CAST(matched_level AS INT) AS matched_level, count(*) AS n, round(sqrt(avg((value - y) * (value - y))), 6) AS rmse FROM pred GROUP BY matched_level""")
def backoff_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of back-off prediction by matched level, with two rows of support, on users held out."""
    g, labels = _events(spark, sf_dir)
    train, test = _split(g)
    classes, whole = _model(labels, train)
    pred = predict.back_off(labels.join(test.select("node_id"), "node_id", "left_semi"), classes, whole, 2).join(test, "node_id")
    d = F.col("value") - F.col("y")
    return pred.groupBy("matched_level").agg(F.count("*").alias("n"), r(F.sqrt(F.avg(d * d))).alias("rmse"))


@query(f"""{_EV},\n{_SPLIT},\n{sql.model('train')},\n{sql.predictions(5)}
SELECT CAST(matched_level AS INT) AS matched_level, threshold_bound, count(*) AS n, round(avg(support), 6) AS mean_support FROM pred GROUP BY ALL""")
def threshold_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a deeper class matched but lacked five rows."""
    g, labels = _events(spark, sf_dir)
    train, test = _split(g)
    classes, whole = _model(labels, train)
    pred = predict.back_off(labels.join(test.select("node_id"), "node_id", "left_semi"), classes, whole, 5)
    return pred.groupBy("matched_level", "threshold_bound").agg(F.count("*").alias("n"), r(F.avg("support")).alias("mean_support"))


@query(f"""WITH {sql.EVENTS}
SELECT 'endpoint exists' AS invariant, count(*) AS n FROM (SELECT src AS v FROM edges UNION ALL SELECT dst FROM edges) WHERE v NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT 'edge has its reverse', count(*) FROM (SELECT DISTINCT src, dst FROM edges) e WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.src = e.dst AND f.dst = e.src)
UNION ALL SELECT 'node id is unique', count(*) FROM (SELECT node_id FROM nodes GROUP BY node_id HAVING count(*) > 1)""")
def graph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each invariant."""
    return graph.violations(graphs.events_graph(spark, sf_dir))


@query(f"""WITH {sql.ORDERS},\nd AS (SELECT n.node_id, count(e.src) AS degree FROM nodes n LEFT JOIN edges e ON e.src = n.node_id GROUP BY n.node_id)
SELECT degree, count(*) AS n FROM d GROUP BY degree""")
def degree_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each degree."""
    return graph.degrees(graphs.orders_graph(spark, sf_dir)).groupBy("degree").agg(F.count("*").alias("n"))


@query(f"""WITH {sql.PLACES},\nkeep AS (SELECT node_id FROM rows_ WHERE a0 <> 'customer' OR y > 0)
SELECT (SELECT count(*) FROM keep) AS n_nodes, count(*) AS n_edges FROM edges WHERE src IN (SELECT node_id FROM keep) AND dst IN (SELECT node_id FROM keep)""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges without customers in debt."""
    g = graphs.places_graph(spark, sf_dir)
    sub = graph.induced(g, g.nodes.where("level_tag <> 'customer' OR y > 0").select("node_id"))
    return sub.nodes.agg(F.count("*").alias("n_nodes")).crossJoin(sub.edges.agg(F.count("*").alias("n_edges")))


@query("""SELECT count(DISTINCT part || ':' || g) AS n_graphs, CAST(sum(n) AS BIGINT) AS n_nodes, CAST(sum(2 * (n - 1)) AS BIGINT) AS n_edges FROM (
SELECT 'e' AS part, CAST(user_id AS VARCHAR) AS g, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'c', CAST(conv_id AS VARCHAR), count(*) FROM conversations GROUP BY ALL)""")
def graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event and conversation paths as one corpus."""
    e, c = graphs.events_graph(spark, sf_dir), graphs.conversations_graph(spark, sf_dir)
    both = graph.union({"events": Graph(e.nodes.withColumnRenamed("event_type", "a0"), e.edges), "conversations": Graph(c.nodes.withColumnRenamed("role", "a0"), c.edges)})
    nodes = both.nodes.agg(F.countDistinct("graph_id").alias("n_graphs"), F.count("*").alias("n_nodes"))
    return nodes.crossJoin(both.edges.agg(F.count("*").alias("n_edges")))


@query("""WITH t AS (SELECT DISTINCT l_shipdate::DATE AS v FROM lineitem WHERE l_orderkey % 5 <> 0), d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM t)
SELECT CAST(coalesce(code, (SELECT count(*) FROM d)) AS INT) AS code, count(*) AS n FROM lineitem l LEFT JOIN d ON d.v = l.l_shipdate::DATE WHERE l_orderkey % 5 = 0 GROUP BY 1""")
def encode_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of ship dates from a dictionary of other orders' dates; one code means unknown."""
    rows = graphs.table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("v"))
    codes = graph.dictionary(rows.where("l_orderkey % 5 <> 0"), "v")
    return graph.encode(rows.where("l_orderkey % 5 = 0"), "v", codes, "code").groupBy("code").agg(F.count("*").alias("n"))


def _class_counts(labels: DataFrame) -> DataFrame:
    per = labels.where("level < 1000").groupBy("level", "cid").agg(F.count("*").alias("n"))
    return per.groupBy("level").agg(F.count("*").alias("n_classes"), F.count(F.when(F.col("n") == 1, 1)).alias("n_single"), F.max("n").alias("largest"))


_COUNTS = "SELECT CAST(level AS INT) AS level, count(*) AS n_classes, count(*) FILTER (WHERE n = 1) AS n_single, max(n) AS largest FROM (SELECT level, cid, count(*) AS n FROM labels GROUP BY level, cid) GROUP BY level"


@query(f"WITH {sql.ORDERS},\n{sql.labels(['a0', 'a1'], 0)} {_COUNTS}")
def attr_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of two graded attributes."""
    return _class_counts(refine.attribute_levels(graphs.orders_graph(spark, sf_dir).nodes, ["kind", "a"]))


@query(f"{_EV} {_COUNTS}")
def wl_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, single-node classes and the largest class at each level of event paths."""
    return _class_counts(_events(spark, sf_dir)[1])


@query(f"WITH {sql.ORDERS},\n{sql.labels(['a0'], 2)} {_COUNTS}")
def wl_star_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of order stars: multisets of neighbours of many sizes, isolated nodes included."""
    return _class_counts(refine.refine(graphs.orders_graph(spark, sf_dir), ["kind"], 2))


@query(f"WITH {sql.PLACES},\n{sql.labels(['a0'], 3)} {_COUNTS}")
def wl_hub_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of one tree with hubs."""
    return _class_counts(refine.refine(graphs.places_graph(spark, sf_dir), ["level_tag"], 3))


@query(f"""WITH {sql.ORDERS.replace('nodes AS (', 'nodes0 AS (', 1)},\nnodes AS (SELECT node_id, 'x' AS a0 FROM nodes0),\n{sql.labels(['a0'], 2)} {_COUNTS}""")
def wl_topology_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes from the shape alone."""
    g = graphs.orders_graph(spark, sf_dir)
    return _class_counts(refine.refine(Graph(g.nodes.withColumn("atom", F.lit("x")), g.edges), ["atom"], 2))


_GAP = """WITH nodes AS (SELECT user_id AS graph_id, event_id AS node_id, event_type AS a0, value AS y FROM events),
fwd AS (SELECT event_id AS src, lead(event_id) OVER w AS dst, CASE WHEN event_type = lead(event_type) OVER w THEN 1 ELSE 0 END AS code FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
edges AS (SELECT src, dst, code FROM fwd WHERE dst IS NOT NULL UNION ALL SELECT dst, src, code FROM fwd WHERE dst IS NOT NULL)"""


@query(f"{_GAP},\n{sql.labels(['a0'], 2, 'code')} {_COUNTS}")
def wl_edge_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes where edges carry a code: whether their ends have one type."""
    g = graphs.events_graph(spark, sf_dir)
    kind = lambda c: g.nodes.select(F.col("node_id").alias(c), F.col("event_type").alias(f"t_{c}"))
    edges = g.edges.join(kind("src"), "src").join(kind("dst"), "dst").select("src", "dst", (F.col("t_src") == F.col("t_dst")).cast("int").alias("code"))
    return _class_counts(refine.refine(Graph(g.nodes, edges), ["event_type"], 2, ["code"]))


@query(f"WITH {sql.ORDERS},\n{sql.labels(['a0', 'a1'], 2, coarse=1)} {_COUNTS}")
def coarse_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes where neighbours are seen by their first attribute only."""
    return _class_counts(refine.refine(graphs.orders_graph(spark, sf_dir), ["kind", "a"], 2, neighbour_level=1))


@query(f"WITH {sql.CONVERSATIONS},\n{sql.labels(['a0'], 3)} SELECT CAST(level AS INT) AS radius, count(DISTINCT cid) AS n FROM labels GROUP BY level")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct content fingerprints of conversation turns by radius."""
    return refine.fingerprints(graphs.conversations_graph(spark, sf_dir), "role", 3).groupBy("radius").agg(F.countDistinct("fp").alias("n"))


_LEVELS = "CAST(level AS INT) AS level, count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS n, round(avg(mean), 6) AS mean_of_means, round(avg(msd), 6) AS mean_msd, count(*) FILTER (WHERE n = 1) AS no_variance"


def _level_summary(classes: DataFrame, keys: tuple[str, ...] = ("level",)) -> DataFrame:
    return classes.groupBy(*keys).agg(F.count("*").alias("n_classes"), F.sum("n").alias("n"), r(F.avg("mean")).alias("mean_of_means"), r(F.avg("msd")).alias("mean_msd"), F.count(F.when(stats.sample_variance(F.col("n"), F.col("msd")).isNull(), 1)).alias("no_variance"))


@query(f"{_ALL} SELECT {_LEVELS} FROM classes GROUP BY level")
def class_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class statistics by level."""
    g, labels = _events(spark, sf_dir)
    return _level_summary(stats.class_stats(labels, g.nodes))


@query(f"""WITH {sql.ORDERS},\n{sql.labels(['a0'], 1)},
v AS (SELECT node_id, u.dim, [l_quantity, l_discount, l_tax][u.dim + 1] AS y FROM items, (SELECT unnest([0, 1, 2]) AS dim) u),
c AS (SELECT level, cid, dim, count(*) AS n, avg(y) AS mean, var_pop(y) AS msd FROM labels JOIN v USING (node_id) GROUP BY ALL)
SELECT CAST(level AS INT) AS level, CAST(dim AS INT) AS dim, count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS n, round(avg(mean), 6) AS mean_of_means, round(avg(msd), 6) AS mean_msd, count(*) FILTER (WHERE n = 1) AS no_variance FROM c GROUP BY level, dim""")
def class_stats_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class statistics of line items for a target of three dimensions."""
    g = graphs.orders_graph(spark, sf_dir)
    items = graphs.table(spark, sf_dir, "lineitem")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*items.columns))
    y = items.select((F.col("l_orderkey") * 1000 + number).alias("node_id"), F.array("l_quantity", "l_discount", "l_tax").alias("y"))
    return _level_summary(stats.class_stats_vector(refine.refine(g, ["kind"], 1), y), ("level", "dim"))


@query(f"WITH {sql.EVENTS} SELECT count(*) AS n, round(avg(y), 6) AS mean, round(var_pop(y), 6) AS msd FROM nodes")
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean and variance of the corpus."""
    return stats.global_stats(graphs.events_graph(spark, sf_dir).nodes).select("n", r("mean").alias("mean"), r("msd").alias("msd"))


@query(f"{_ALL} SELECT {_LEVELS} FROM classes GROUP BY level")
def merge_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics fitted on eight shards of the users and merged: those of the whole fit."""
    g, labels = _events(spark, sf_dir)
    shard = g.nodes.withColumn("shard", F.pmod("graph_id", F.lit(8)))
    rows = labels.join(shard.select("node_id", "shard", "y"), "node_id")
    parts = rows.groupBy("shard", "level", "cid").agg(F.first("parent").alias("parent"), F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("msd"))
    return _level_summary(stats.merge([settle(parts).drop("shard"), stats.empty_like(parts).drop("shard")]))


@query(f"""{_EV},\nf AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold),
c AS (SELECT fold, level, cid, count(*) AS n, avg(y) AS mean, var_pop(y) AS msd FROM labels JOIN nodes USING (node_id) JOIN f ON graph_id % 5 <> fold GROUP BY ALL)
SELECT CAST(fold AS BIGINT) AS fold, {_LEVELS} FROM c GROUP BY fold, level""")
def leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fold models, each without a fifth of the users, from one fit."""
    g, labels = _events(spark, sf_dir)
    rows = labels.join(g.nodes.select("node_id", F.pmod("graph_id", F.lit(5)).alias("group"), "y"), "node_id")
    parts = settle(rows.groupBy("group", "level", "cid").agg(F.first("parent").alias("parent"), F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("msd")))
    return _level_summary(stats.leave_one_group_out(parts, "group", spark.range(5).select(F.col("id").alias("group"))), ("fold", "level"))


@query(f"{_ALL} SELECT {_LEVELS} FROM classes WHERE level <= 2 GROUP BY level")
def truncate_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted model without its deepest round."""
    g, labels = _events(spark, sf_dir)
    return _level_summary(stats.truncate(stats.class_stats(labels, g.nodes), 2))


@query(f"""{_ALL},
loo AS (SELECT l.node_id, n.y, l.level, c.n - 1 AS n, (c.n * c.mean - n.y) / (c.n - 1) AS mean FROM labels l JOIN classes c ON c.level = l.level AND c.cid = l.cid JOIN nodes n USING (node_id) WHERE c.n > 1),
pred AS (SELECT n.node_id, n.y, coalesce(arg_max(mean, level) FILTER (WHERE loo.n >= 2), (SELECT mean FROM whole)) AS value, coalesce(max(level) FILTER (WHERE loo.n >= 2), -1) AS matched_level FROM nodes n LEFT JOIN loo USING (node_id) GROUP BY n.node_id, n.y)
SELECT CAST(matched_level AS INT) AS matched_level, count(*) AS n, round(sqrt(avg((value - y) * (value - y))), 6) AS rmse FROM pred GROUP BY matched_level""")
def predict_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out error on training nodes by matched level."""
    g, labels = _events(spark, sf_dir)
    classes, whole = _model(labels, g.nodes)
    pred = predict.leave_one_out(labels, classes, g.nodes, whole, 2).join(g.nodes.select("node_id", "y"), "node_id")
    d = F.col("value") - F.col("y")
    return pred.groupBy("matched_level").agg(F.count("*").alias("n"), r(F.sqrt(F.avg(d * d))).alias("rmse"))


@query(f"{_ALL} SELECT CAST(level AS INT) AS level, children, count(*) AS n FROM kids GROUP BY level, children")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many classes have how many children."""
    g, labels = _events(spark, sf_dir)
    return estimate.child_counts(stats.class_stats(labels, g.nodes)).groupBy("level", "children").agg(F.count("*").alias("n"))


@query(f"""{_ALL}, e AS (SELECT c.level, coalesce(k.m, c.mean) AS estimate FROM classes c LEFT JOIN (SELECT level - 1 AS level, parent AS cid, avg(mean) AS m FROM classes WHERE parent IS NOT NULL GROUP BY ALL) k USING (level, cid))
SELECT CAST(level AS INT) AS level, round(avg(estimate), 6) AS estimate, round(var_pop(estimate), 6) AS spread FROM e GROUP BY level""")
def continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class estimates as plain means of the children's means."""
    g, labels = _events(spark, sf_dir)
    out = estimate.continuation(settle(stats.class_stats(labels, g.nodes)))
    return out.groupBy("level").agg(r(F.avg("estimate")).alias("estimate"), r(F.var_pop("estimate")).alias("spread"))


@query(f"""{_ALL}, e3 AS (SELECT *, mean AS estimate FROM classes WHERE level = 3),
{", ".join(f"e{k} AS (SELECT c.*, coalesce(d.m, c.mean) AS estimate FROM classes c LEFT JOIN (SELECT parent AS cid, avg(estimate) AS m FROM e{k + 1} GROUP BY parent) d USING (cid) WHERE level = {k})" for k in (2, 1, 0))}
SELECT CAST(level AS INT) AS level, round(avg(estimate), 6) AS estimate, round(var_pop(estimate), 6) AS spread FROM ({" UNION ALL ".join(f"SELECT level, estimate FROM e{k}" for k in range(4))}) GROUP BY level""")
def continuation_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class estimates from the children's own estimates, deepest first."""
    g, labels = _events(spark, sf_dir)
    out = estimate.continuation_recursive(settle(stats.class_stats(labels, g.nodes)), LEVELS)
    return out.groupBy("level").agg(r(F.avg("estimate")).alias("estimate"), r(F.var_pop("estimate")).alias("spread"))


@query(f"{_ALL},{sql.scalars()} SELECT CAST(level AS INT) AS level, round(sigma2, 6) AS sigma2, round(tau2, 6) AS tau2, round(tau2_parent, 6) AS tau2_parent FROM scalars")
def sibling_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance components of each level."""
    g, labels = _events(spark, sf_dir)
    out = estimate.bayes_scalars(settle(stats.class_stats(labels, g.nodes)))
    return out.select("level", r("sigma2").alias("sigma2"), r("tau2").alias("tau2"), r("tau2_parent").alias("tau2_parent"))


@query(f"""{_ALL}, k AS (SELECT level - 1 AS level, parent, var_samp(mean) - avg(msd / n) AS tau2 FROM classes WHERE parent IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT CAST(level AS INT) AS level, count(*) AS n, round(avg(tau2), 6) AS mean_tau2, count(*) FILTER (WHERE tau2 < 0) AS n_negative FROM k GROUP BY level""")
def class_sibling_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between-children variance of single classes."""
    g, labels = _events(spark, sf_dir)
    out = estimate.class_variances(settle(stats.class_stats(labels, g.nodes)))
    return out.groupBy("level").agg(F.count("*").alias("n"), r(F.avg("tau2")).alias("mean_tau2"), F.count(F.when(F.col("tau2") < 0, 1)).alias("n_negative"))


_SHRUNK = "SELECT CAST(level AS INT) AS level, round(avg(weight), 6) AS mean_weight, round(avg(shrunk), 6) AS mean_shrunk, round(var_pop(shrunk), 6) AS spread FROM shrunk GROUP BY level"


def _shrink(spark: SparkSession, sf_dir: str, rule: str, strength: float = 0.0) -> DataFrame:
    g, labels = _events(spark, sf_dir)
    classes, whole = _model(labels, g.nodes)
    out = estimate.shrink(classes, whole, LEVELS, rule, strength)
    return out.groupBy("level").agg(r(F.avg("weight")).alias("mean_weight"), r(F.avg("shrunk")).alias("mean_shrunk"), r(F.var_pop("shrunk")).alias("spread"))


@query(f"{_ALL},\n{sql.shrunk('(n / (n + 5.0))', LEVELS)} {_SHRUNK}")
def shrink_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrinkage by count."""
    return _shrink(spark, sf_dir, "count", 5.0)


@query(f"{_ALL},\n{sql.shrunk('(1 - least(0.5 * children / n, 1.0))', LEVELS)} {_SHRUNK}")
def shrink_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrinkage by the diversity of children."""
    return _shrink(spark, sf_dir, "diversity", 0.5)


@query(f"{_ALL},{sql.scalars()},\nkw AS (SELECT k.*, {sql.BAYES} AS w FROM kids k JOIN scalars USING (level)),\n{sql.shrunk('c.w', LEVELS, 'kw')} {_SHRUNK}")
def shrink_eb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empirical-Bayes shrinkage."""
    return _shrink(spark, sf_dir, "empirical_bayes")


@query(f"""{_ALL},{sql.scalars()},
own AS (SELECT level - 1 AS level, parent AS cid, greatest(0.0, var_samp(mean) - avg(msd / n)) AS own FROM classes WHERE parent IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT k.level, (k.n * k.msd + 10 * s.sigma2) / (k.n - 1 + 10) + 0.5 * (CASE WHEN children > 0 THEN ((children - 1) * coalesce(own, 0.0) + coalesce(s.tau2, 0.0)) / children ELSE 0 END)
  + coalesce(s.tau2_parent, 0.0) * (1 - ({sql.BAYES})) AS v FROM kids k JOIN scalars s USING (level) LEFT JOIN own o ON o.level = k.level AND o.cid = k.cid)
SELECT CAST(level AS INT) AS level, round(avg(v), 6) AS mean_sigma2, round(max(v), 6) AS max_sigma2 FROM p GROUP BY level""")
def predictive_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictive variance of the classes of each level."""
    g, labels = _events(spark, sf_dir)
    out = estimate.predictive_variance(settle(stats.class_stats(labels, g.nodes)))
    return out.groupBy("level").agg(r(F.avg("sigma2_pred")).alias("mean_sigma2"), r(F.max("sigma2_pred")).alias("max_sigma2"))


def _analytic(loo: bool) -> str:
    need, pick, mean = (3, "c.n - 1", "(c.n * c.mean - n.y) / (c.n - 1)") if loo else (2, "c.n", "c.mean")
    return f"""{_ALL}, f AS (SELECT n.node_id, n.y, l.level, c.n AS cn, {mean} AS value FROM labels l JOIN classes c ON c.level = l.level AND c.cid = l.cid JOIN nodes n USING (node_id) WHERE c.n >= {need}),
p AS (SELECT n.node_id, n.y, coalesce(arg_max(f.value, f.level), (SELECT mean FROM whole)) AS value, coalesce(max(f.level), -1) AS level FROM nodes n LEFT JOIN f USING (node_id) GROUP BY n.node_id, n.y),
s AS (SELECT level, count(*) AS n, sum((value - y) * (value - y)) AS sse FROM p GROUP BY level),
every AS (SELECT unnest([-1, 0, 1, 2, 3]) AS level)
SELECT CAST(e.level AS INT) AS level, CAST(coalesce(s.n, 0) AS BIGINT) AS n, round(coalesce(s.sse, 0.0), 3) AS sse FROM every e LEFT JOIN s USING (level)"""


def _analytic_error(spark: SparkSession, sf_dir: str, loo: bool) -> DataFrame:
    g, labels = _events(spark, sf_dir)
    classes, whole = _model(labels, g.nodes)
    return estimate.analytic_error(classes, whole, LEVELS - 1, 2, loo).select("level", F.col("n").cast("long").alias("n"), r("sse", 3).alias("sse"))


@query(_analytic(False))
def analytic_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training error from class tables alone; the SQL predicts every node."""
    return _analytic_error(spark, sf_dir, False)


@query(_analytic(True))
def analytic_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out error from class tables alone; the SQL predicts every node."""
    return _analytic_error(spark, sf_dir, True)


@query(f"""WITH {sql.ORDERS}, seed AS (SELECT node_id FROM items WHERE l_returnflag = 'R'),
h1 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN seed ON src = node_id), h2 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN h1 ON src = node_id),
d AS (SELECT node_id, min(k) AS distance FROM (SELECT node_id, 0 AS k FROM seed UNION ALL SELECT node_id, 1 FROM h1 UNION ALL SELECT node_id, 2 FROM h2) GROUP BY node_id)
SELECT CAST(coalesce(distance, -1) AS INT) AS distance, count(*) AS n, round(avg(y), 3) AS mean_y FROM nodes LEFT JOIN d USING (node_id) GROUP BY 1""")
def subset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of nodes within two edges of a returned item."""
    g = graphs.orders_graph(spark, sf_dir)
    near = graph.within_hops(g, g.nodes.where("kind = 'R' AND node_id % 1000 <> 0"), 2)
    return g.nodes.join(near, "node_id", "left").groupBy(F.coalesce("distance", F.lit(-1)).alias("distance")).agg(F.count("*").alias("n"), r(F.avg("y"), 3).alias("mean_y"))
