"""Queries on variance arms, training statistics, splits, samples, reports and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica import crossval, predictors
from lattica.functions import elements
from lattica.operators import compare, curate, estimate, graph, groups, lookup, post, sampling, similarity, stats, stereo
from lattica.operators.rounds import settle
from lattica.plans import graphs
from lattica.queries import sql
from lattica.queries.core import _ALL, _EV, LEVELS, _events, _model, r
from lattica.queries.curation import _robust_sql
from lattica.queries.more import _BITS, _CODES, _codes, _items, _near, _PATHS, _paths, _scores, _scores_sql

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


def _arms_sql() -> str:
    terms = {
        "w10": "(k.n * k.msd + 10.0 * s.sigma2) / (k.n - 1 + 10.0)",
        "w30": "(k.n * k.msd + 30.0 * s.sigma2) / (k.n - 1 + 30.0)",
        "sel": "CASE WHEN children > 0 THEN ((children - 1) * coalesce(own, 0.0) + coalesce(s.tau2, 0.0)) / children ELSE 0 END",
        "est": f"coalesce(s.tau2_parent, 0.0) * (1 - ({sql.BAYES}))",
    }
    arms = {"form_b": "w10 + 0.5 * sel + est + sw", "no_sigma2_w": "w10 + 0.5 * sel + est", "alpha_v_30": "w30 + 0.5 * sel + est + sw", "no_selection": "w10 + est + sw", "no_estimation": "w10 + 0.5 * sel + sw"}
    return f"""{_ALL},{sql.scalars()},
own AS (SELECT level - 1 AS level, parent AS cid, greatest(0.0, var_samp(mean) - avg(msd / n)) AS own FROM classes WHERE parent IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
g AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL), sw AS (SELECT sum((value - m) ** 2) / count(*) AS sw FROM events JOIN g USING (user_id, event_type)),
t AS (SELECT k.level, {", ".join(f"{v} AS {k}" for k, v in terms.items())}, sw FROM kids k JOIN scalars s USING (level) LEFT JOIN own o ON o.level = k.level AND o.cid = k.cid, sw)
SELECT CAST(level AS INT) AS level, {", ".join(f"round(avg({v}), 4) AS {k}" for k, v in arms.items())} FROM t GROUP BY level"""


@query(_arms_sql())
def variance_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five predictive variances by level, with the variance within (user, type) as the structures' own."""
    g, labels = _events(spark, sf_dir)
    rows = graphs.table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    within = estimate.within_structure(groups.floor(rows, ["user_id", "event_type"], "value", F.pmod("user_id", F.lit(4))))
    out = estimate.arm_variances(settle(stats.class_stats(labels, g.nodes)), within)
    return out.groupBy("level").agg(*(r(F.avg(a), 4).alias(a) for a in estimate.ARMS))


def _train_sql(loo: bool) -> str:
    need, mean = (3, "(c.n * c.mean - n.y) / (c.n - 1)") if loo else (2, "c.mean")
    return f"""{_ALL}, f AS (SELECT n.node_id, n.y, l.level, {mean} AS value FROM labels l JOIN classes c ON c.level = l.level AND c.cid = l.cid JOIN nodes n USING (node_id) WHERE c.n >= {need}),
p AS (SELECT n.node_id, n.y, coalesce(arg_max(f.value, f.level), (SELECT mean FROM whole)) AS value, max(f.level) AS level FROM nodes n LEFT JOIN f USING (node_id) GROUP BY n.node_id, n.y),
d AS (SELECT c.n, c.mean, n.y FROM labels l JOIN classes c ON c.level = l.level AND c.cid = l.cid JOIN nodes n USING (node_id) WHERE l.level = {LEVELS - 1})
SELECT (SELECT count(*) FROM classes WHERE level = {LEVELS - 1}) AS n_classes, count(*) AS n, round(sum((value - y) ** 2), 2) AS sse, round(sqrt(avg((value - y) ** 2)), 6) AS rmse, round(1 - sum((value - y) ** 2) / (count(*) * var_pop(y)), 6) AS r2,
round(1 - (SELECT sum((y - mean) ** 2) FROM d) / (count(*) * var_pop(y)), 6) AS eta2, round(count(level) / count(*), 6) AS matched_fraction, {", ".join(f"(SELECT round(count(*) FILTER (WHERE n < {t}) / count(*), 6) FROM d) AS frac_support_lt_{t}" for t in (2, 5, 10))} FROM p"""


def _train(spark: SparkSession, sf_dir: str, loo: bool) -> DataFrame:
    g, labels = _events(spark, sf_dir)
    classes, whole = _model(labels, g.nodes)
    out = estimate.train_stats(classes, whole, LEVELS - 1, 2, loo)
    return out.select("n_classes", "n", r("sse", 2).alias("sse"), *(r(c).alias(c) for c in out.columns[3:]))


@query(_train_sql(False))
def train_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training statistics from class tables alone; the SQL predicts every node."""
    return _train(spark, sf_dir, False)


@query(_train_sql(True))
def train_stats_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As train_stats, each node left out of its class."""
    return _train(spark, sf_dir, True)


@query(f"""{_CODES}, a AS (SELECT radius, key, avg(y) AS mean, count(*) AS n FROM e GROUP BY radius, key),
told AS (SELECT e.k, any_value(e.y) AS y, arg_max(a.mean, e.radius) FILTER (WHERE a.n >= 2) AS value, max(e.radius) FILTER (WHERE a.n >= 2) AS radius FROM e JOIN a USING (radius, key) GROUP BY e.k)
SELECT count(*) AS n, round(sum((y - coalesce(value, (SELECT avg(y) FROM told))) ** 2), 1) AS sse, round(count(radius) / count(*), 6) AS matched_fraction FROM told""")
def prefix_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training error of prefix lookup from the prefixes' statistics alone; the SQL looks up every part."""
    rows = _codes(spark, sf_dir)
    classes = settle(lookup.prefix_classes(lookup.prefix_sums(rows, "code", "y", "/", 3), "/"))
    out = estimate.train_stats(classes, stats.global_stats(rows), 2, 2)
    return out.select("n", r("sse", 1).alias("sse"), r("matched_fraction").alias("matched_fraction"))


@query(f"{_PATHS}, a AS (SELECT node, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std FROM (SELECT unnest(path) AS node, y FROM p) GROUP BY node) SELECT left(node, 1) AS kind, count(*) AS n_nodes, CAST(sum(n) AS BIGINT) AS n, round(avg(mean), 4) AS mean, round(avg(std), 4) AS std FROM a GROUP BY 1")
def node_stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics on path nodes fitted on three shards and merged: those of all rows."""
    p = _paths(spark, sf_dir)
    s = lookup.merge_node_stats([lookup.path_stats(p.where(F.col("k") % 3 == k), "path", "y") for k in range(3)])
    return s.groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n"), r(F.avg("mean"), 4).alias("mean"), r(F.avg("std"), 4).alias("std"))


@query("SELECT count(*) AS n, CAST(sum(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority), 1, 8))::BIGINT) AS BIGINT) AS digest FROM orders")
def store_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the orders' priorities in the order of their keys."""
    return lookup.digest(graphs.table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority")


@query("SELECT count(*) AS n, round(avg(p_retailprice), 4) AS price FROM lineitem JOIN part ON p_partkey = l_partkey")
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their part's price; an item without exactly one part would be an error."""
    keys = graphs.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    out = lookup.exact_rows(keys, graphs.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_partkey"])
    return out.agg(F.count("*").alias("n"), r(F.avg("p_retailprice"), 4).alias("price"))


_DRAWN = """i AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS row, l_quantity AS q FROM lineitem),
z AS (SELECT k, count(*) * (count(*) - 1) // 2 AS pairs FROM i GROUP BY k HAVING count(*) > 1),
t AS (SELECT k, u.i * greatest(1, pairs // 100) + (u.i * 2654435761) % greatest(1, pairs // 100) AS t FROM z, unnest(range(0, least(pairs, 100))) AS u(i)),
n AS (SELECT k, CAST(floor((1 + sqrt(1 + 8.0 * t)) / 2) AS BIGINT) AS b, t FROM t), m AS (SELECT k, b, t - b * (b - 1) // 2 AS a FROM n)"""


@query(f"WITH {_DRAWN} SELECT count(*) AS n, count(DISTINCT m.k) AS n_keys, round(avg(abs(x.q - y.q)), 6) AS mean_d, CAST(sum(m.a * 7 + m.b) AS BIGINT) AS check_sum FROM m JOIN i x ON x.k = m.k AND x.row = m.a JOIN i y ON y.k = m.k AND y.row = m.b")
def drawn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred pairs of each supplier's items at most, spread over all of its pairs."""
    items = graphs.table(spark, sf_dir, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*items.columns)) - 1
    rows = settle(items.select(F.col("l_suppkey").alias("k"), number.alias("row"), F.col("l_quantity").alias("q")))
    p = groups.drawn_pairs(rows, "k", ["row"], "row", "q", 100)
    return p.agg(F.count("*").alias("n"), F.countDistinct("k").alias("n_keys"), r(F.avg("d")).alias("mean_d"), F.sum(F.col("a") * 7 + F.col("b")).alias("check_sum"))


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ((o_orderkey % 4294967296) * CAST(2654435761 AS HUGEINT)) % 4294967296, o_orderkey) AS n FROM orders)
SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_customers, CAST(sum(o_orderkey) AS BIGINT) AS check_sum FROM h WHERE n <= 5""")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five orders of each customer at most, as a sample."""
    out = sampling.capped(graphs.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 5)
    return out.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"), F.sum("o_orderkey").alias("check_sum"))


@query("""WITH c AS (SELECT user_id, count(*) AS size FROM events GROUP BY user_id), o AS (SELECT *, sum(size) OVER (ORDER BY size, user_id) - size AS before, sum(size) OVER () AS total FROM c),
f AS (SELECT min(before) FILTER (WHERE before + size > 0.8 * total) AS f FROM o), s AS (SELECT min(before) FILTER (WHERE before >= f AND before + size - f > 0.1 * total) AS s FROM o, f)
SELECT CASE WHEN f IS NULL OR before < f THEN 'train' WHEN s IS NULL OR before < s THEN 'val' ELSE 'test' END AS split, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_rows FROM o, f, s GROUP BY 1""")
def sequential_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users from the smallest on to train, validation and test."""
    c = graphs.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("size"))
    return sampling.sequential_fill(c, ["size", "user_id"], "size", 0.8, 0.1).groupBy("split").agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_rows"))


def _deal_sql(source: str, shares: list[float], names: list[str]) -> str:
    lacks = ", ".join(f"{x} * total - filled[{k}]" for k, x in enumerate(shares, 1))
    case = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names, 1))
    return f"""o AS (SELECT cluster, size, row_number() OVER (ORDER BY size DESC, cluster) AS i, sum(size) OVER () AS total FROM {source}),
d(i, filled, cluster, size, k) AS (SELECT CAST(0 AS BIGINT), {[0] * len(shares)}::DOUBLE[], CAST(NULL AS BIGINT), CAST(0 AS BIGINT), 0 UNION ALL
  SELECT i, list_transform(filled, lambda x, j: CASE WHEN j = k THEN x + size ELSE x END), cluster, size, k FROM (
    SELECT o.i, filled, o.cluster, o.size, list_position([{lacks}], list_max([{lacks}])) AS k FROM d JOIN o ON o.i = d.i + 1)),
dealt AS (SELECT cluster, size, CASE k {case} END AS split FROM d WHERE i > 0)"""


@query(f"WITH RECURSIVE c AS (SELECT l_suppkey AS cluster, count(*) AS size FROM lineitem GROUP BY 1), {_deal_sql('c', [0.8, 0.1, 0.1], ['train', 'val', 'test'])} SELECT split, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_rows, CAST(sum(cluster) AS BIGINT) AS check_sum FROM dealt GROUP BY split")
def supplier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, largest first, each to the split that lacks most."""
    c = graphs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg(F.count("*").alias("size"))
    out = similarity.fill_splits(c, [("train", 0.8), ("val", 0.1), ("test", 0.1)]).join(c, "cluster")
    return out.groupBy("split").agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_rows"), F.sum("cluster").alias("check_sum"))


@query(f"WITH RECURSIVE c AS (SELECT p_brand, p_size, count(*) AS size, min(p_partkey) AS cluster FROM part GROUP BY ALL), {_deal_sql('c', [0.25] * 4, ['s00', 's01', 's02', 's03'])} SELECT split, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_rows, CAST(sum(cluster) AS BIGINT) AS check_sum FROM dealt GROUP BY split")
def cluster_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and size kept together in four shards."""
    c = graphs.table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("size"), F.min("p_partkey").alias("cluster"))
    out = similarity.fill_splits(c, similarity.shard_names(4)).join(c, "cluster")
    return out.groupBy("split").agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_rows"), F.sum("cluster").alias("check_sum"))


@query()
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers to train and test so that each return flag is shared out alike."""
    items = graphs.table(spark, sf_dir, "lineitem")
    c = items.groupBy(F.col("l_suppkey").alias("cluster")).agg(*(F.count(F.when(F.col("l_returnflag") == f, 1)).alias(f) for f in ("A", "N", "R")))
    out = similarity.stratified_fill(c, ["A", "N", "R"], [("train", 0.9), ("test", 0.1)]).join(c, "cluster")
    return out.groupBy("split").agg(F.count("*").alias("n_clusters"), *(F.sum(f).alias(f) for f in ("A", "N", "R")))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE size = 1) AS singles, max(size) AS largest, round(quantile_cont(size, 0.5), 4) AS p50, round(quantile_cont(size, 0.9), 4) AS p90, round(quantile_cont(size, 0.99), 4) AS p99 FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1)")
def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the customers' numbers of orders are distributed."""
    out = groups.size_report(graphs.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("size")), "size")
    return out.select("n", "singles", "largest", *(r(c, 4).alias(c) for c in ("p50", "p90", "p99")))


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS finished, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS mean_finished, round(quantile_cont(o_totalprice, 0.5), 3) AS median, round(quantile_cont(o_totalprice, 0.95), 3) AS p95, max(o_totalprice) AS largest FROM orders GROUP BY o_orderpriority""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, shares, conditional means and quantiles of the orders of each priority."""
    done, x = F.col("o_orderstatus") == "F", F.col("o_totalprice")
    return graphs.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.avg(done.cast("double"))).alias("finished"), r(F.avg(F.when(done, x)), 2).alias("mean_finished"), r(F.percentile(x, 0.5), 3).alias("median"), r(F.percentile(x, 0.95), 3).alias("p95"), F.max(x).alias("largest"))


@query(f"""WITH {_BITS}, d AS (SELECT a, b, 1 - "both" / either AS d FROM near), t AS (SELECT list_min([x.d, y.d, z.d]) AS d1 FROM d x JOIN d y ON y.a = x.b JOIN d z ON z.a = x.a AND z.b = y.b)
SELECT count(*) AS n, round(quantile_cont(d1, 0.999), 6) AS q999, round(max(d1), 6) AS longest FROM t""")
def triangle_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile and maximum of the triangles' shortest sides."""
    _, pairs = _near(spark, sf_dir)
    out = groups.triangle_bounds(groups.shortest_sides(pairs.select("a", "b", (1 - F.col("both") / F.col("either")).alias("d"))))
    return out.select("n", r("q999").alias("q999"), r("longest").alias("longest"))


@query(f"{_scores_sql('[0, 1, 2, 3]')}, m AS (SELECT depth, avg(value) AS mean FROM scores GROUP BY depth) SELECT round(min(mean), 6) AS mean, CAST(arg_min(depth, mean) AS INT) AS depth FROM m")
def best_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best mean error over depths."""
    out = compare.best_value(compare.curve(_scores(spark, sf_dir), 5))
    return out.select(r("mean").alias("mean"), "depth")


@query(f"""{_scores_sql('[0, 1, 2, 3]')}, s AS (SELECT * FROM scores WHERE NOT (depth = 2 AND fold = 3)) SELECT CAST(m.depth AS VARCHAR) AS method, CAST(f.fold AS BIGINT) AS fold FROM (SELECT DISTINCT depth FROM s) m, (SELECT DISTINCT fold FROM s) f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.depth = m.depth AND s.fold = f.fold)""")
def unmatched_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that one depth lacks after one of its scores was lost."""
    s = _scores(spark, sf_dir).where("NOT (depth = 2 AND fold = 3)")
    return compare.unmatched(s.select(F.col("depth").cast("string").alias("method"), F.lit(0).alias("repeat"), "fold", "value")).select("method", "fold")


@query(f"{_scores_sql('[0, 1, 2, 3]')} SELECT CAST(depth AS INT) AS depth, count(*) AS k, round(avg(value), 6) AS mean, round(sqrt((1.0 / count(*) + 0.25) * var_samp(value)), 6) AS se FROM scores GROUP BY depth")
def corrected_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over folds with the corrected resampled error."""
    return compare.corrected_se(_scores(spark, sf_dir), ["depth"], 0.25).select("depth", "k", r("mean").alias("mean"), r("se").alias("se"))


@query()
def simultaneous_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the depths' means; depths whose intervals do not overlap differ."""
    s = _scores(spark, sf_dir).select(F.col("depth").cast("string").alias("method"), F.lit(0).alias("repeat"), "fold", "value")
    return spark.createDataFrame(compare.simultaneous_intervals(s), "method string, mean double, low double, high double")


@query("""WITH x AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS label FROM part), y AS (SELECT DISTINCT p_brand AS label FROM part)
SELECT 'number' AS kind, label, row_number() OVER (ORDER BY CAST(label AS DOUBLE)) - 1 AS place FROM x UNION ALL SELECT 'text', label, row_number() OVER (ORDER BY label) - 1 FROM y""")
def axis_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the order of an axis: sizes are numbers, brands are texts."""
    part = graphs.table(spark, sf_dir, "part")
    of = lambda kind, column: compare.axis_order(part.select(column.alias("label")), "label").select(F.lit(kind).alias("kind"), "label", F.col("place").cast("long").alias("place"))
    return of("number", F.col("p_size").cast("string")).unionAll(of("text", F.col("p_brand")))


@query("""WITH k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(k AS VARCHAR)) - 1 AS ordinal FROM k)
SELECT CASE WHEN k < 25 THEN '0-24' WHEN k < 50 THEN '25-49' ELSE '50-' END AS bucket, count(*) AS n, count(*) FILTER (WHERE k = ordinal) AS n_same, CAST(sum(abs(k - ordinal)) AS BIGINT) AS apart FROM o GROUP BY 1""")
def text_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the users' events by the text of their number, by bucket of the number."""
    k = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    out = curate.text_ordinals(graphs.table(spark, sf_dir, "events").select("user_id", k.alias("k")), "user_id", "k", "ordinal")
    bucket = F.when(F.col("k") < 25, "0-24").when(F.col("k") < 50, "25-49").otherwise("50-")
    return out.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count(F.when(F.col("k") == F.col("ordinal"), 1)).alias("n_same"), F.sum(F.abs(F.col("k") - F.col("ordinal"))).alias("apart"))


@query("SELECT n_groups, count(*) AS n FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n_groups FROM lineitem GROUP BY 1) WHERE n_groups > 1 GROUP BY 1")
def keys_in_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that more than one supplier delivers, by the number of suppliers."""
    return groups.in_several(graphs.table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").groupBy("n_groups").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, max(l_shipdate) AS of FROM lineitem GROUP BY 1)
SELECT of IS NULL AS missing, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS check_sum FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE of IS NULL OR of < o_orderdate GROUP BY 1""")
def missing_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without items, or whose newest item was shipped before the order was made."""
    items = graphs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    out = curate.stale(graphs.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), items, "o_orderkey", "o_orderdate", "l_shipdate")
    return out.groupBy("missing").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("check_sum"))


_VECTORS = "WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = graphs.table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


@query(f"{_VECTORS} SELECT vec_id, round(list_inner_product(x, y) / (list_inner_product(x, x) + list_inner_product(y, y) - list_inner_product(x, y)), 6) AS similarity FROM p")
def generalised_tanimoto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised Tanimoto similarity of every vector and the next."""
    return _neighbours(spark, sf_dir).select("vec_id", r(similarity.generalised_tanimoto(F.col("x"), F.col("y"))).alias("similarity"))


@query(f"{_VECTORS} SELECT vec_id, round(list_max(list_transform(list_zip(list_sort(x), list_sort(y)), lambda z: abs(z[1] - z[2]))), 6) AS largest FROM p")
def sorted_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest difference of the sorted components of every vector and the next."""
    wide = lambda c: F.transform(c, lambda v: v.cast("double"))
    return _neighbours(spark, sf_dir).select("vec_id", r(groups.sorted_discrepancy(wide("x"), wide("y"))).alias("largest"))


@query("""WITH m AS (SELECT l_orderkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey AS g, abs(l_extendedprice - m) AS e, l_quantity AS s FROM lineitem JOIN m USING (l_orderkey)),
p AS (SELECT (rank() OVER (PARTITION BY g ORDER BY e) + (count(*) OVER (PARTITION BY g, e) - 1) / 2.0) / count(*) OVER (PARTITION BY g) AS re, (rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0) / count(*) OVER (PARTITION BY g) AS rs FROM e)
SELECT count(*) AS n, round(corr(re, rs), 6) AS rho FROM p""")
def rank_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the ranks of errors and of a stated spread within orders."""
    items = graphs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
    rows = items.withColumn("e", F.abs(F.col("l_extendedprice") - F.avg("l_extendedprice").over(Window.partitionBy("l_orderkey"))))
    out = post.average_rank(post.average_rank(rows, "l_orderkey", "e", "re"), "l_orderkey", "l_quantity", "rs")
    return out.agg(F.count("*").alias("n"), r(F.corr("re", "rs")).alias("rho"))


@query("""WITH i AS (SELECT l_orderkey, l_extendedprice AS x, o_totalprice AS t, l_quantity AS s, 1000 * l_quantity AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
n AS (SELECT *, x + (t - sum(x) OVER w) / count(*) OVER w AS e, x + (t - sum(x) OVER w) * s / sum(s) OVER w AS d FROM i WINDOW w AS (PARTITION BY l_orderkey))
SELECT count(*) AS n, round(sqrt(avg((x - y) ** 2)), 3) AS raw_rmse, round(avg(abs(x - y)), 3) AS raw_mae, round(sqrt(avg((e - y) ** 2)), 3) AS equal_rmse, round(avg(abs(e - y)), 3) AS equal_mae, round(sqrt(avg((d - y) ** 2)), 3) AS std_rmse, round(avg(abs(d - y)), 3) AS std_mae FROM n""")
def score_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of raw and normalised prices in one row."""
    rows = _items(spark, sf_dir).withColumn("y", 1000 * F.col("l_quantity"))
    rows = post.normalise(rows, "l_orderkey", "l_extendedprice", "o_totalprice", to="equal")
    rows = post.normalise(rows, "l_orderkey", "l_extendedprice", "o_totalprice", "l_quantity", 1, to="std")
    out = rows.agg(F.count("*").alias("n"), *post.bundle({"raw": "l_extendedprice", "equal": "equal", "std": "std"}, "y"))
    return out.select("n", *(r(c, 3).alias(c) for c in out.columns[1:]))


@query(f"""{_robust_sql().rsplit(' SELECT g AS', 1)[0]}, z AS (SELECT l_linestatus, l_returnflag AS g, l_extendedprice - slope * l_quantity - intercept AS off FROM lineitem JOIN f3 ON g = l_returnflag),
s AS (SELECT g, 1.4826 * quantile_disc(abs(off), 0.5) AS spread FROM z GROUP BY g) SELECT l_linestatus, count(*) AS n, round(sqrt(avg((off / spread) ** 2)), 4) AS rms FROM z JOIN s USING (g) GROUP BY l_linestatus""")
def residual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals from the flags' robust lines, in robust deviations, by line status."""
    items = graphs.table(spark, sf_dir, "lineitem")
    fit = curate.robust_line(items, "l_returnflag", "l_quantity", "l_extendedprice")
    out = curate.residual_scores(items.select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"), fit, "l_returnflag", "l_quantity", "l_extendedprice", "l_linestatus")
    return out.select("l_linestatus", "n", r("rms", 4).alias("rms"))


_FLAGS = ("A", "N", "R")
_MASK = " + ".join(f"coalesce(max(CASE WHEN f = '{f}' THEN CASE WHEN distance <= 1 THEN 3 ELSE 2 END END), 0) * {4**k}" for k, f in enumerate(_FLAGS))


@query(f"""WITH {sql.ORDERS}, seed AS (SELECT node_id, l_returnflag AS f FROM items),
h1 AS (SELECT DISTINCT dst AS node_id, f FROM edges JOIN seed ON src = node_id), h2 AS (SELECT DISTINCT dst AS node_id, f FROM edges JOIN h1 ON src = node_id),
d AS (SELECT node_id, f, min(k) AS distance FROM (SELECT node_id, f, 0 AS k FROM seed UNION ALL SELECT node_id, f, 1 FROM h1 UNION ALL SELECT node_id, f, 2 FROM h2) GROUP BY ALL),
m AS (SELECT n.node_id, {_MASK} AS mask FROM nodes n LEFT JOIN d USING (node_id) GROUP BY n.node_id) SELECT CAST(mask AS BIGINT) AS mask, count(*) AS n FROM m GROUP BY mask""")
def subset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by six bits: within one and two edges of an item of each flag."""
    g = graphs.orders_graph(spark, sf_dir)
    marks = {f: g.nodes.where((F.col("kind") == f) & (F.col("node_id") % 1000 != 0)) for f in _FLAGS}
    return graph.subset_masks(g, marks).groupBy("mask").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_orderkey, coalesce(bool_or(l_linestatus IS NULL OR l_linestatus <> 'F'), true) AS incomplete, coalesce(max(l_discount) > 0.08, false) AS geometry FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT CASE WHEN incomplete THEN 'incomplete' WHEN geometry THEN 'geometry' ELSE '' END AS reason, count(*) AS n FROM s GROUP BY 1""")
def incomplete_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why orders are left out: an unfinished item, or none, comes before any other reason."""
    items = graphs.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.coalesce(F.col("l_linestatus") != "F", F.lit(True))).alias("open"), F.max("l_discount").alias("discount"))
    rows = graphs.table(spark, sf_dir, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    reason = curate.first_reason({"incomplete": F.coalesce("open", F.lit(True)), "geometry": F.coalesce(F.col("discount") > 0.08, F.lit(False))})
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_returnflag AS subset, l_suppkey, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_members FROM lineitem GROUP BY ALL) SELECT subset, CAST(sum(n_rows) AS BIGINT) AS n, count(*) AS n_groups, CAST(sum(n_rows * n_rows) AS BIGINT) AS n_counted, CAST(sum(n_rows * n_members) AS BIGINT) AS n_members FROM g GROUP BY subset""")
def separated_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in a store for each flag, with the suppliers' counts made anew in each."""
    items = graphs.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_partkey")
    parts = groups.separate(items, F.col("l_returnflag"), ["l_suppkey"], "l_partkey", list(_FLAGS))
    each = [p.agg(F.lit(name).alias("subset"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("n_groups"), F.sum("n_rows").alias("n_counted"), F.sum("n_members").alias("n_members")) for name, p in parts.items()]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query("""WITH e AS (SELECT event_type, value AS p, 50.0 AS t, value < 5 OR event_id % 7 = 0 AS bad FROM events) SELECT event_type, count(*) FILTER (WHERE NOT bad) AS n, round(avg(abs(p - t)) FILTER (WHERE NOT bad), 6) AS mae, count(*) FILTER (WHERE bad) AS missing FROM e GROUP BY 1""")
def missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors where predictions below 5 are NaN and every seventh target is missing."""
    rows = graphs.table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") < 5, float("nan")).otherwise(F.col("value")).alias("p"), F.when(F.col("event_id") % 7 != 0, 50.0).alias("t"))
    out = rows.groupBy("event_type").agg(*post.errors("p", "t"))
    return out.select("event_type", "n", r("mae").alias("mae"), "missing")


@query("""WITH z AS (SELECT CAST(p_size AS INT) AS z FROM part) SELECT z, CASE WHEN z = 1 THEN '1' WHEN z = 2 THEN '18' WHEN z <= 4 THEN CAST(z - 2 AS VARCHAR) WHEN z <= 10 THEN CAST(z + 8 AS VARCHAR) WHEN z <= 12 THEN CAST(z - 10 AS VARCHAR) WHEN z <= 18 THEN CAST(z AS VARCHAR) WHEN z <= 36 THEN CAST(z - 18 AS VARCHAR) ELSE CAST(z - 36 AS VARCHAR) END AS "group",
CASE WHEN z IN (1, 2, 3, 4, 11, 12, 19, 20, 37, 38) THEN 's' WHEN z BETWEEN 5 AND 10 OR z BETWEEN 13 AND 18 OR z BETWEEN 31 AND 36 OR z BETWEEN 49 AND 54 THEN 'p' ELSE 'd' END AS block, count(*) AS n FROM z GROUP BY ALL""")
def groups_and_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes read as atomic numbers, with group and block."""
    z = F.col("p_size")
    return graphs.table(spark, sf_dir, "part").groupBy(z.alias("z"), elements.group(z).alias("group"), elements.block(z).alias("block")).agg(F.count("*").alias("n"))


@query("SELECT format('{:.1f}', round_even(2 * l_tax * 30, 0) / 2) AS step, count(*) AS n FROM lineitem GROUP BY 1")
def half_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxes in half steps, as texts of one decimal."""
    return graphs.table(spark, sf_dir, "lineitem").groupBy(elements.half_steps(F.col("l_tax") * 30).alias("step")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT least(p_name, reverse(p_name))) AS n_keys, count(*) FILTER (WHERE reverse(p_name) < p_name) AS n_turned FROM part")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and their mirror images under one key, the smaller of both."""
    key = elements.canonical_key(F.col("p_name"), F.reverse("p_name"))
    return graphs.table(spark, sf_dir, "part").agg(F.countDistinct(key).alias("n_keys"), F.count(F.when(F.reverse("p_name") < F.col("p_name"), 1)).alias("n_turned"))


@query("SELECT split_part(p_type, ' ', 1) AS subset, count(*) AS n FROM part GROUP BY 1")
def prefix_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the first word of their type; a prefix that is not listed would be an error."""
    part = graphs.table(spark, sf_dir, "part")
    known = sorted(x["w"] for x in part.select(F.split("p_type", " ")[0].alias("w")).distinct().collect())  # a handful of words
    return part.groupBy(elements.subset_of(F.col("p_type"), {f"{w} ": w for w in known} | {w: w for w in known}).alias("subset")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) SELECT count(*) AS n, round(sqrt(avg((value - (SELECT avg(value) FROM events WHERE user_id % 5 <> 0)) ** 2)), 6) AS rmse FROM events WHERE user_id % 5 = 0""")
def global_mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the mean of the training users on held-out ones."""
    g = graphs.events_graph(spark, sf_dir)
    train, test = g.nodes.where("graph_id % 5 <> 0"), g.nodes.where("graph_id % 5 = 0")
    p = predictors.build("global_mean").fit(train, g.edges).predict(test, g.edges).join(test.select("node_id", "y"), "node_id")
    out = p.agg(*post.errors("value", "y"))
    return out.select("n", r("rmse").alias("rmse"))


@query(f"""{_EV}, sh AS (SELECT DISTINCT graph_id % 10 AS shard FROM nodes), rp AS (SELECT unnest([0, 1]) AS repeat),
plan AS (SELECT repeat, shard, ntile(5) OVER (PARTITION BY repeat ORDER BY ((shard + repeat) * CAST(2654435761 AS HUGEINT)) % 4294967296, shard) - 1 AS fold FROM sh, rp),
fd AS (SELECT DISTINCT repeat, fold FROM plan),
c AS (SELECT fd.repeat, fd.fold, level, cid, count(*) AS n, avg(y) AS mean FROM labels JOIN nodes USING (node_id) JOIN plan p ON p.shard = graph_id % 10 JOIN fd ON fd.repeat = p.repeat AND fd.fold <> p.fold GROUP BY ALL),
w AS (SELECT fd.repeat, fd.fold, avg(y) AS mean FROM nodes JOIN plan p ON p.shard = graph_id % 10 JOIN fd ON fd.repeat = p.repeat AND fd.fold <> p.fold GROUP BY ALL),
a AS (SELECT * FROM (VALUES ('one', 1), ('three', 3)) AS v(variant, need), (VALUES (1), (3)) AS d(depth)),
x AS (SELECT a.variant, a.depth, p.repeat, p.fold, n.node_id, any_value(n.y) AS y, coalesce(arg_max(c.mean, l.level) FILTER (WHERE c.n >= a.need), any_value(w.mean)) AS value
  FROM nodes n JOIN plan p ON p.shard = n.graph_id % 10 JOIN labels l USING (node_id) JOIN a ON l.level <= a.depth JOIN w ON w.repeat = p.repeat AND w.fold = p.fold LEFT JOIN c ON c.repeat = p.repeat AND c.fold = p.fold AND c.level = l.level AND c.cid = l.cid GROUP BY ALL)
SELECT variant, CAST(depth AS INT) AS depth, CAST(repeat AS INT) AS repeat, CAST(fold AS INT) AS fold, count(*) AS n, round(sqrt(avg((value - y) ** 2)), 6) AS rmse, round(avg(abs(value - y)), 6) AS mae FROM x GROUP BY ALL""")
def cv_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two repeats of five folds of ten shards, two depths and two supports, from one fit of each shard."""
    g, labels = _events(spark, sf_dir)
    rows = labels.join(g.nodes.select("node_id", F.pmod("graph_id", F.lit(10)).alias("shard"), "y"), "node_id")
    out = crossval.run(rows, 5, 2, [1, 3], [crossval.Variant("one", 1), crossval.Variant("three", 3)])
    return out.select("variant", "depth", "repeat", "fold", "n", r("rmse").alias("rmse"), r("mae").alias("mae"))


_SLOTS = """i AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n, (l_partkey * 7919) % 1000 AS fp FROM lineitem),
s AS (SELECT l_orderkey, max(CASE WHEN n = 1 THEN fp END) AS f0, max(CASE WHEN n = 2 THEN fp END) AS f1, max(CASE WHEN n = 3 THEN fp END) AS f2, max(CASE WHEN n = 4 THEN fp END) AS f3, count(*) AS k FROM i GROUP BY 1)"""


def _slots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first four items of every order as nodes n0 to n3, and fingerprints of the nodes."""
    items = graphs.table(spark, sf_dir, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*items.columns))
    rows = settle(items.select("l_orderkey", number.alias("n"), (F.col("l_orderkey") * 1000 + number).alias("node_id"), (F.col("l_partkey") * 7919 % 1000).alias("fp")))
    wide = rows.groupBy("l_orderkey").agg(*(F.max(F.when(F.col("n") == k + 1, F.col("node_id"))).alias(f"n{k}") for k in range(4)), F.count("*").alias("k"))
    return wide, rows.select("node_id", "fp")


@query(f"""WITH {_SLOTS}, c AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS parity, f0 = f1 OR f0 = f2 OR f1 = f2 OR coalesce(f0 = f3 OR f1 = f3 OR f2 = f3, false) AS tie,
(CASE WHEN f0 > f1 THEN 1 ELSE 0 END + CASE WHEN f0 > f2 THEN 1 ELSE 0 END + CASE WHEN f1 > f2 THEN 1 ELSE 0 END + CASE WHEN f0 > f3 THEN 1 ELSE 0 END + CASE WHEN f1 > f3 THEN 1 ELSE 0 END + CASE WHEN f2 > f3 THEN 1 ELSE 0 END) % 2 AS odd FROM s WHERE k >= 3)
SELECT CAST(CASE WHEN tie THEN 0 WHEN (CASE WHEN odd = 1 THEN -parity ELSE parity END) > 0 THEN 1 ELSE 2 END AS INT) AS code, count(*) AS n FROM c GROUP BY 1""")
def tetrahedral_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of three items or more read as centres, their parts' numbers as fingerprints."""
    wide, fp = _slots(spark, sf_dir)
    centres = wide.where("k >= 3").select(F.col("l_orderkey").alias("centre"), "n0", "n1", "n2", "n3", F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1).alias("parity"))
    return stereo.tetrahedral_codes(centres, fp).groupBy("code").agg(F.count("*").alias("n"))


@query(f"""WITH {_SLOTS}, b AS (SELECT x.f0 AS a1, x.f1 AS a2, y.f0 AS b1, y.f1 AS b2, x.l_orderkey % 2 AS cis FROM s x JOIN s y ON y.l_orderkey = x.l_orderkey + 1),
w AS (SELECT cis, a2 IS NULL OR a1 > a2 AS af, b2 IS NULL OR b1 > b2 AS bf, coalesce(a1 = a2, false) OR coalesce(b1 = b2, false) AS tie FROM b)
SELECT CAST(CASE WHEN tie THEN 0 WHEN (cis + af::INT + bf::INT) % 2 = 1 THEN 1 ELSE 2 END AS INT) AS code, count(*) AS n FROM w GROUP BY 1""")
def cis_trans_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring orders read as double bonds, their first two items as the atoms that control the ends."""
    wide, fp = _slots(spark, sf_dir)
    a = wide.select("l_orderkey", F.col("n0").alias("a1"), F.col("n1").alias("a2"))
    b = wide.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("n0").alias("b1"), F.col("n1").alias("b2"))
    bonds = a.join(b, "l_orderkey").select(F.col("l_orderkey").alias("bond"), "a1", "a2", "b1", "b2", (F.col("l_orderkey") % 2).alias("cis"))
    return stereo.cis_trans_codes(bonds, fp).groupBy("code").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderkey AS k, coalesce(list(DISTINCT l_returnflag) FILTER (WHERE l_quantity > 25), []) AS p, coalesce(list(DISTINCT l_returnflag) FILTER (WHERE l_discount > 0.03), []) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
d AS (SELECT len(p) + len(q) AS every, len(list_filter(p, lambda x: NOT list_contains(q, x))) AS po, len(list_filter(q, lambda x: NOT list_contains(p, x))) AS qo FROM p)
SELECT CASE WHEN every = 0 THEN 'none' WHEN po = 0 AND qo = 0 THEN 'same' WHEN po = 0 THEN 'fewer' WHEN qo = 0 THEN 'more' ELSE 'other' END AS verdict, count(*) AS n FROM d GROUP BY 1""")
def set_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the flags of an order's large items compare with those of its cheap ones."""
    items = graphs.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_returnflag"))).alias("p"), F.collect_set(F.when(F.col("l_discount") > 0.03, F.col("l_returnflag"))).alias("q"))
    rows = graphs.table(spark, sf_dir, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    empty = F.array().cast("array<string>")
    return rows.groupBy(curate.verdict(F.coalesce("p", empty), F.coalesce("q", empty)).alias("verdict")).agg(F.count("*").alias("n"))
