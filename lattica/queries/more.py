"""Queries on post-processing, lookups, groups of equal rows, similarity, sampling and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import elements
from lattica.operators import compare, groups, lookup, post, predict, refine, sampling, similarity, stats
from lattica.operators.rounds import settle
from lattica.plans import graphs
from lattica.queries import sql
from lattica.queries.core import _ALL, _EV, _SPLIT, _events, _model, _split, r

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


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the price and the residual structure of their order."""
    items = graphs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    orders = graphs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return items.join(orders, "l_orderkey")


def _normalise_sql(power: int) -> str:
    share = {0: "1.0", 1: "s", 2: "s * s"}[power]
    return f"""WITH i AS (SELECT l_orderkey, l_extendedprice AS x, o_totalprice AS t, CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0.1 END AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
n AS (SELECT l_orderkey, x, t, x + (t - sum(x) OVER w) * ({share}) / sum({share}) OVER w AS v FROM i WINDOW w AS (PARTITION BY l_orderkey)),
g AS (SELECT l_orderkey, abs(sum(v) - any_value(t)) AS residual FROM n GROUP BY l_orderkey)
SELECT count(*) AS n, round(sqrt(avg((v - x) * (v - x))), 3) AS rmse, (SELECT count(*) FROM g WHERE residual > 0.001) AS n_off FROM n"""


def _normalise(spark: SparkSession, sf_dir: str, power: int) -> DataFrame:
    std = F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))  # missing counts as the least
    rows = post.normalise(_items(spark, sf_dir).withColumn("std", std), "l_orderkey", "l_extendedprice", "o_totalprice", "std", power)
    d = F.col("normalised") - F.col("l_extendedprice")
    off = rows.groupBy("l_orderkey").agg(F.abs(F.sum("normalised") - F.first("o_totalprice")).alias("residual")).agg(F.count(F.when(F.col("residual") > 0.001, 1)).alias("n_off"))
    return rows.agg(F.count("*").alias("n"), r(F.sqrt(F.avg(d * d)), 3).alias("rmse")).crossJoin(off)


@query(_normalise_sql(0))
def normalize_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item prices shifted equally so that they add up to their order's total."""
    return _normalise(spark, sf_dir, 0)


@query(_normalise_sql(1))
def normalize_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As normalize_equal, in proportion to a standard deviation."""
    return _normalise(spark, sf_dir, 1)


@query(_normalise_sql(2))
def normalize_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As normalize_equal, in proportion to a variance."""
    return _normalise(spark, sf_dir, 2)


@query("""WITH g AS (SELECT l_orderkey, sum(l_extendedprice) AS p, any_value(o_totalprice) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)
SELECT count(*) AS n, round(avg(abs(p - t)), 3) AS mae, round(sqrt(avg((p - t) * (p - t))), 3) AS rmse, round(1 - sum((p - t) * (p - t)) / (count(*) * var_pop(t)), 6) AS r2 FROM g""")
def sum_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of sums per order against the known totals."""
    g = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("p"), F.first("o_totalprice").alias("t"))
    out = g.agg(*post.errors("p", "t"))
    return out.select("n", r("mae", 3).alias("mae"), r("rmse", 3).alias("rmse"), r("r2").alias("r2"))


@query(f"""{_EV},\n{_SPLIT},\n{sql.model('train')},\n{sql.predictions(3)},
e AS (SELECT matched_level, y - value AS d, (SELECT msd FROM whole) AS v FROM pred)
SELECT CAST(matched_level AS INT) AS matched_level, count(*) AS n, round(avg(0.5 * (ln(2 * pi() * v) + d * d / v)), 6) AS nll, round(avg(d * d / v), 6) AS z2,
{", ".join(f"round(avg(CASE WHEN d * d / v < {q * q!r} THEN 1.0 ELSE 0.0 END), 6) AS within_{p}" for p, q in post.COVERAGE.items())} FROM e GROUP BY matched_level""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of a constant predictive variance by matched level."""
    g, labels = _events(spark, sf_dir)
    train, test = _split(g)
    classes, whole = _model(labels, train)
    pred = predict.back_off(labels.join(test.select("node_id"), "node_id", "left_semi"), classes, whole, 3).join(test, "node_id")
    rows = pred.crossJoin(F.broadcast(whole.select(F.col("msd").alias("v"))))  # one row
    out = rows.groupBy("matched_level").agg(F.count("*").alias("n"), *post.calibration(F.col("y") - F.col("value"), F.col("v")))
    return out.select("matched_level", "n", *(r(c).alias(c) for c in out.columns[2:]))


@query("""SELECT event_type, count(*) AS n, round(avg(p), 6) AS mean_rank, round(max(p), 6) AS max_rank FROM (
SELECT event_type, (rank() OVER (PARTITION BY event_type ORDER BY floor(value)) + (count(*) OVER (PARTITION BY event_type, floor(value)) - 1) / 2.0) / count(*) OVER (PARTITION BY event_type) AS p FROM events) GROUP BY event_type""")
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks with ties within event types."""
    rows = graphs.table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("v"))
    return post.average_rank(rows, "event_type", "v", "p").groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg("p")).alias("mean_rank"), r(F.max("p")).alias("max_rank"))


@query("""WITH o AS (SELECT p_size AS x, CAST(sum(p_retailprice) AS DOUBLE) AS w FROM part GROUP BY p_size),
c AS (SELECT x, (sum(w) OVER (ORDER BY x) - w / 2) / sum(w) OVER () AS p FROM o), q AS (SELECT unnest([0.1, 0.5, 0.9]) AS q),
n AS (SELECT q, arg_max(x, p) FILTER (WHERE p <= q) AS lx, max(p) FILTER (WHERE p <= q) AS lp, arg_min(x, p) FILTER (WHERE p > q) AS hx, min(p) FILTER (WHERE p > q) AS hp FROM c, q GROUP BY q)
SELECT CAST(q AS DOUBLE) AS q, round(CASE WHEN lx IS NULL THEN hx WHEN hx IS NULL THEN lx ELSE lx + (hx - lx) * (q - lp) / (hp - lp) END, 6) AS value FROM n""")
def weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of part sizes weighted by price."""
    rows = graphs.table(spark, sf_dir, "part")
    return post.weighted_quantiles(rows, "p_size", "p_retailprice", [0.1, 0.5, 0.9]).select("q", r("value").alias("value"))


_PATHS = """WITH p AS (SELECT c_custkey AS k, c_acctbal AS y, ['R' || CAST(n_regionkey AS VARCHAR), 'N' || CAST(n_nationkey AS VARCHAR), 'S' || c_mktsegment || CAST(n_nationkey AS VARCHAR)] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT node, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std FROM (SELECT unnest(path) AS node, y FROM p WHERE k % 3 <> 0) GROUP BY node)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = graphs.table(spark, sf_dir, "customer"), graphs.table(spark, sf_dir, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey)
    path = F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.concat(F.lit("S"), "c_mktsegment", F.col("n_nationkey").cast("string")))
    return rows.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("y"), path.alias("path"))


@query(f"{_PATHS}, a AS (SELECT node, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std FROM (SELECT unnest(path) AS node, y FROM p) GROUP BY node) SELECT left(node, 1) AS kind, count(*) AS n_nodes, CAST(sum(n) AS BIGINT) AS n, round(avg(mean), 4) AS mean, round(avg(std), 4) AS std FROM a GROUP BY 1")
def path_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances below each node of region, nation and segment paths."""
    s = lookup.path_stats(_paths(spark, sf_dir), "path", "y")
    return s.groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n"), r(F.avg("mean"), 4).alias("mean"), r(F.avg("std"), 4).alias("std"))


@query(f"""{_PATHS}, t AS (SELECT k, y, u.i AS pos, path[u.i] AS node FROM p, unnest([1, 2, 3]) AS u(i) WHERE k % 3 = 0),
d AS (SELECT k, any_value(y) AS y, arg_max(mean, pos) FILTER (WHERE mean IS NOT NULL) AS value, max(pos) FILTER (WHERE mean IS NOT NULL) - 1 AS depth FROM t LEFT JOIN s USING (node) GROUP BY k)
SELECT CAST(depth AS INT) AS depth, count(*) AS n, round(avg(abs(y - value)), 4) AS mae FROM d GROUP BY depth""")
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out balances from the deepest known node of their paths."""
    p = _paths(spark, sf_dir)
    s = lookup.path_stats(p.where("k % 3 <> 0"), "path", "y")
    out = lookup.path_lookup(p.where("k % 3 = 0"), "k", "path", s).join(p.select("k", "y"), "k")
    return out.groupBy("depth").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("y") - F.col("value"))), 4).alias("mae"))


_CODES = """WITH p AS (SELECT p_partkey AS k, p_retailprice AS y, p_brand || '/' || p_type || '/' || CAST(p_size AS VARCHAR) AS code, p_partkey % 4 AS shard FROM part),
e AS (SELECT k, y, shard, u.i AS radius, array_to_string(string_split(code, '/')[1:u.i], '/') AS key FROM p, unnest([1, 2, 3]) AS u(i)),
s AS (SELECT radius, key, sum(y) AS s, sum(y * y) AS q, count(*) AS n FROM e WHERE shard <> 0 GROUP BY radius, key)"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("y"), F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("code"), F.pmod("p_partkey", F.lit(4)).alias("shard"))


@query(f"{_CODES}, a AS (SELECT radius, key, sum(y) AS s, sum(y * y) AS q, count(*) AS n FROM e GROUP BY radius, key) SELECT CAST(radius AS INT) AS radius, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n, round(avg(s / n), 4) AS mean, round(sum(q), 1) AS q FROM a GROUP BY radius")
def prefix_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the prefixes of part codes, from four shards merged by key."""
    rows = _codes(spark, sf_dir)
    parts = [lookup.prefix_sums(rows.where(F.col("shard") == k), "code", "y", "/", 3) for k in range(4)]
    s = lookup.merge_sums(parts)
    return s.groupBy("radius").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n"), r(F.avg("mean"), 4).alias("mean"), r(F.sum(F.col("n") * (F.col("msd") + F.col("mean") * F.col("mean"))), 1).alias("q"))


@query(f"""{_CODES}, l AS (SELECT e.k, any_value(e.y) AS y, arg_max(s.s / s.n, e.radius) FILTER (WHERE s.n >= 2) AS value, max(e.radius) FILTER (WHERE s.n >= 2) AS radius FROM e LEFT JOIN s USING (radius, key) WHERE e.shard = 0 GROUP BY e.k)
SELECT CAST(coalesce(radius, 0) AS INT) AS radius, count(*) AS n, round(avg(abs(y - coalesce(value, (SELECT sum(s) / sum(n) FROM s WHERE radius = 1)))), 4) AS mae FROM l GROUP BY 1""")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out prices from the longest code prefix with two rows."""
    rows = _codes(spark, sf_dir)
    s = settle(lookup.prefix_sums(rows.where("shard <> 0"), "code", "y", "/", 3))
    out = lookup.prefix_lookup(rows.where("shard = 0"), "k", "code", s, "/", 3, 2).join(rows.select("k", "y"), "k")
    return out.groupBy("radius").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("y") - F.col("value"))), 4).alias("mae"))


@query("""SELECT n_rows, n_members, count(*) AS n FROM (SELECT l_suppkey, l_quantity, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_members FROM lineitem GROUP BY ALL) g JOIN lineitem USING (l_suppkey, l_quantity) GROUP BY ALL""")
def collapse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the size of their group and its distinct parts."""
    rows = graphs.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_partkey")
    return groups.group_counts(rows, ["l_suppkey", "l_quantity"], "l_partkey").groupBy("n_rows", "n_members").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_suppkey, l_quantity, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL)
SELECT l_orderkey % 4 AS shard, round(sum((l_extendedprice - m) * (l_extendedprice - m)), 0) AS sse, count(*) AS n FROM lineitem JOIN m USING (l_suppkey, l_quantity) GROUP BY 1""")
def orbit_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared deviations from group means by shard: the error that the key leaves."""
    rows = graphs.table(spark, sf_dir, "lineitem")
    out = groups.floor(rows, ["l_suppkey", "l_quantity"], "l_extendedprice", F.pmod("l_orderkey", F.lit(4)))
    return out.select("shard", r("sse", 0).alias("sse"), "n")


@query("""WITH b AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey, round(avg(c_acctbal), 4) AS target, round(var_pop(c_acctbal) * count(*), 1) AS within_sse, count(*) AS within_n FROM customer GROUP BY ALL)
SELECT c_custkey, target, within_sse, within_n FROM b""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer of each nation and segment, with the group's mean as target."""
    rows = graphs.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    out = groups.representatives(rows, ["c_nationkey", "c_mktsegment"], ["c_custkey"], "c_acctbal")
    return out.select("c_custkey", r("target", 4).alias("target"), r("within_sse", 1).alias("within_sse"), "within_n")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE gap >= 25) AS n_isolated FROM (
SELECT event_type, least(coalesce(value - lag(value) OVER w, 1e18), coalesce(lead(value) OVER w - value, 1e18)) AS g0, CASE WHEN lag(value) OVER w IS NULL AND lead(value) OVER w IS NULL THEN 0 ELSE g0 END AS gap
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY value)) GROUP BY event_type""")
def isolated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values far from every other of the user and type."""
    rows = groups.isolated(graphs.table(spark, sf_dir, "events").select("user_id", "event_type", "value"), ["user_id", "event_type"], "value", 25.0)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("isolated"), 1)).alias("n_isolated"))


_ITEMS = "i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS row, l_quantity AS q FROM lineitem)"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = graphs.table(spark, sf_dir, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*items.columns))
    return items.select(F.col("l_orderkey").alias("k"), number.alias("row"), F.col("l_quantity").alias("q"))


@query(f"WITH {_ITEMS} SELECT count(*) AS n, round(avg(abs(a.q - b.q)), 6) AS mean_d, max(abs(a.q - b.q)) AS max_d, count(*) FILTER (WHERE abs(a.q - b.q) <= 1) AS n_close FROM i a JOIN i b ON a.k = b.k AND a.row < b.row")
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of items of an order."""
    p = groups.pairs(_numbered(spark, sf_dir), "k", "row", "q")
    return p.agg(F.count("*").alias("n"), r(F.avg("d")).alias("mean_d"), F.max("d").alias("max_d"), F.count(F.when(F.col("d") <= 1, 1)).alias("n_close"))


_BITS = """v AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS b FROM embeddings), n AS (SELECT vec_id, b, list_sum(b) AS n FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(list_inner_product(CAST(a.b AS DOUBLE[]), CAST(b.b AS DOUBLE[])) AS INT) AS "both", CAST(a.n + b.n AS INT) - "both" AS either FROM n a JOIN n b ON a.vec_id < b.vec_id),
near AS (SELECT * FROM p WHERE "both" >= 0.6 * either - 1e-9)"""


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = graphs.table(spark, sf_dir, "embeddings")
    bits = similarity.sign_bits(vectors, "vec_id", "embedding")
    return vectors.select(F.col("vec_id").alias("key")), settle(similarity.tanimoto_pairs(bits, 0.4))


@query(f'WITH {_BITS} SELECT CAST(floor(100 * "both" / either) AS BIGINT) AS percent, count(*) AS n FROM near GROUP BY 1')
def tanimoto_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sign-bit sets with a similarity of 0.6 at least."""
    _, pairs = _near(spark, sf_dir)
    return pairs.groupBy(F.floor(100 * F.col("both") / F.col("either")).alias("percent")).agg(F.count("*").alias("n"))


@query(f"WITH {_BITS}, c AS (SELECT v.vec_id, count(near.a) AS k FROM v LEFT JOIN near ON near.a = v.vec_id OR near.b = v.vec_id GROUP BY v.vec_id) SELECT k AS neighbours, count(*) AS n FROM c GROUP BY k")
def neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by their number of near ones."""
    keys, pairs = _near(spark, sf_dir)
    return similarity.neighbour_counts(keys, pairs).groupBy("neighbours").agg(F.count("*").alias("n"))


#: Centres in order, as a recursion over the keys: each that is free takes its free neighbours.
BUTINA_OF = """m AS MATERIALIZED (SELECT a AS x, b AS y FROM near UNION ALL SELECT b, a FROM near), nb AS (SELECT vec_id, list(y) FILTER (WHERE y IS NOT NULL) AS others, count(y) AS k FROM v LEFT JOIN m ON x = vec_id GROUP BY vec_id),
turn AS MATERIALIZED (SELECT vec_id, list_prepend(vec_id, coalesce(others, [])) AS others, row_number() OVER (ORDER BY k DESC, vec_id DESC) AS i FROM nb),
b(i, taken, centre, got) AS (SELECT CAST(0 AS BIGINT), []::BIGINT[], CAST(NULL AS BIGINT), []::BIGINT[] UNION ALL
  SELECT i, list_concat(taken, g), vec_id, g FROM (SELECT turn.i, taken, vec_id, CASE WHEN list_contains(taken, vec_id) THEN []::BIGINT[] ELSE list_filter(others, lambda x: NOT list_contains(taken, x)) END AS g FROM b JOIN turn ON turn.i = b.i + 1)),
butina AS (SELECT unnest(got) AS key, centre FROM b)"""
_BUTINA = f"{_BITS}, {BUTINA_OF}"


@query(f"WITH RECURSIVE {_BUTINA} SELECT key, centre FROM butina")
def butina(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Butina clusters of the sign-bit sets: key and centre."""
    return similarity.butina(*_near(spark, sf_dir))


@query(f"""WITH RECURSIVE {_BUTINA}, c AS (SELECT centre AS cluster, count(*) AS size FROM butina GROUP BY 1), o AS MATERIALIZED (SELECT cluster, size, row_number() OVER (ORDER BY size DESC, cluster) AS i, sum(size) OVER () AS total FROM c),
d(i, filled, size, k) AS (SELECT CAST(0 AS BIGINT), [0, 0, 0]::DOUBLE[], CAST(0 AS BIGINT), 0 UNION ALL
  SELECT i, list_transform(filled, lambda x, j: CASE WHEN j = k THEN x + size ELSE x END), size, k FROM (SELECT o.i, filled, o.size, list_position([0.8 * total - filled[1], 0.1 * total - filled[2], 0.1 * total - filled[3]], list_max([0.8 * total - filled[1], 0.1 * total - filled[2], 0.1 * total - filled[3]])) AS k FROM d JOIN o ON o.i = d.i + 1))
SELECT ['train', 'val', 'test'][k] AS split, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_rows FROM d WHERE i > 0 GROUP BY 1""")
def cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole clusters dealt to train, validation and test: sizes of each."""
    clusters = similarity.butina(*_near(spark, sf_dir)).groupBy(F.col("centre").alias("cluster")).agg(F.count("*").alias("size"))
    split = similarity.fill_splits(clusters, [("train", 0.8), ("val", 0.1), ("test", 0.1)])
    return clusters.join(split, "cluster").groupBy("split").agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_rows"))


@query(f"""WITH RECURSIVE {_BITS}, e AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), reach(s, t) AS (SELECT vec_id, vec_id FROM v UNION SELECT s, e.b FROM reach JOIN e ON e.a = t),
c AS (SELECT s, min(t) AS component FROM reach GROUP BY s) SELECT size, count(*) AS n FROM (SELECT component, count(*) AS size FROM c GROUP BY component) GROUP BY size""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the connected components of near pairs."""
    keys, pairs = _near(spark, sf_dir)
    sizes = similarity.components(pairs, keys).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n"))


@query(f"""WITH {_BITS}, d AS (SELECT a, b, 1 - "both" / either AS d FROM near)
SELECT count(*) AS n, round(avg(list_min([x.d, y.d, z.d])), 6) AS mean_shortest, round(max(list_max([x.d, y.d, z.d])), 6) AS longest FROM d x JOIN d y ON y.a = x.b JOIN d z ON z.a = x.a AND z.b = y.b""")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles among near pairs."""
    _, pairs = _near(spark, sf_dir)
    t = groups.triangles(pairs.select("a", "b", (1 - F.col("both") / F.col("either")).alias("d")))
    return t.agg(F.count("*").alias("n"), r(F.avg("d1")).alias("mean_shortest"), r(F.max("d3")).alias("longest"))


@query(f"""WITH {_BITS}, d AS (SELECT a, b, 1 - "both" / either AS d FROM near), s AS (SELECT a, b, d FROM d UNION ALL SELECT b, a, d FROM d), dis AS (SELECT a, b FROM d WHERE d > 0.35),
said AS (SELECT dis.a, dis.b, CASE WHEN x.d <= 0.35 AND y.d > 0.35 THEN dis.b WHEN y.d <= 0.35 AND x.d > 0.35 THEN dis.a END AS vote FROM dis JOIN s x ON x.a = dis.a JOIN s y ON y.a = dis.b AND y.b = x.b),
g AS (SELECT dis.a, dis.b, min(vote) AS lo, max(vote) AS hi FROM dis LEFT JOIN said USING (a, b) GROUP BY dis.a, dis.b),
l AS (SELECT g.a, g.b, CASE WHEN lo = hi THEN lo WHEN ea.label > eb.label THEN g.a WHEN eb.label > ea.label THEN g.b ELSE greatest(g.a, g.b) END AS loser FROM g JOIN embeddings ea ON ea.vec_id = g.a JOIN embeddings eb ON eb.vec_id = g.b)
SELECT loser, count(*) AS n FROM l GROUP BY loser""")
def copy_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losers of disagreeing pairs by the votes of common neighbours."""
    _, pairs = _near(spark, sf_dir)
    edges = settle(pairs.select("a", "b", (1 - F.col("both") / F.col("either")).alias("d")))
    score = graphs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").alias("score"))
    return groups.witness_rule(edges, edges.where("d > 0.35"), 0.35, score).groupBy("loser").agg(F.count("*").alias("n"))


_HASH = "(({k} % 4294967296) * CAST(2654435761 AS HUGEINT)) % 4294967296"


@query(f"""WITH o AS (SELECT o_custkey AS g FROM orders GROUP BY 1), f AS (SELECT g, ntile(5) OVER (ORDER BY {_HASH.format(k='g')}, g) - 1 AS fold FROM o)
SELECT CAST(fold AS INT) AS fold, count(*) AS n_graphs, CAST(sum(g) AS BIGINT) AS check_sum FROM f GROUP BY fold""")
def graph_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt to five folds."""
    f = sampling.graph_folds(graphs.table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", 5)
    return f.groupBy("fold").agg(F.count("*").alias("n_graphs"), F.sum("o_custkey").alias("check_sum"))


@query(f"""WITH p AS (SELECT o_orderpriority, o_orderkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey) - 1 AS part FROM orders)
SELECT o_orderpriority, CAST(part AS INT) AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS check_sum FROM p GROUP BY ALL""")
def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each priority in four parts of equal size."""
    p = sampling.partition(graphs.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", ["o_orderpriority"], 4)
    return p.groupBy("o_orderpriority", "part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("check_sum"))


@query(f"""WITH s AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey) - 1 AS place, floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.1 + 0.5) AS target FROM orders)
SELECT o_orderpriority, CAST(floor(place / target) AS BIGINT) AS store, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS check_sum FROM s WHERE place < 2 * target GROUP BY ALL""")
def subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two disjoint stratified samples of a tenth of the orders each."""
    s = sampling.stratified_sample(graphs.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", ["o_orderpriority"], 0.1, 2)
    return s.groupBy("o_orderpriority", "store").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("check_sum"))


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT user_id, n, sum(n) OVER (ORDER BY user_id) - n AS before, sum(n) OVER () AS total FROM c)
SELECT CAST(least(floor(before * 6 / total), 5) AS BIGINT) AS part, count(*) AS n_graphs, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1""")
def balanced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users cut into six ranges of about as many events."""
    c = graphs.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return sampling.by_cumulative_size(c, "user_id", "n", 6).groupBy("part").agg(F.count("*").alias("n_graphs"), F.sum("n").alias("n"))


@query(f"""WITH {sql.ORDERS}, k AS (SELECT src AS node_id, count(*) AS k, any_value(dst) AS up FROM edges GROUP BY src),
leaf AS (SELECT n.node_id, up, y FROM nodes n JOIN k USING (node_id) WHERE k = 1 AND n.node_id % 1000 <> 0 AND n.a0 = 'N'),
s AS (SELECT up AS node_id, sum(y) AS add, count(*) AS f FROM leaf GROUP BY up)
SELECT coalesce(f, 0) AS n_folded, count(*) AS n, round(sum(y + coalesce(add, 0)), 1) AS total FROM nodes LEFT JOIN s USING (node_id) WHERE node_id NOT IN (SELECT node_id FROM leaf) GROUP BY 1""")
def united_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one flag folded onto their orders: the total is conserved."""
    g = graphs.orders_graph(spark, sf_dir)
    out = groups.fold_leaves(g.nodes, g.edges, (F.col("node_id") % 1000 != 0) & (F.col("kind") == "N"), "y")
    return out.groupBy("n_folded").agg(F.count("*").alias("n"), r(F.sum("y"), 1).alias("total"))


def _scores_sql(depths: str) -> str:
    return f"""{_EV}, d AS (SELECT unnest({depths}) AS depth), f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold),
c AS (SELECT fold, level, cid, count(*) AS n, avg(y) AS mean FROM labels JOIN nodes USING (node_id) JOIN f ON graph_id % 5 <> fold GROUP BY ALL),
w AS (SELECT fold, avg(y) AS mean FROM nodes JOIN f ON graph_id % 5 <> fold GROUP BY fold),
x AS (SELECT depth, graph_id % 5 AS fold, n.node_id, any_value(n.y) AS y, coalesce(arg_max(c.mean, l.level) FILTER (WHERE c.n >= 2), any_value(w.mean)) AS value
  FROM nodes n JOIN labels l USING (node_id) JOIN d ON l.level <= d.depth JOIN w ON w.fold = n.graph_id % 5 LEFT JOIN c ON c.fold = n.graph_id % 5 AND c.level = l.level AND c.cid = l.cid GROUP BY ALL),
scores AS (SELECT depth, fold, sqrt(avg((value - y) * (value - y))) AS value FROM x GROUP BY depth, fold)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """depth, fold, value: error of every depth on every fold, from one fit."""
    g, labels = _events(spark, sf_dir)
    fold = g.nodes.select("node_id", F.pmod("graph_id", F.lit(5)).alias("fold"), "y")
    rows = labels.join(fold, "node_id")
    parts = settle(rows.groupBy("fold", "level", "cid").agg(F.first("parent").alias("parent"), F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("msd")))
    folds = spark.range(5).select(F.col("id").alias("group"))
    models = stats.leave_one_group_out(parts.withColumnRenamed("fold", "group"), "group", folds)
    per = settle(fold.groupBy("fold").agg(F.count("y").alias("_n"), F.avg("y").alias("_mean")))  # a row for each fold
    whole = per.select(F.col("fold").alias("held")).crossJoin(per).where("held <> fold").groupBy(F.col("held").alias("fold")).agg((F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("all"))
    found = rows.select("node_id", "fold", "y", "level", "cid").join(models.where("n >= 2").select("fold", "level", "cid", "mean"), ["fold", "level", "cid"], "left")
    depths = spark.range(4).select(F.col("id").cast("int").alias("depth"))
    pred = found.join(F.broadcast(depths), F.col("level") <= F.col("depth")).groupBy("depth", "fold", "node_id").agg(F.first("y").alias("y"), F.max_by("mean", F.when(F.col("mean").isNotNull(), F.col("level"))).alias("value"))
    d = F.coalesce("value", "all") - F.col("y")
    return settle(pred.join(F.broadcast(whole), "fold").groupBy("depth", "fold").agg(F.sqrt(F.avg(d * d)).alias("value")))


@query(f"{_scores_sql('[0, 1, 2, 3]')} SELECT CAST(depth AS INT) AS depth, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(stddev_pop(value), 6) AS std, count(*) AS n FROM scores GROUP BY depth")
def curve_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated error by depth."""
    out = compare.curve(_scores(spark, sf_dir), 5)
    return out.select("depth", *(r(c).alias(c) for c in ("mean", "low", "high", "std")), "n")


@query(f"{_scores_sql('[0, 1, 2, 3]')}, m AS (SELECT depth, avg(value) AS mean FROM scores GROUP BY depth) SELECT CAST(min(depth) AS INT) AS depth FROM m WHERE mean <= (SELECT min(mean) FROM m) * 1.005")
def select_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shallowest depth close to the best."""
    return compare.select_depth(compare.curve(_scores(spark, sf_dir), 5))


@query(f"{_scores_sql('[0, 1, 2, 3]')}, p AS (SELECT a.value - b.value AS d FROM scores a JOIN scores b USING (fold) WHERE a.depth = 1 AND b.depth = 3) SELECT count(*) AS k, round(avg(d), 6) AS mean, round(sqrt((1.0 / count(*) + 0.25) * var_samp(d)), 6) AS se, count(*) FILTER (WHERE d < 0) AS wins FROM p")
def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth 1 against depth 3 over the folds, with the corrected error."""
    s = _scores(spark, sf_dir).select(F.col("depth").cast("string").alias("method"), F.lit(0).alias("repeat"), "fold", "value")
    return compare.paired_difference(s, "1", "3", 0.25).select("k", r("mean").alias("mean"), r("se").alias("se"), "wins")


@query(f"""{_scores_sql('[0, 1, 2, 3]')}, g AS (SELECT var_pop(value) * count(*) AS t FROM scores), m AS (SELECT var_pop(m) * sum(c) AS s, count(*) AS k FROM (SELECT depth, avg(value) AS m, count(*) AS c FROM scores GROUP BY depth)),
u AS (SELECT var_pop(m) * sum(c) AS s, count(*) AS n FROM (SELECT fold, avg(value) AS m, count(*) AS c FROM scores GROUP BY fold)) SELECT k, n, round(m.s, 6) AS ss_method, round(u.s, 6) AS ss_subject, round(g.t - m.s - u.s, 6) AS ss_error FROM g, m, u""")
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated-measures sums of squares of four depths over five folds."""
    s = _scores(spark, sf_dir).select(F.col("depth").cast("string").alias("method"), F.lit(0).alias("repeat"), "fold", "value")
    return compare.sums_of_squares(s).select("k", "n", *(r(c).alias(c) for c in ("ss_method", "ss_subject", "ss_error")))


@query()
def tukey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of depths with studentized-range tails."""
    s = _scores(spark, sf_dir).select(F.col("depth").cast("string").alias("method"), F.lit(0).alias("repeat"), "fold", "value")
    return spark.createDataFrame(compare.tukey(s), "a string, b string, difference double, p double, low double, high double")


@query("""SELECT CAST(p_size AS INT) AS z, CASE WHEN p_size <= 2 THEN 1 WHEN p_size <= 10 THEN 2 WHEN p_size <= 18 THEN 3 WHEN p_size <= 36 THEN 4 WHEN p_size <= 54 THEN 5 WHEN p_size <= 86 THEN 6 ELSE 7 END AS period, count(*) AS n FROM part GROUP BY ALL""")
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes read as atomic numbers, with their periods."""
    rows = graphs.table(spark, sf_dir, "part")
    return rows.groupBy(F.col("p_size").alias("z"), elements.period(F.col("p_size")).alias("period")).agg(F.count("*").alias("n"))


@query(f"""{_ALL}, bad AS (SELECT level, cid FROM labels GROUP BY level, cid HAVING count(DISTINCT coalesce(parent, '')) > 1)
SELECT CAST(l.level AS INT) AS level, count(*) AS n_classes, count(b.cid) AS n_bad FROM (SELECT DISTINCT level, cid FROM labels) l LEFT JOIN bad b ON b.level = l.level AND b.cid = l.cid GROUP BY 1""")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each level, and those of them whose id stands for two: none."""
    labels = _events(spark, sf_dir)[1]
    bad = refine.collisions(labels).select("level", "cid", F.lit(1).alias("bad"))
    return labels.select("level", "cid").distinct().join(bad, ["level", "cid"], "left").groupBy("level").agg(F.count("*").alias("n_classes"), F.count("bad").alias("n_bad"))
