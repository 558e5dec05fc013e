"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

EVENTS = """
nodes AS (SELECT user_id AS graph_id, event_id AS node_id, event_type AS a0, value AS y FROM events),
fwd AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
edges AS (SELECT src, dst FROM fwd WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM fwd WHERE dst IS NOT NULL)"""

CONVERSATIONS = """
nodes AS (SELECT conv_id AS graph_id, conv_id * 100000 + turn AS node_id, role AS a0, CAST(length(text) AS DOUBLE) AS y FROM conversations),
fwd AS (SELECT conv_id * 100000 + turn AS src, lead(conv_id * 100000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations),
edges AS (SELECT src, dst FROM fwd WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM fwd WHERE dst IS NOT NULL)"""

ORDERS = """
items AS (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS node_id FROM lineitem),
nodes AS (
  SELECT o_orderkey AS graph_id, o_orderkey * 1000 AS node_id, o_orderstatus AS a0, o_orderpriority AS a1, o_totalprice AS y FROM orders
  UNION ALL SELECT l_orderkey, node_id, l_returnflag, l_linestatus, l_extendedprice FROM items),
edges AS (SELECT l_orderkey * 1000 AS src, node_id AS dst FROM items UNION ALL SELECT node_id, l_orderkey * 1000 FROM items)"""

PLACES = """
rows_ AS (
  SELECT CAST(r_regionkey AS BIGINT) * 10 + 1 AS node_id, 'region' AS a0, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS BIGINT) AS up FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 10 + 2, 'nation', NULL, CAST(n_regionkey AS BIGINT) * 10 + 1 FROM nation
  UNION ALL SELECT c_custkey * 10 + 3, 'customer', c_acctbal, CAST(c_nationkey AS BIGINT) * 10 + 2 FROM customer
  UNION ALL SELECT s_suppkey * 10 + 4, 'supplier', s_acctbal, CAST(s_nationkey AS BIGINT) * 10 + 2 FROM supplier),
nodes AS (SELECT 0 AS graph_id, node_id, a0, y FROM rows_),
edges AS (SELECT node_id AS src, up AS dst FROM rows_ WHERE up IS NOT NULL UNION ALL SELECT up, node_id FROM rows_ WHERE up IS NOT NULL)"""


def labels(attributes: list[str], depth: int, code: str = "", coarse: int | None = None, tag: str = "") -> str:
    """CTEs l0, l1, ... (node_id, cid, parent) and ``labels`` (node_id, level, cid, parent) over ``nodes`` and ``edges``."""
    out, prev = [], None
    for k, a in enumerate(attributes):
        own = "''" if prev is None else "p.cid"
        frm = f"nodes n JOIN {prev} p USING (node_id)" if prev else "nodes n"
        parent = "CAST(NULL AS VARCHAR)" if prev is None else "p.cid"
        out.append(f"{tag}l{k} AS (SELECT n.node_id, md5('{k}|' || {own} || '|' || n.{a}) AS cid, {parent} AS parent FROM {frm})")
        prev = f"{tag}l{k}"
    ecode = f" || ':' || CAST(e.{code} AS VARCHAR)" if code else ""
    seen = f"{tag}l{coarse - 1}" if coarse else None
    for r in range(1, depth + 1):
        k = len(attributes) - 1 + r
        source = seen or prev
        out.append(
            f"{tag}m{r} AS (SELECT s.node_id, md5('{'c' if seen else k}{r}|' || s.cid || '|' || coalesce(g.sig, '')) AS cid, s.cid AS parent FROM {source} s LEFT JOIN "
            f"(SELECT e.src, string_agg(q.cid{ecode}, ',' ORDER BY q.cid{ecode}) AS sig FROM edges e JOIN {source} q ON q.node_id = e.dst GROUP BY e.src) g ON g.src = s.node_id)"
        )
        if seen:
            out.append(f"{tag}l{k} AS (SELECT p.node_id, md5('{k}|' || p.cid || '|' || m.cid) AS cid, p.cid AS parent FROM {prev} p JOIN {tag}m{r} m USING (node_id))")
            seen = f"{tag}m{r}"
        else:
            out.append(f"{tag}l{k} AS (SELECT node_id, cid, parent FROM {tag}m{r})")
        prev = f"{tag}l{k}"
    n = len(attributes) + depth
    every = " UNION ALL ".join(f"SELECT node_id, {k} AS level, cid, parent FROM {tag}l{k}" for k in range(n))
    return ",\n".join([*out, f"{tag}labels AS ({every})"])


CLASSES = "classes AS (SELECT level, cid, any_value(parent) AS parent, count(*) AS n, avg(y) AS mean, var_pop(y) AS msd FROM labels JOIN {train} USING (node_id) GROUP BY level, cid)"
WHOLE = "whole AS (SELECT count(*) AS n, avg(y) AS mean, var_pop(y) AS msd FROM {train})"


def model(train: str = "nodes") -> str:
    """CTEs ``classes`` and ``whole`` of the nodes of ``train``, and ``kids`` with children counts."""
    return f"{CLASSES.format(train=train)},\n{WHOLE.format(train=train)},\nkids AS (SELECT c.*, coalesce(k.children, 0) AS children FROM classes c LEFT JOIN (SELECT level - 1 AS level, parent AS cid, count(*) AS children FROM classes WHERE parent IS NOT NULL GROUP BY ALL) k USING (level, cid))"


def scalars() -> str:
    """CTE ``scalars``: tau2, sigma2 and the upper level's tau2 for each level."""
    return """
per AS (SELECT level - 1 AS level, parent, count(*) AS c, var_pop(mean) AS v, sum(msd / n) AS noise FROM classes WHERE parent IS NOT NULL GROUP BY 1, 2),
tau AS (SELECT level, sum(v * c) FILTER (WHERE c > 1) / sum(c - 1) FILTER (WHERE c > 1) AS btw, sum(noise) / sum(c) AS noise FROM per GROUP BY level),
tau2s AS (SELECT level, CASE WHEN btw IS NOT NULL THEN greatest(0.0, btw - noise) END AS tau2 FROM tau),
root AS (SELECT CASE WHEN count(*) > 1 THEN greatest(0.0, var_samp(mean) - avg(msd / n)) END AS tau2 FROM classes WHERE level = 0),
sig AS (SELECT level, sum(n * msd) / sum(n) AS sigma2 FROM classes GROUP BY level),
scalars AS (SELECT s.level, s.sigma2, t.tau2, CASE WHEN s.level = 0 THEN (SELECT tau2 FROM root) ELSE u.tau2 END AS tau2_parent
  FROM sig s LEFT JOIN tau2s t ON t.level = s.level LEFT JOIN tau2s u ON u.level = s.level - 1)"""


BAYES = "CASE WHEN tau2_parent IS NULL THEN 1.0 WHEN tau2_parent <= 0 THEN 0.0 ELSE (CASE WHEN children > 0 THEN children ELSE n END) / ((CASE WHEN children > 0 THEN children ELSE n END) + coalesce(CASE WHEN children > 0 THEN tau2 ELSE sigma2 END, 0.0) / tau2_parent) END"


def shrunk(weight: str, levels: int, source: str = "kids") -> str:
    """CTEs h0, h1, ... and ``shrunk``: each class drawn toward its shrunk parent."""
    out = [f"h0 AS (SELECT c.*, {weight} AS weight, {weight} * c.mean + (1 - {weight}) * (SELECT mean FROM whole) AS shrunk FROM {source} c WHERE level = 0)"]
    for k in range(1, levels):
        out.append(f"h{k} AS (SELECT c.*, {weight} AS weight, {weight} * c.mean + (1 - {weight}) * p.shrunk AS shrunk FROM {source} c JOIN (SELECT cid AS pc, shrunk FROM h{k - 1}) p ON p.pc = c.parent WHERE level = {k})")
    return ",\n".join([*out, "shrunk AS (" + " UNION ALL ".join(f"SELECT level, n, weight, shrunk FROM h{k}" for k in range(levels)) + ")"])


def predictions(support: int, test: str = "test") -> str:
    """CTE ``pred`` for the nodes of ``test``: node_id, y, value, matched_level, support, threshold_bound."""
    return f"""
found AS (SELECT t.node_id, t.y, l.level, c.n, c.mean, c.msd FROM {test} t JOIN labels l USING (node_id) LEFT JOIN classes c ON c.level = l.level AND c.cid = l.cid),
pred AS (
  SELECT node_id, any_value(y) AS y, coalesce(arg_max(mean, level) FILTER (WHERE n >= {support}), (SELECT mean FROM whole)) AS value,
    coalesce(max(level) FILTER (WHERE n >= {support}), -1) AS matched_level,
    coalesce(arg_max(n, level) FILTER (WHERE n >= {support}), (SELECT n FROM whole)) AS support,
    coalesce(max(level) FILTER (WHERE n IS NOT NULL), -1) > coalesce(max(level) FILTER (WHERE n >= {support}), -1) AS threshold_bound
  FROM found GROUP BY node_id)"""
