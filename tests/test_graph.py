"""Refinement and the model's algebra on small graphs."""

import math

import pytest

from lattica.functions import distributions, elements
from lattica.model import Config, Model
from lattica.operators import graph, groups, post, refine, similarity, stats
from lattica.operators.graph import Graph


def cycles(spark, sizes):
    nodes, edges, at = [], [], 0
    for g, n in enumerate(sizes):
        for i in range(n):
            nodes.append((g, at + i, "x", float(at + i)))
            edges += [(at + i, at + (i + 1) % n), (at + (i + 1) % n, at + i)]
        at += n
    return Graph(spark.createDataFrame(nodes, "graph_id long, node_id long, a string, y double"), spark.createDataFrame(edges, "src long, dst long"))


def test_cycles_are_not_told_apart(spark):
    labels = refine.refine(cycles(spark, [6, 3, 3]), ["a"], 3)
    assert {(r["level"], r["n"]) for r in labels.groupBy("level").agg({"cid": "count"}).withColumnRenamed("count(cid)", "n").collect()} == {(k, 12) for k in range(4)}
    assert labels.select("level", "cid").distinct().count() == 4


def test_multiplicity_and_isolated_nodes_count(spark):
    nodes = spark.createDataFrame([(0, i, "x") for i in range(5)], "graph_id long, node_id long, a string")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2), (2, 3), (3, 2)], "src long, dst long")
    labels = refine.refine(Graph(nodes, edges), ["a"], 1).where("level = 1")
    groups_ = {}
    for r in labels.collect():
        groups_.setdefault(r["cid"], set()).add(r["node_id"])
    assert sorted(map(sorted, groups_.values())) == [[0, 1], [2, 3], [4]]


def test_violations(spark):
    nodes = spark.createDataFrame([(0, 1), (0, 2), (0, 2)], "graph_id long, node_id long")
    edges = spark.createDataFrame([(1, 2), (1, 9)], "src long, dst long")
    got = {r["invariant"]: r["n"] for r in graph.violations(Graph(nodes, edges)).collect()}
    assert got == {"endpoint exists": 1, "edge has its reverse": 2, "node id is unique": 1}


def test_merge_is_the_whole_fit_and_exact_far_from_zero(spark):
    rows = [(k, 0, 7, 1e9 + v) for k, v in enumerate([0.0, 4.0, 0.0, 4.0])]
    df = spark.createDataFrame(rows, "node_id long, level int, cid long, y double").selectExpr("*", "CAST(NULL AS BIGINT) AS parent")
    fit = lambda part: stats.class_stats(part.drop("y"), part.select("node_id", "y"))
    merged = stats.merge([fit(df.where("node_id < 1")), fit(df.where("node_id >= 1")), stats.empty_like(fit(df))]).first()
    assert (merged["n"], merged["mean"]) == (4, pytest.approx(1e9 + 2, abs=1e-5)) and merged["msd"] == pytest.approx(4.0, abs=1e-4)


def test_model_round_trip_merge_and_options(spark, tmp_path):
    config = Config(("a",), 2)
    one, two = Model.fit(config, cycles(spark, [4])), Model.fit(config, cycles(spark, [5, 3]))
    both = one + two
    both.save(str(tmp_path / "m"))
    again = Model.load(spark, str(tmp_path / "m"))
    key = lambda m: {(r["level"], r["cid"], r["n"], round(r["mean"], 9)) for r in m.classes.collect()}
    assert key(again) == key(both) and again.config == config
    pred = again.with_params(minimum_support=2).predict(cycles(spark, [7]))
    assert {r["matched_level"] for r in pred.collect()} == {2}
    with pytest.raises(ValueError):
        again.with_params(depth=3)
    with pytest.raises(ValueError):
        one.merge(Model.fit(Config(("a",), 1), cycles(spark, [4])))
    assert again.truncate(1).classes.select("level").distinct().count() == 2


def test_normalise_conserves_totals_and_isolated_values(spark):
    rows = spark.createDataFrame([(1, 1.0, 10.0, 2.0), (1, 2.0, 10.0, None), (2, 5.0, 4.0, -1.0)], "g int, x double, t double, s double")
    for power in (0, 1, 2):
        sums = {r["g"]: r["s"] for r in post.normalise(rows, "g", "x", "t", "s", power).groupBy("g").agg({"normalised": "sum"}).withColumnRenamed("sum(normalised)", "s").collect()}
        assert sums == pytest.approx({1: 10.0, 2: 4.0})
    values = spark.createDataFrame([(1, 0.0), (1, 0.1), (1, 9.0), (2, 3.0)], "g int, v double")
    assert {(r["g"], r["v"]) for r in groups.isolated(values, ["g"], "v", 0.4).where("isolated").collect()} == {(1, 9.0)}


def test_butina_takes_more_neighbours_then_larger_keys_first(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    keys = spark.createDataFrame([(k,) for k in range(1, 7)], "key long")
    assert {r["key"]: r["centre"] for r in similarity.butina(keys, pairs).collect()} == {1: 2, 2: 2, 3: 2, 4: 5, 5: 5, 6: 6}
    assert {r["key"]: r["component"] for r in similarity.components(pairs, keys).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_butina_gives_a_key_to_the_first_centre_in_order_not_the_first_found(spark):
    """20 and 40 become centres at once, 10 only after 15, its first neighbour, was taken by 20; it still comes before 40, and takes 30."""
    stars = {20: 15, 10: 8, 40: 2}
    pairs = [(20, 15), (10, 15), (10, 30), (40, 30)] + [(c, c * 100 + i) for c, n in stars.items() for i in range(n)] + [(15, 1500 + i) for i in range(11)]
    keys = sorted({k for p in pairs for k in p})
    near = {k: {a + b - k for a, b in pairs if k in (a, b)} for k in keys}
    want = {}
    for k in sorted(keys, key=lambda k: (-len(near[k]), -k)):
        if k not in want:
            want |= {x: k for x in {k, *near[k]} if x not in want}
    assert want[15] == 20 and want[30] == 10 and want[40] == 40
    got = similarity.butina(spark.createDataFrame([(k,) for k in keys], "key long"), spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long"))
    assert {r["key"]: r["centre"] for r in got.collect()} == want


def test_distributions():
    assert distributions.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert distributions.f_tail(4.0, 3, 12) == pytest.approx(0.0345904, abs=1e-6)
    assert distributions.studentized_range_quantile(0.95, 3, 10) == pytest.approx(3.877, abs=2e-3)
    assert distributions.f_tail(math.inf, 2, 3) == 0


def test_elements(spark):
    from pyspark.sql import functions as F

    z = F.col("z")
    rows = spark.createDataFrame([(x,) for x in (1, 2, 8, 18, 26, 35, 57, 72, 92, 0)], "z int").select("z", elements.period(z).alias("p"), elements.group(z).alias("g"), elements.block(z).alias("b"))
    got = {r["z"]: (r["p"], r["g"], r["b"]) for r in rows.collect()}
    assert got[1] == (1, "1", "s") and got[2] == (1, "18", "s") and got[8] == (2, "16", "p") and got[18] == (3, "18", "p")
    assert got[26] == (4, "8", "d") and got[35] == (4, "17", "p") and got[57] == (6, "none", "f") and got[72] == (6, "4", "d") and got[92] == (7, "none", "f")
    assert got[0] == (None, "none", None)
