"""Distinct graphs, merges without a fold, floors, numbered strata, record scans, and what is left of writes that ended early."""

import itertools
import json
import random
import shutil
import statistics

import pytest

from lattica import catalog, crossval
from lattica.model import Config, Model
from lattica.operators import order, refine, sampling, stats, unique
from lattica.operators.graph import Graph
from lattica.plans import graphs
from lattica.sources import stores

from .test_queries import compare


@pytest.mark.parametrize("name", ["unique_graphs", "graph_clusters", "fold_floors", "leave_one_group_out", "cv_variants", "curve_pivot", "partition", "subsample"])
def test_query_equals_sql(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_unique_graphs(spark):
    shapes = {1: "aab", 2: "aba", 3: "baa", 4: "aabb", 5: "c", 6: "c"}  # paths; 1 and 3 are one read from either end
    nodes = [(g, g * 10 + i, x) for g, t in shapes.items() for i, x in enumerate(t)]
    edges = [(g * 10 + i + a, g * 10 + i + 1 - a) for g, t in shapes.items() for i in range(len(t) - 1) for a in (0, 1)]
    g = Graph(spark.createDataFrame(nodes, "graph_id long, node_id long, kind string"), spark.createDataFrame(edges, "src long, dst long"))
    labels = refine.refine(g, ["kind"], 2)
    got = {r["graph_id"]: r["standing"] for r in unique.unique_graphs(g.nodes, labels).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5}
    rows = unique.cluster_graphs(g.nodes, labels, 0.0).collect()
    assert {r["graph_id"]: r["centre"] for r in rows} == got
    none = Graph(g.nodes.limit(0), g.edges.limit(0))
    assert unique.cluster_graphs(none.nodes, refine.refine(none, ["kind"], 1), 0.3).count() == 0


def test_left_out_equals_statistics_of_the_rest(spark):
    rng = random.Random(3)
    rows = [(s, c, rng.choice([0.0, 1e-3, 5.0, 1e6]) + rng.random()) for s in range(7) for c in range(4) for _ in range(rng.randrange(4))]
    table = spark.createDataFrame([(s, 0, c, y) for s, c, y in rows], "shard int, level int, cid int, y double").selectExpr("*", "CAST(null AS long) AS parent")
    plan = [(r, (s * (r + 1) + r) % 3, s) for r in range(2) for s in range(7)]
    got = crossval.fold_models(crossval.fit_shards(table), spark.createDataFrame(plan, "repeat int, fold int, shard int")).collect()
    held, want = {(r, s): f for r, f, s in plan}, {}
    for r, f, c in itertools.product(range(2), range(3), range(4)):
        if ys := [y for s, k, y in rows if k == c and held[r, s] != f]:
            want[r, f, c] = (len(ys), statistics.fmean(ys), statistics.pvariance(ys))
    assert {(x["repeat"], x["fold"], x["cid"]): (x["n"], pytest.approx(x["mean"]), pytest.approx(x["msd"], rel=1e-6, abs=1e-6)) for x in got} == want


def test_a_far_part_left_out_leaves_small_variances_exact(spark):
    parts = [("a", 0, 1, 1, 1e15, 0.0), ("b", 0, 1, 2, 1.0, 0.25), ("c", 0, 1, 2, 2.0, 0.25)]
    table = spark.createDataFrame(parts, "g string, level int, cid long, n long, mean double, msd double").selectExpr("*", "CAST(null AS long) AS parent")
    got = {r["fold"]: r for r in stats.leave_one_group_out(table, "g", spark.createDataFrame([("a",), ("z",)], "g string")).collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["msd"]) == (4, 1.5, 0.5)
    assert got["z"]["n"] == 5


def test_floors_are_additive_and_nulls_are_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.randrange(4), rng.choice([None, rng.random()])) for _ in range(200)]
    got = {r["shard"]: r for r in crossval.floors(spark.createDataFrame(rows, "o string, i string, shard int, y double"), ["o"], ["i"], "y", "shard").collect()}
    rows = [r for r in rows if r[3] is not None]
    mean = lambda pick: {k: statistics.fmean(r[3] for r in rows if pick(r) == k) for k in set(map(pick, rows))}
    inner, outer = mean(lambda r: r[:2]), mean(lambda r: r[0])
    for s in range(4):
        own = [r for r in rows if r[2] == s]
        assert got[s]["n"] == len(own)
        assert got[s]["sse"] == pytest.approx(sum((r[3] - inner[r[:2]]) ** 2 for r in own))
        assert got[s]["sse_outer"] == pytest.approx(sum((r[3] - outer[r[0]]) ** 2 for r in own))


def test_numbers_within_groups(spark):
    rows = [(i, None if i % 3 == 0 else "hot" if i % 10 else "cold") for i in range(1000)]
    table = spark.createDataFrame(rows, "k int, s string").repartition(5)
    got = order.numbered_within(table, ["s"], ["k"], "at", "size").collect()
    for s in (None, "hot", "cold"):
        own = sorted(k for k, x in rows if x == s)
        assert sorted((r["k"], r["at"]) for r in got if r["s"] == s) == [(k, i) for i, k in enumerate(own)]
        assert {r["size"] for r in got if r["s"] == s} == {len(own)}
    sizes = {(r["s"], r["part"]): r["count"] for r in sampling.partition(table, "k", ["s"], 3).groupBy("s", "part").count().collect()}
    assert len(sizes) == 9 and all(max(v) - min(v) <= 1 for v in ([sizes[s, p] for p in range(3)] for s in (None, "hot", "cold")))


def test_record_numbers_over_splits(spark, tmp_path):
    for name, n in (("a", 400), ("b", 3), ("c", 0)):
        (tmp_path / f"{name}.sdf").write_text("".join(f"r{name}{i}\n> <ID>\n{i}\n\n$$$$\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = stores.records(spark, str(tmp_path / "*.sdf")).withColumn("id", stores.record_field("ID")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 403 and all(int(r["id"]) == r["number"] for r in rows)


def test_typed_records_and_rejections(spark, tmp_path):
    fields = [{"ID": "m", "N": "2", "Q": "1.5| 2"}, {"N": "2", "Q": "1|2"}, {"ID": "m", "N": "2", "Q": "1|2|3"}, {"ID": "k", "N": "x", "Q": "1"}, {"ID": "m", "N": "2", "Q": "1|y"}, {"ID": "m", "N": "1"}]
    (tmp_path / "a.sdf").write_text("".join("t\n" + "".join(f"> <{k}>\n{v}\n\n" for k, v in f.items()) + "$$$$\n" for f in fields))
    fine, bad = stores.typed_records(stores.records(spark, str(tmp_path / "a.sdf")), {"ID": "string", "N": "int"}, {"Q": "double"}, ("ID",), "N")
    assert {(r["number"], r["ID"], r["N"], tuple(r["Q"] or ())) for r in fine.collect()} == {(0, "m", 2, (1.5, 2.0)), (5, "m", 1, ())}
    assert {r["number"]: r["reason"] for r in bad.collect()} == {1: "ID is missing", 2: "Q has another length", 3: "N is not int", 4: "Q has values that are not double"}
    named = stores.with_ordinals(fine, "ID", "conf_", "conf")
    assert {(r["number"], r["conf"]) for r in named.collect()} == {(0, "conf_0"), (5, "conf_1")}


def test_a_store_left_between_two_renames_comes_back(spark, tmp_path):
    path = str(tmp_path / "s")
    stores.replace_store(spark.range(3), path)
    shutil.move(path, f"{path}.old-1")
    (tmp_path / "s.new-1").mkdir()  # never written to its end
    assert stores.repair(spark, path) and spark.read.parquet(path).count() == 3
    assert not stores.repair(spark, path)
    made = []
    shutil.move(path, f"{path}.new-2")
    assert stores.stage(spark, path, lambda: made.append(1) or spark.range(9)).count() == 3 and not made


def test_half_a_model_does_not_load(spark, sf_dir, tmp_path):
    g = graphs.events_graph(spark, sf_dir)
    model = Model.fit(Config(("event_type",), 1), g)
    path = tmp_path / "m"
    model.save(str(path))
    assert Model.load(spark, str(path), verify=True).classes.count() == model.classes.count()
    with pytest.raises(ValueError):
        model.save(str(path))
    text = next((path / "config").glob("part-*"))
    said = json.loads(text.read_text())
    assert said["content"].split(":")[0] == str(model.classes.count())
    other = tmp_path / "o"
    Model.fit(Config(("event_type",), 1), Graph(g.nodes.where("graph_id % 2 = 0"), g.edges.limit(0))).save(str(other))
    shutil.rmtree(path / "classes")
    with pytest.raises(ValueError):
        Model.load(spark, str(path))
    shutil.copytree(other / "classes", path / "classes")
    with pytest.raises(ValueError):
        Model.load(spark, str(path))
