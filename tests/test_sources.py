"""Stores, record files, run logs, curation and the estimator."""

import json

import pytest

from lattica.estimator import BackOffRegressor
from lattica.model import Config
from lattica.operators import curate, lookup, sampling
from lattica.plans import graphs
from lattica.sources import stores


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "s00", "a"), (2, "test", "s01", "a"), (3, "val", "s00", "b")], "k int, split string, shard string, m string")
    summary = stores.write_store(rows, str(tmp_path / "s"), "shard", member="m")
    assert {(r["split"], r["n_rows"], r["n_members"]) for r in summary.collect()} == {("train", 1, 1), ("test", 1, 1), ("val", 1, 1)}
    assert {r["k"] for r in stores.load_store(spark, str(tmp_path / "s"), ("train", "val")).collect()} == {1, 3}
    assert {r["k"] for r in stores.load_store(spark, str(tmp_path / "s"), limit=2, ordinal="k").collect()} == {1, 2}
    assert {r["k"] for r in stores.load_shards(spark, str(tmp_path / "s"), ["s00"]).collect()} == {1, 3}
    with pytest.raises(ValueError):
        stores.load_store(spark, str(tmp_path / "s"), ("dev",))


def test_records_and_runs(spark, tmp_path):
    (tmp_path / "a.sdf").write_text("one\n> <ID>\n7\n\n$$$$\ntwo\n> <ID>\n8\n$$$$\n")
    got = stores.records(spark, str(tmp_path / "a.sdf")).select(stores.record_field("ID").alias("id"), stores.record_field("X").alias("x")).collect()
    assert [(r["id"], r["x"]) for r in got] == [("7", None), ("8", None)]
    for run, rmse in (("r1", 1.0), ("r2", float("nan"))):
        (tmp_path / "runs/e" / run).mkdir(parents=True)
        (tmp_path / "runs/e" / run / "metrics.json").write_text(json.dumps({"rmse": rmse, "n": 2}).replace("NaN", "null"))
    rows = stores.read_runs(spark, str(tmp_path / "runs"))
    assert {(r["run"], r["metric"], r["value"]) for r in rows.collect()} == {("r1", "rmse", 1.0), ("r1", "n", 2.0), ("r2", "n", 2.0)}
    assert "| metric | e |" in stores.markdown(stores.report(rows, "metric", "experiment", "value"))


def test_lookup_and_samples(spark):
    rows = spark.createDataFrame([(1, "a/b", 1.0), (2, "a/c", 3.0), (3, "d", 8.0)], "k int, code string, y double")
    sums = lookup.prefix_sums(rows, "code", "y", "/", 2)
    got = {r["k"]: (r["value"], r["radius"]) for r in lookup.prefix_lookup(rows, "k", "code", sums, "/", 2, 2).collect()}
    assert got == {1: (2.0, 1), 2: (2.0, 1), 3: (4.0, 0)}
    parts = sampling.partition(spark.range(10).selectExpr("id", "id % 2 AS s"), "id", ["s"], 2)
    assert sorted(r["count"] for r in parts.groupBy("s", "part").count().collect()) == [2, 2, 3, 3]


def test_robust_line_ignores_outliers(spark):
    rows = [("g", float(x), 2.0 * x + 1 + 0.01 * (-1) ** x) for x in range(40)] + [("g", 5.0, 500.0)]
    fit = curate.robust_line(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y").first()
    assert fit["n_used"] == 40 and fit["slope"] == pytest.approx(2, abs=1e-3)


def test_estimator(spark, sf_dir):
    g = graphs.events_graph(spark, sf_dir)
    model = BackOffRegressor(Config(("event_type",), 1), g.edges, minimum_support=2).fit(g.nodes)
    assert model.transform(g.nodes).where("prediction IS NOT NULL").count() == 1000
