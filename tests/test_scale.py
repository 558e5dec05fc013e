"""Operators against brute force where their form is made for scale: rounds, splits, running sums, centred sums."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import predictors
from lattica.operators import estimate, groups, lookup, order, sampling, similarity, stats
from lattica.sources import stores


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(0)
    names = rng.permutation(10_000).tolist()
    pairs = spark.createDataFrame([(names[k], names[k + 1]) for k in range(9999)] + [(20_001, 20_000)], "a long, b long")
    keys = spark.createDataFrame([(k,) for k in [*range(10_000), 20_000, 20_001, 30_000]], "key long")
    began = time.time()
    got = {r["key"]: r["component"] for r in similarity.components(pairs, keys).collect()}
    assert got == {**{k: 0 for k in range(10_000)}, 20_000: 20_000, 20_001: 20_000, 30_000: 30_000}
    assert time.time() - began < 120


def test_near_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_BITS", 60)
    monkeypatch.setattr(similarity, "STEP_ROWS", 3)
    monkeypatch.setattr(similarity, "STEP_BITS", 8)
    rng = np.random.default_rng(1)
    sets = {k: set(rng.choice(40, rng.integers(1, 30), replace=False).tolist()) for k in range(60)}
    sets |= {60: set(sets[0]), 61: sets[1] | {39}, 62: {1}, 63: {1, 77}}
    bits = spark.createDataFrame([(k, int(b)) for k, s in sets.items() for b in s], "key long, bit int")
    for cutoff in (0.0, 0.5, 0.8):
        want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= (1 - cutoff) * len(sets[a] | sets[b]) - 1e-9}
        assert {tuple(r) for r in similarity.tanimoto_pairs(bits, cutoff).collect()} == want


def deal(clusters, shares):
    """Sequential: largest first, each into the split that lacks most."""
    total, filled, out = sum(s for _, s in clusters), {n: 0 for n, _ in shares}, {}
    for c, s in sorted(clusters, key=lambda x: (-x[1], x[0])):
        name = max(shares, key=lambda x: x[1] * total - filled[x[0]])[0]
        filled[name] += s
        out[c] = name
    return out


@pytest.mark.parametrize("seed", range(3))
def test_clusters_of_one_size_are_dealt_as_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    clusters = [(k, int(s)) for k, s in enumerate(rng.choice([1, 1, 1, 2, 3, 7, 40], 300))]
    shares = [("train", 0.75), ("val", 0.125), ("test", 0.125)]
    table = spark.createDataFrame(clusters, "cluster long, size long")
    assert {r["cluster"]: r["split"] for r in similarity.fill_splits(table, shares).collect()} == deal(clusters, shares)
    got = similarity.whole_clusters(table, shares, 3)
    assert {r["shard"] for r in got.where("split = 'train'").collect()} == {"s00", "s01", "s02"} and got.count() == 300
    with pytest.raises(ValueError):
        similarity.whole_clusters(table.limit(2), shares, 3)


def test_stratified_fill_balances_strata(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(a), int(b)) for k, (a, b) in enumerate(rng.integers(1, 6, (200, 2)))]
    shares = [("train", 0.5), ("test", 0.5)]
    got = {r["cluster"]: r["split"] for r in similarity.stratified_fill(spark.createDataFrame(rows, "cluster long, x long, y long"), ["x", "y"], shares).collect()}
    assert set(got) == set(range(200))
    for stratum in (1, 2):
        whole = sum(r[stratum] for r in rows)
        assert abs(sum(r[stratum] for r in rows if got[r[0]] == "train") / whole - 0.5) < 0.02


def test_numbers_and_running_sums(spark):
    rows = spark.createDataFrame([(int(k), int(k % 7)) for k in np.random.default_rng(2).permutation(5000)], "k long, w long")
    assert {(r["k"], r["n"]) for r in order.numbered(rows, ["k"], "n").collect()} == {(k, k) for k in range(5000)}
    before = np.concatenate(([0], np.cumsum(np.arange(5000) % 7)))
    got = order.running(rows, ["k"], "w", "before", "all").collect()
    assert {(r["k"], r["before"], r["all"]) for r in got} == {(k, int(before[k]), int(before[-1])) for k in range(5000)}
    assert order.numbered(rows.limit(0), ["k"], "n").count() == 0


def test_errors_keep_their_digits_far_from_zero(spark):
    rng = np.random.default_rng(3)
    y = 1e8 + rng.normal(size=600)
    a, b = rng.integers(0, 4, 600), rng.integers(0, 90, 600)
    nodes = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "node_id long, y double")
    labels = spark.createDataFrame([r for k in range(600) for r in ((k, 0, int(a[k]), None), (k, 1, int(1000 * a[k] + b[k]), int(a[k])))], "node_id long, level int, cid long, parent long")
    classes, whole = stats.class_stats(labels, nodes), stats.global_stats(nodes)
    fine, top = {}, {}
    for k in range(600):
        fine.setdefault((a[k], b[k]), []).append(y[k])
        top.setdefault(a[k], []).append(y[k])
    sse = sum((y[k] - (np.mean(fine[a[k], b[k]]) if len(fine[a[k], b[k]]) >= 2 else np.mean(top[a[k]]))) ** 2 for k in range(600))
    got = estimate.train_stats(classes, whole, 1, 2).first()
    assert got["sse"] == pytest.approx(sse, rel=1e-6) and got["r2"] == pytest.approx(1 - sse / (600 * y.var()), rel=1e-5)
    codes = nodes.join(labels.where("level = 1"), "node_id").select(F.concat_ws("/", F.col("parent").cast("string"), F.col("cid").cast("string")).alias("code"), "y")
    sums = {(r["radius"], r["key"]): r["msd"] for r in lookup.prefix_sums(codes, "code", "y", "/", 2).collect()}
    assert sums[1, "0"] == pytest.approx(np.var(top[0]), rel=1e-6)
    with pytest.raises(ValueError):
        estimate.analytic_error(classes, whole, 1, 2, True, "shrunk")
    assert estimate.supports_loo("count") and not estimate.supports_loo("empirical_bayes")


def test_within_structure_sums_are_checked(spark):
    table = lambda *rows: spark.createDataFrame(rows, "sse double, n long")
    assert estimate.within_structure(table((6.0, 2), (3.0, 1))) == 3 and estimate.within_structure(table((0.0, 0))) == 0
    for wrong in ((-1.0, 2), (1.0, 0), (float("nan"), 3), (float("inf"), 3)):
        with pytest.raises(ValueError):
            estimate.within_structure(table(wrong))


def test_store_maintenance(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(k // 4, k, float(k % 4) + (9.0 if k == 5 else 0.0)) for k in range(40)], "mol long, atom long, y double")
    made = []
    for _ in range(2):
        stores.stage(spark, path, lambda: made.append(1) or rows)
    assert len(made) == 1 and stores.row_count(spark, path) == 40
    stores.annotate(spark, path, {"double_y": F.col("y") * 2})
    assert stores.load_states(spark, path, "atom long, y double, missing double").where("missing IS NULL").count() == 40
    first = stores.drop_isolated(spark, path, ["mol"], "mol", "y", 5.0)
    assert first == {"rows_before": 40, "rows_after": 36, "threshold": 5.0}
    assert stores.drop_isolated(spark, path, ["mol"], "mol", "y", 5.0) == first
    assert stores.check_domain(rows, "mol", tuple(range(10))).count() == 40
    with pytest.raises(Exception, match="mol can't be"):
        stores.check_domain(rows, "mol", (0, 1)).count()
    key = {"folds": 2}
    for _ in range(2):
        assert stores.cached(spark, f"file://{tmp_path}/cache", key, lambda: rows).count() == 40
    with pytest.raises(ValueError):
        stores.cached(spark, f"file://{tmp_path}/cache", {"folds": 3}, lambda: rows)


def test_runs_are_written_and_read(spark, tmp_path):
    root = f"file://{tmp_path}"
    stores.write_run(spark, root, "e", "r1", {"rmse": 1.5, "bad": float("nan")}, {"commit": "abc", "fold": "1"}, spark.range(3).toDF("id"))
    stores.write_run(spark, root, "e", "r2", {"rmse": 2.5}, {"commit": "abd"})
    assert sorted((r["run"], r["metric"], r["value"]) for r in stores.read_runs(spark, root).collect()) == [("r1", "rmse", 1.5), ("r2", "rmse", 2.5)]
    assert stores.commits(stores.read_manifests(spark, root)).first()["commits"] == ["abc", "abd"]
    with pytest.raises(ValueError):
        stores.write_run(spark, root, "e", "r2", {}, {})
    assert json.loads(json.dumps(stores.configured({"a": {"b": 1, "c": "x"}}, {}, ("a.b=2",)))) == {"a.b": 2, "a.c": "x"}
    with pytest.raises(ValueError):
        stores.configured({"a": 1}, {"b": 2})


def test_predictors_by_name(spark):
    nodes = spark.createDataFrame([(0, k, "xy"[k % 2], float(k % 2)) for k in range(10)], "graph_id long, node_id long, a string, y double")
    edges = spark.createDataFrame([], "src long, dst long")
    got = predictors.build("back_off", levels=("a",), depth=0).fit(nodes, edges).predict(nodes, edges).join(nodes, "node_id").where("value <> y").count()
    assert got == 0
    assert predictors.build("global_mean").fit(nodes, edges).predict(nodes, edges).first()["value"] == 0.5
    with pytest.raises(ValueError):
        predictors.build("no such thing")
    with pytest.raises(ValueError):
        predictors.register("prefix", predictors.Prefix)


def test_drawn_pairs_are_distinct(spark):
    rows = spark.createDataFrame([(g, k, float(k)) for g, n in ((1, 3), (2, 50), (3, 1)) for k in range(n)], "g long, k long, v double")
    got = groups.drawn_pairs(rows, "g", ["k"], "k", "v", 20).collect()
    assert len({(r["g"], r["a"], r["b"]) for r in got}) == len(got) == 23 and all(r["a"] < r["b"] for r in got)


def test_sequential_fill_ends(spark):
    clusters = spark.createDataFrame([(k, 10) for k in range(10)], "c long, size long")
    split = [r["split"] for r in sampling.sequential_fill(clusters, ["c"], "size", 0.5, 0.2).orderBy("c").collect()]
    assert split == ["train"] * 5 + ["val"] * 2 + ["test"] * 3
    assert {r["split"] for r in sampling.sequential_fill(clusters, ["c"], "size", 1.0, 0.0).collect()} == {"train"}
