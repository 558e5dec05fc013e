"""Stereo-aware refinement on small graphs whose classes are known, running sums with equal keys, and caches of other rows."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from lattica import crossval
from lattica.operators import aware, order
from lattica.operators.graph import Graph

CENTRES = "centre long, n0 long, n1 long, n2 long, n3 long, parity int"
BONDS = "bond long, a long, b long, a1 long, a2 long, b1 long, b2 long, cis int"


def graph(spark, kinds, pairs):
    nodes = spark.createDataFrame([(n // 100, n, k, float(n)) for n, k in kinds.items()], "graph_id long, node_id long, kind string, y double")
    return Graph(nodes, spark.createDataFrame([x for a, b in pairs for x in ((a, b), (b, a))], "src long, dst long"))


def star(base, parity, order_):
    """A centre with four unlike neighbours, listed in an order."""
    kinds = {base: "C"} | {base + 1 + i: k for i, k in enumerate("HFIB")}
    return kinds, [(base, base + 1 + i) for i in range(4)], (base, *(base + 1 + i for i in order_), parity)


def test_hands_are_told_apart_and_mirrors_pooled(spark):
    # 100 and 200 are mirror images; 300 is 200 with an even permutation of its list, 400 one with an odd permutation and the other parity.
    made = [star(100, 1, (0, 1, 2, 3)), star(200, -1, (0, 1, 2, 3)), star(300, -1, (1, 2, 0, 3)), star(400, 1, (1, 0, 2, 3))]
    kinds, pairs = {k: v for m in made for k, v in m[0].items()}, [p for m in made for p in m[1]]
    bonds = spark.createDataFrame([], BONDS)
    labels = aware.refine(graph(spark, kinds, pairs), ["kind"], 2, spark.createDataFrame([m[2] for m in made], CENTRES), bonds)
    at = {(r["node_id"], r["level"]): r for r in labels.collect()}
    a, b, c, d = (at[k, 1] for k in (100, 200, 300, 400))
    assert a["blind"] == b["blind"] == c["blind"] and b["aware"] == c["aware"] == d["aware"] != a["aware"] == b["mirror"] and a["mirror"] == b["aware"]
    assert at[101, 1]["aware"] == at[101, 1]["blind"] and at[101, 2]["aware"] != at[101, 2]["blind"]  # a code moves by one edge a round
    assert (at[101, 2]["first"], at[101, 2]["last"], at[101, 2]["many"]) == (100, 100, False)
    words = {(r["level"], r["cid"]): r for r in aware.vocabulary(labels).collect()}
    assert words[1, a["aware"]]["kinds"] == aware.AWARE | aware.MIRROR and words[1, a["aware"]]["mirror_of"] == b["aware"] and words[1, a["aware"]]["blind_of"] == a["blind"]


def test_equal_neighbours_give_no_code(spark):
    kinds = {100: "C", 101: "H", 102: "H", 103: "F", 104: "I"}
    labels = aware.refine(graph(spark, kinds, [(100, k) for k in (101, 102, 103, 104)]), ["kind"], 3, spark.createDataFrame([(100, 101, 102, 103, 104, 1)], CENTRES), spark.createDataFrame([], BONDS))
    assert labels.where("aware <> blind OR first IS NOT NULL OR many OR ez").count() == 0


def bonded(base, cis):
    kinds = {base: "C", base + 1: "C", base + 2: "F", base + 3: "H", base + 4: "F", base + 5: "H"}
    pairs = [(base, base + 1), (base, base + 2), (base, base + 3), (base + 1, base + 4), (base + 1, base + 5)]
    return kinds, pairs, (base, base, base + 1, base + 2, base + 3, base + 4, base + 5, cis)


def test_double_bonds_from_the_second_round_on(spark):
    made = [bonded(100, 1), bonded(200, 0)]
    kinds, pairs = {k: v for m in made for k, v in m[0].items()}, [p for m in made for p in m[1]]
    g = graph(spark, kinds, pairs)
    labels = aware.refine(g, ["kind"], 3, spark.createDataFrame([], CENTRES), spark.createDataFrame([m[2] for m in made], BONDS))
    at = {(r["node_id"], r["level"]): r for r in labels.collect()}
    assert at[100, 1]["aware"] == at[200, 1]["aware"] and at[100, 2]["blind"] == at[200, 2]["blind"]
    assert at[100, 2]["aware"] != at[200, 2]["aware"] and at[100, 2]["aware"] == at[100, 2]["mirror"]  # a bond is its own mirror image
    assert at[100, 2]["ez"] and not at[102, 2]["ez"] and at[102, 3]["ez"]
    classes = aware.statistics(labels, g.nodes)
    got = {r["level"]: r for r in aware.aware_variance(classes).collect()}
    assert set(got) == {2, 3} and got[2]["groups"] == 1 and got[2]["members"] == 2
    # Two members of two atoms each (means 100.5 and 200.5, variances 0.25): mean square 2 * 2500 over 1, noise 0.125.
    assert got[2]["noise"] == pytest.approx(0.125) and got[2]["tau2"] == pytest.approx(5000 - 0.125)


def test_no_nodes(spark):
    g = graph(spark, {1: "C"}, [(1, 1)])
    none = Graph(g.nodes.limit(0), g.edges.limit(0))
    labels = aware.refine(none, ["kind"], 2, spark.createDataFrame([], CENTRES), spark.createDataFrame([], BONDS))
    assert labels.count() == 0 and aware.told_apart(labels).count() == 0 and aware.vocabulary(labels).count() == 0


def test_running_sums_count_rows_not_keys(spark):
    rows = spark.createDataFrame([(1, 4), (1, 6), (2, 5)], "k int, w long")
    got = sorted((r["k"], r["before"], r["w"], r["total"]) for r in order.running(rows, ["k"], "w", "before", "total").collect())
    assert got[0][1] == 0 and got[1][1] == got[0][2] and got[2][1] == 10 and {x[3] for x in got} == {15}


def test_a_cache_of_other_rows_is_refused(spark, tmp_path):
    def rows(add):
        return spark.range(80).select(F.col("id").alias("node_id"), (F.col("id") % 4).alias("shard"), F.explode(F.array(F.lit(0), F.lit(1))).alias("level"), F.lit(None).cast("long").alias("parent"), (F.col("id") + add).cast("double").alias("y"), (F.col("id") % 3).alias("cid"))

    cache, variants = f"file://{tmp_path}/models", [crossval.Variant("plain")]
    run = lambda add: sorted(map(tuple, crossval.run(rows(add), 2, 1, [1], variants, cache).collect()))
    assert run(0) == run(0)
    with pytest.raises(ValueError):
        run(1000)


def test_fingerprints_in_the_order_of_md5(spark):
    """F3 to F6: of atoms that are some of a node's neighbours, the order of fingerprints says which structures are one class; SQL's order is MD5's."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    kinds, pairs, bonds, want = {}, [], [], []
    for i, (x, y, z) in enumerate(itertools.permutations("FHIBN", 3)):
        for k, second in enumerate((2, 3)):
            base = 1000 * (i + 1) + 100 * k
            kinds |= {base + j: c for j, c in enumerate(("C", x, y, z, "C", "P", "Q"))}
            pairs += [(base, base + j) for j in (1, 2, 3, 4)] + [(base + 4, base + 5), (base + 4, base + 6)]
            bonds.append((base, base, base + 4, base + 1, base + second, base + 5, base + 6, 1))
        want.append((md5(x) > md5(y)) == (md5(x) > md5(z)))
    labels = aware.refine(graph(spark, kinds, pairs), ["kind"], 2, spark.createDataFrame([], CENTRES), spark.createDataFrame(bonds, BONDS), texts=True)
    at = {r["node_id"]: r for r in labels.where("level = 2").collect()}
    both = [(at[1000 * (i + 1)], at[1000 * (i + 1) + 100]) for i in range(len(want))]
    assert all(a["blind"] == b["blind"] != a["aware"] for a, b in both)
    assert [a["aware"] == b["aware"] for a, b in both] == want


def test_levels_one_by_one_are_those_of_all(spark):
    """a level's table goes when no round reads it, and gives what the tables of all levels give."""
    kinds, pairs, bond = bonded(100, 1)
    g, args = graph(spark, kinds, pairs), (["kind"], 3, spark.createDataFrame([(100, 101, 102, 103, None, 1)], CENTRES), spark.createDataFrame([bond], BONDS))
    once = sorted(map(tuple, aware.told_apart(aware.refine(g, *args, texts=True)).collect()))
    assert once == sorted(map(tuple, aware.by_level(aware.told_apart, g, *args, texts=True).collect())) and len(once) == 4
    on = lambda a, b: {(100, 101), (101, 100)} >= {(a, b)}
    apart = spark.createDataFrame([x for a, b in pairs if not on(a, b) for x in ((a, b), (b, a))], "src long, dst long")
    assert once == sorted(map(tuple, aware.by_level(aware.told_apart, Graph(g.nodes, apart), *args, texts=True, bonded=spark.createDataFrame([(100, 101), (101, 100)], "src long, dst long")).collect()))
