"""Exact quantiles of groups that are cut down by counts, and the robust fit that uses them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import curate, groups, order


def at(values, share, discrete):
    values = sorted(values)
    place = max(math.ceil(len(values) * share) - 1, 0) if discrete else (len(values) - 1) * share
    a, b = values[math.floor(place)], values[math.ceil(place)]
    return a if a == b else a + (b - a) * (place - math.floor(place))


def test_quantiles_are_exact_whatever_the_spread(spark, monkeypatch):
    monkeypatch.setattr(order, "FEW_ROWS", 8)
    draw = random.Random(4)
    groups = {
        "even": [float(i) for i in range(1000)],
        "ties": [draw.choice((0.0, 1.0)) for _ in range(1001)],
        "wide": [draw.gauss(0, 1) * 10.0 ** draw.randrange(-200, 200) for _ in range(2000)],
        "top": [1.0] * 499 + [1e300] * 501,
        "few": [3.0, 1.0, 2.0],
        "one": [5.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), (None, 1.0)]
    table = spark.createDataFrame(rows, "g string, v double")
    for share in (0.0, 0.5, 0.999):
        for discrete in (False, True):
            got = {r["g"]: r["quantile"] for r in order.group_quantiles(table, "g", "v", share, discrete).collect()}
            assert got == {g: at(vs, share, discrete) for g, vs in groups.items()}


def test_no_aggregate_holds_a_groups_residuals(spark, monkeypatch):
    """the median's buffer grew with the distinct residuals of a group."""

    def held(*_, **__):
        raise AssertionError("an exact or unbounded percentile of all rows")

    monkeypatch.setattr(F, "median", held)
    monkeypatch.setattr(F, "percentile", held)
    small = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, accuracy=10000: small(c, p, accuracy) if accuracy <= 10000 else held())
    rows = spark.createDataFrame([("a", "x", float(i), 2.0 * i + (i % 5) / 10 + (500.0 if i % 50 == 7 else 0.0)) for i in range(400)], "g string, s string, x double, y double")
    fit = curate.robust_line(rows, "g", "x", "y")
    line = fit.first()
    assert line["slope"] == pytest.approx(2, abs=1e-3) and line["n_used"] == 392
    off = [r["y"] - line["slope"] * r["x"] - line["intercept"] for r in rows.collect()]
    spread = 1.4826 * at([abs(x) for x in off], 0.5, True)
    got = curate.residual_scores(rows, fit, "g", "x", "y", "s").first()
    assert got["n"] == 400 and got["rms"] == pytest.approx(math.sqrt(sum((x / spread) ** 2 for x in off) / 400))


@pytest.mark.parametrize("block", (1 << 17, 40))
def test_shortest_sides_without_paths_as_rows(spark, monkeypatch, block):
    """F8: each triangle once, whether its nodes share colours or not; 40 edges a block make several colours."""
    monkeypatch.setattr(groups, "BLOCK_EDGES", block)
    draw = random.Random(8)
    edges = [(a, b, draw.randrange(1, 9) / 8) for a in range(30) for b in range(a + 1, 30) if a == 0 or draw.random() < 0.4]
    table = spark.createDataFrame(edges, "a long, b long, d double")
    want = sorted(r["d1"] for r in groups.triangles(table).collect())
    sides = groups.shortest_sides(table)
    assert sorted(x for r in sides.collect() for x in [r["d1"]] * r["n"]) == want and len(want) > 200
    got = groups.triangle_bounds(sides).first()
    assert (got["n"], got["longest"]) == (len(want), want[-1]) and got["q999"] == pytest.approx(at(want, 0.999, False))
    none = groups.triangle_bounds(groups.shortest_sides(table.limit(0))).first()
    assert (none["n"], none["q999"], none["longest"]) == (0, None, None)
