"""Queries against their SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from lattica import catalog

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each kind; the driver compares them all.
SOME = ["backoff_rmse", "induced_subgraph", "wl_star_counts", "coarse_neighbours", "merge_shards", "leave_one_group_out", "predict_loo", "shrink_eb", "analytic_loo", "normalize_std", "prefix_lookup", "isolated_rows", "components", "partition", "copy_rule"]


def rows_of(columns, rows):
    """Rows by their columns in order, sorted by what is exact in them first."""
    order = sorted(columns)
    exact = lambda row: [repr(x) for x in row if not isinstance(x, float)] + [f"{x:.3g}" for x in row if isinstance(x, float)]
    return sorted(([r[c] for c in order] for r in rows), key=exact)


def same(a, b):
    """Equal, or floats that differ where rounding may: by a millionth, or a thousandth of the last digit."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) or math.isnan(a) and math.isnan(b)
    return a == b


def compare(spark, name, query, text):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = query(spark, DATA)
    got = rows_of(df.columns, [r.asDict() for r in df.collect()])
    rel = db.execute(text)
    columns = [c[0] for c in rel.description]
    want = rows_of(columns, [dict(zip(columns, r, strict=True)) for r in rel.fetchall()])
    assert sorted(columns) == sorted(df.columns) and got, name
    assert len(got) == len(want)
    wrong = [(w, g) for w, g in zip(want, got, strict=True) if not all(map(same, w, g))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry_lists_every_query(spark):
    queries, texts = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalog.QUERIES) <= set(queries)
    assert set(texts) <= set(queries)
    assert __spark_entry__.entry(spark).count() == 3


def test_flagship_values(spark):
    got = {(r["matched_level"], r["n"], r["rmse"]) for r in __spark_entry__.entry(spark).collect()}
    assert got == {(0, 4, 17.672289), (1, 164, 55.79125), (2, 25, 66.074221)}
