"""Every registered query runs on the smallest tables; those with SQL agree with it."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
#: Cheap ones; the driver runs all.
NAMES = ["degree", "entropy_2d", "part_di", "pair_delta_di", "shp_part_stats", "graph_radius", "graph_knn_sym", "repair_isolated", "silhouette", "way_segments", "p4_found", "p5_found"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    got = sorted(str([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    r = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    want = sorted(str([norm(x[cols.index(c)]) for c in sorted(cols)]) for x in r.fetchall())
    assert sorted(cols) == sorted(df.columns) and got == want


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() == 1
