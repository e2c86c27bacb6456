"""Every query runs on the smallest tables and equals its SQL."""

import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    got = duck.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_columns_of_the_found_queries(spark):
    want = {
        "p1_found": ["rec_id", "field", "pos", "tag", "item"], "p2_found": ["rec_id", "field", "quantity"], "p3_found": ["edge_id", "link_id"],
        "p4_found": ["rec_id", "parent_type", "parent_id", "kind", "pos", "name", "item"], "p5_found": ["rec_id", "zone_id", "relation"],
        "p6_found": ["src", "rec_id", "ref_type", "ref", "status", "period"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_a", "doc_b"],
    }
    q = entry.queries()
    for name, cols in want.items():
        if name in q:
            df = q[name](spark, DATA)
            assert df.columns == cols
            for c, kind in df.dtypes:
                text = c in ("field", "tag", "item", "edge_id", "parent_type", "kind", "name", "zone_id", "relation", "src", "ref_type", "status", "period")
                assert kind == ("array<int>" if c == "ids" else "string" if text else "bigint"), (name, c, kind)


def test_graph_has_an_edge_of_every_customer(spark):
    from gridloom.plans import fixtures as fx

    customers = spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").collect()
    assert Counter(r.edge_id for r in fx.derived(spark, DATA, fx.GRAPH).collect()) == Counter(r.c_custkey for r in customers)
