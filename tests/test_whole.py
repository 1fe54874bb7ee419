"""Queries that run over the whole job beside those that SQL checks over a part of it."""

import glob
import os
from types import SimpleNamespace

import duckdb
import pytest

from evograph import catalog
from evograph.operators import graph

SF = "/root/testdata/sf0.001"


def same(spark, name, text):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({text})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))
    return want


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_all_targets(spark):
    part = catalog.oracle_sql()["c3_co_changes"]
    assert part.count("LIMIT 20)") == 1
    want = same(spark, "c3_co_changes_all", part.replace("LIMIT 20)", ")"))
    assert len({r[2] for r in want}) > 20


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_chain_of_six(spark):
    depth = sorted(catalog.queries()["t1_call_chain_deep"](spark, SF).columns).index("depth")
    want = same(spark, "t1_call_chain_deep", graph.sql(graph._chain_sql(6)))
    assert max(r[depth] for r in want) > 3


def test_cycles_of_five_and_six(spark):
    ring = lambda names: list(zip(names, names[1:] + names[:1]))
    edges = ring("abc") + ring("defgh") + ring("ijklmn") + ring("opqrstu")
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {(r.cycle, r.length, r.severity) for r in graph.cycles_to_six(SimpleNamespace(file_imports=df)).collect()}
    assert got == {("a > b > c", 3, "low"), ("d > e > f > g > h", 5, "medium"), ("i > j > k > l > m > n", 6, "high")}
    assert "t5_cycles_to_six" in catalog.queries()


def test_large_components_are_walked(spark, monkeypatch):
    monkeypatch.setattr(graph, "WALK", 3, raising=False)  # was the bound on a component's edges
    edges = [(a, b) for a, b in zip("abcdef", "bcdefa")] + [("c", "b"), ("x", "y"), ("y", "x")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {(r.cycle, r.length) for r in graph.back_edges(SimpleNamespace(file_imports=df)).collect()}
    assert got == {("a > b > c > d > e > f", 6), ("b > c", 2), ("x > y", 2)}
