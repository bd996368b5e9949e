"""Walks over edges as the tables tell them, and over stored ones: what is shuffled, and that both give the same."""

from __future__ import annotations

from lorekeep.operators import graph as G
from lorekeep.plans import bindings as B
from lorekeep.plans import retrieval

SF = "/root/testdata/sf0.001"


def test_edges_are_stored_by_one_shuffle_and_once(spark, monkeypatch):
    plans, settle = [], G.settle
    monkeypatch.setattr(G, "settle", lambda df, name: (plans.append(df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()), settle(df, name))[1])
    pairs = [("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "c")]
    e = spark.createDataFrame([(a, b, "calls", False) for a, b in pairs * 3], "src string, dst string, kind string, heuristic boolean")
    assert sorted(map(tuple, G.adjacency(e).collect())) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "c")]
    assert sorted(map(tuple, G.callers(e).collect())) == [("a", "b", False), ("b", "a", False), ("c", "b", False), ("c", "c", False)]
    assert len(plans) == 2 and all("rangepartitioning" in p and "hashpartitioning" not in p for p in plans)


def test_a_short_walk_stores_no_edges(spark):
    at = (spark.sparkContext.applicationId, SF, "adjacency")
    B._GRAPHS.pop(at, None)
    names = ("G1_neighbours", "G2_focus_distances")
    fresh = [sorted(map(tuple, retrieval.QUERIES[n](spark, SF).collect())) for n in names]
    assert at not in B._GRAPHS
    B.adjacency(spark, SF)
    assert fresh[0] and fresh == [sorted(map(tuple, retrieval.QUERIES[n](spark, SF).collect())) for n in names]
