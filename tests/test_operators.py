import sqlite3

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import graph as G
from lorekeep.operators import index as I
from lorekeep.operators import search as R
from lorekeep.operators import state as S

ROWS = [
    (1, "Always acquire locks in a consistent global order", "project"), (2, "locks and more locks cause deadlock", "project"), (3, "nothing of note", "global"),
    (4, "A deadlock detected by order of locks", "global"), (5, "Ordering matters: ordered orders", "global"), (6, "locks and more locks cause deadlock", "global"),
]


def test_store_precedence(spark):
    rows = spark.createDataFrame(ROWS, "memory_id long, body string, store string")
    hits = rows.join(I.search_one(I.build(rows), "locks"), ["memory_id", "store"])
    assert sorted(r["memory_id"] for r in R.with_precedence(hits).collect()) == [1, 2, 4]


def test_rerank(spark):
    hits = spark.createDataFrame([("a", 1, 0.1), ("b", 2, None), ("c", 3, 0.9)], "id string, rank int, cosine double")
    assert [r["id"] for r in R.rerank_scored(hits, 10).orderBy("position").collect()] == ["c", "b", "a"]
    hits = spark.createDataFrame([("a", 1, 0.2), ("b", 2, 0.5), ("c", 3, 0.9)], "id string, rank int, cosine double")
    assert [r["id"] for r in R.rerank_window(hits, 2, ["rank"]).orderBy("position").collect()] == ["b", "a", "c"]


def test_foreign_device(spark):
    hits = spark.createDataFrame([("f", 100, "x"), ("l", 95, "me"), ("u", 90, None)], "id string, score long, origin_device string")
    got = R.downweight_foreign(hits, "me", 0.85).orderBy(F.desc("score")).collect()
    assert [r["id"] for r in got] == ["l", "u", "f"]


def test_cosine_and_scan(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: round(r["cosine"], 6) for r in R.vector_scan(rows, [1.0, 0.0]).collect()}
    assert got == {1: 1.0, 2: 0.0, 4: 0.707107}


def edges(spark, pairs, kind="calls", heuristic=()):
    return spark.createDataFrame([(a, b, kind, (a, b) in heuristic) for a, b in pairs], "src string, dst string, kind string, heuristic boolean")


def test_traversals(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "b")], heuristic={("a", "b")})
    start, both = spark.createDataFrame([("a",)], "node string"), G.adjacency(e)
    assert {(r["node"], r["hops"]) for r in G.neighbours(both, start, 2).collect()} == {("b", 1), ("c", 2), ("x", 2)}
    assert G.shortest_path(both, "a", "d") == ["a", "b", "c", "d"]
    assert G.shortest_path(both, "a", "zz") == []
    assert G.shortest_path(both, "a", "d", bound=2) == []
    reach = G.dependents(G.callers(e), spark.createDataFrame([("d",)], "node string"))
    assert {(r["node"], r["hops"], r["via_heuristic"]) for r in reach.collect()} == {("d", 0, False), ("c", 1, False), ("b", 2, False), ("a", 3, True), ("x", 3, False)}
    assert [(r["node"], r["tier"]) for r in G.impact(reach).collect()] == [("c", "High"), ("b", "Medium"), ("a", "Low"), ("x", "Low")]


def test_large_frontiers_and_plans(spark, monkeypatch):
    """A frontier above the bound is joined unnamed; one below it reaches the scan as a filter, and no edge is shuffled."""
    e = edges(spark, [(f"n{i}", f"n{(i * 7 + k) % 300}") for i in range(300) for k in range(3)])
    both, start = G.adjacency(e), spark.createDataFrame([("n1",), ("n2",)], "node string")
    named = sorted(map(tuple, G.hops(both, start, 3).collect()))
    front = G.hops(both, start, 0)
    plan = G._from(front, both, "src")._jdf.queryExecution().executedPlan().toString()
    assert "In(src, [n1,n2])" in plan and "BroadcastHashJoin" in plan and "hashpartitioning(src" not in plan
    monkeypatch.setattr(G, "NAMED", 1)
    assert sorted(map(tuple, G.hops(both, start, 3).collect())) == named


def test_overview(spark):
    nodes = spark.createDataFrame([(n, "function") for n in ("hub", "a", "b", "run", "lone")], "node string, kind string")
    hot, entry = G.overview(nodes, edges(spark, [("a", "hub"), ("b", "hub"), ("run", "a"), ("run", "a")]))
    assert [(r["node"], r["in_degree"]) for r in hot.collect()] == [("hub", 2), ("a", 1)]
    assert [(r["node"], r["out_degree"]) for r in entry.collect()] == [("b", 1), ("run", 1)]


def test_upsert_keeps(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, body string, hits int")
    new = spark.createDataFrame([(2, "B", 0), (3, "c", 0)], "id int, body string, hits int")
    assert sorted(map(tuple, S.upsert(old, new, "id", ("hits",)).collect())) == [(1, "a", 5), (2, "B", 6), (3, "c", 0)]


def test_usage_and_contradictions(spark):
    m = spark.createDataFrame([(1, "Use tabs", "active", 0), (2, "Do not use tabs", "active", 3), (3, "x", "superseded", 1)], "memory_id int, body string, status string, hit_count int")
    used = spark.createDataFrame([(1,), (1,), (3,), (9,)], "memory_id int")
    assert sorted((r["memory_id"], r["hit_count"]) for r in S.bump_usage(m, used).collect()) == [(1, 1), (2, 3), (3, 1)]
    ent = spark.createDataFrame([(1, "tabs"), (2, "tabs"), (3, "tabs")], "memory_id int, entity string")
    assert sorted(map(tuple, S.contradictions(m, ent).collect())) == [(1, 2), (2, 1)]


def test_reindex_plan(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, content_hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "path string, content_hash string")
    assert sorted(map(tuple, S.reindex_plan(a, b).collect())) == [("w", "index"), ("x", "unchanged"), ("y", "index"), ("z", "prune")]


def test_near_duplicate_pairs(spark):
    rows = spark.createDataFrame([(1, "acquire locks order"), (2, "acquire locks order always"), (3, "zebra"), (4, "zebra"), (5, None), (6, "")], "id int, x string")
    assert [tuple(r)[:2] for r in R.near_duplicate_pairs(rows, "id", "x").collect()] == [(1, 2)]


def test_budget_of_short_rows(spark):
    """The budget alone ends the running sum, not a count of rows."""
    from lorekeep.operators import state

    rows = [(i, 5 - i // 400, "x" * 20) for i in range(2000)]
    got = state.budgeted(spark.createDataFrame(rows, "id long, hits int, body string"), "id", F.char_length("body"), ["-hits", "id"], 32000)
    assert sorted(map(tuple, got.collect())) == [(i, 20 * i + 20) for i in range(1600)]


def test_freshness(spark):
    """Versioned, unused, healthy and old memories 200 days on; the cap keeps the most actionable; a dry run writes nothing."""
    rows = [
        (1, "project", "active", False, "ProjectConvention", "Use MSRV 1.82, the older flag is deprecated in the tool", 3, "2025-01-01"), (2, "project", "active", False, "ProjectConvention", "Keep handlers small and name them by their effect", 0, "2025-01-01"),
        (3, "project", "active", False, "ProjectConvention", "Prefer composition of small services over one large class", 1, "2025-01-01"), (4, "global", "active", False, "ProjectConvention", "Write the failing test before the fix in every service", 1, "2023-01-01"),
        (5, "project", "superseded", False, "ProjectConvention", "Keep handlers small and name them by their effect", 0, "2025-01-01"), (6, "project", "active", True, "ProjectConvention", "Keep handlers small and name them by their effect", 0, "2025-01-01"),
    ]
    memory = spark.createDataFrame(rows, "memory_id long, store string, status string, stale boolean, category string, body string, hit_count long, created_at string")
    today = F.date_add(F.lit("2025-01-01").cast("date"), 200)
    assert {r["memory_id"]: r["reason"] for r in S.freshness(memory, today).collect()} == {1: "VersionSensitive", 2: "Unused", 4: "Age"}
    assert [r["memory_id"] for r in S.freshness(memory, today, max_flags=1).collect()] == [1]
    both = S.freshness_report(memory, today, ("project", "global"), max_flags=2).first().asDict()
    assert both == {"scanned": both["scanned"], "low_quality": 0, "version_sensitive": 1, "unused": 1, "age": 1, "flagged": 2, "capped": True} and both["scanned"] >= 3
    assert S.freshness_report(memory, today, ("project", "global")).first()["capped"] is False
    stale = lambda df: {r["memory_id"] for r in df.where("stale").collect()}
    assert stale(S.freshness_pass(memory, today, ("project",))) == {1, 2, 6} and stale(S.freshness_pass(memory, today, ("project", "global"))) == {1, 2, 4, 6}
    assert stale(S.freshness_pass(memory, today, ("project", "global"), dry_run=True)) == {6}
