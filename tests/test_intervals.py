"""Range joins against all pairs."""

import random

import pytest

from lorekeep.operators import intervals as V
from lorekeep.operators import state as S


@pytest.mark.parametrize("seed", range(3))
def test_meeting(spark, seed):
    rng = random.Random(seed)
    path = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    span = lambda n, w: [(path(), s, s + rng.randint(0, w)) for s in (rng.randint(0, 900) for _ in range(n))]
    items = [(i, *x) for i, x in enumerate(span(300, 6))] + [(999, "a", None, 5)]
    spans = span(60, 4) + [("b", 0, 400), (None, 0, 1000), ("a", None, 3)]
    got = V.meeting(spark.createDataFrame(items * 2, "item int, path string, line_start int, line_end int"), spark.createDataFrame(spans, "path string, line_start int, line_end int"))
    want = [i for i, p, s, e in items * 2 if s is not None and any(p is not None and p == q and a is not None and a <= e and b >= s for q, a, b in spans)]
    assert sorted(r["item"] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_innermost(spark, seed):
    rng = random.Random(seed)
    items = [(rng.choice("aab"), i, s, s + rng.choice([0, 1, 5, 40, 700])) for i, s in enumerate(rng.randint(0, 900) for _ in range(120))]
    points = [(rng.choice(["a", "b", "c", None]), rng.randint(0, 1700)) for _ in range(200)]
    got = V.innermost(spark.createDataFrame(points, "path string, at long"), spark.createDataFrame(items, "path string, item int, byte_start long, byte_end long"))
    want = {}
    for p, at in points:
        if around := [(s, i) for q, i, s, e in items if q == p and s <= at < e]:
            want[p, at] = max(around)[1]
    assert {(r["path"], r["at"]): r["item"] for r in got.collect()} == want


def test_ranges_of_one_large_path(spark):
    items = spark.range(200_000).selectExpr("id as item", "'a' as path", "id * 3 as byte_start", "id * 3 + 2 as byte_end", "id * 3 as line_start", "id * 3 + 1 as line_end")
    points = spark.range(0, 600_000, 7).selectExpr("'a' as path", "id as at")
    assert V.innermost(points, items).where("item <> floor(at / 3)").count() == 0
    assert V.innermost(points, items).count() == sum(i % 3 < 2 for i in range(0, 600_000, 7))
    spans = spark.range(1000).selectExpr("'a' as path", "id * 600 + 2 as line_start", "id * 600 + 3 as line_end")
    assert V.meeting(items, spans).count() == 1000


def test_contradicted_ids(spark):
    memory = spark.createDataFrame([(1, "never do it", "active"), (2, "do it", "active"), (3, "do it", "superseded"), (4, "fine", "active"), (5, "never", "active"), (6, "good", "active")], "memory_id long, body string, status string")
    entities = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (5, "y"), (4, "z"), (4, "z")], "memory_id long, entity string")
    said = spark.createDataFrame([(6, 9)], "memory_id long, target long")
    pairs = {r["memory_id"] for r in S.all_contradictions(memory, entities, said).collect()}
    assert {r["memory_id"] for r in S.contradicted_ids(memory, entities, said).collect()} == pairs == {1, 2, 6, 9}
