"""Passages against FTS5's own, and the accepted memory of many candidates against one search at a time."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import index as I
from lorekeep.operators import passages as P

WORDS = [f"filler{i}" for i in range(40)] + ["lock", "locks", "order", "config", "toml", "foo", "bar", "quokka"]
QUERIES = ["locks", "lock order", "quokka order locks", "config.toml", "config.toml order foo", "foo foo bar", "bar.foo lock", "foo.bar foo"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    out = []
    for i in range(160):
        n = rng.choice([3, 20, 31, 32, 33, 40, 90, 200])
        words = [rng.choice(WORDS[:40] if rng.random() < 0.85 else WORDS[40:]) + rng.choice([" ", " ", " ", ", ", ". ", ": ", ".\n", ".", "-"]) for _ in range(n)]
        out.append((i, rng.choice(["", "  ", "# "]) + "".join(words) + rng.choice(["", ".", " !", "\n"]), rng.choice(["project", "project", "global"])))
    first = next(r for r in out if r[2] == "project" and "lock" in r[1])
    return [*out, (500, first[1], "global"), (501, "locks " * 2000, "project"), (502, "", "project")]


def plain_hits(rows, query):
    """(id, store, snippet) in order: project hits, then global ones that no project hit has by id or text."""
    terms = T.significant_terms(query)
    match = " OR ".join(f'"{t}"*' if len(t) >= 4 else f'"{t}"' for t in terms)
    out, seen = [], set()
    for store in ("project", "global"):
        con = sqlite3.connect(":memory:")
        con.execute("create virtual table f using fts5(body)")
        con.executemany("insert into f(rowid, body) values (?, ?)", [(i, b) for i, b, s in rows if s == store])
        found = con.execute("select rowid, body, round(-bm25(f), 6) as r, snippet(f, 0, '', '', '…', 32) from f where f match ? order by r desc, rowid", (match,)).fetchall()
        for i, body, _, snippet in found:
            if len(terms) >= 3 and sum(t.lower() in body.lower() for t in terms) < 2 or (store == "global" and (i in {x for x, _ in seen} or body in {b for _, b in seen})):
                continue
            out.append((i, store, snippet))
            if store == "project":
                seen.add((i, body))
    return out


@pytest.fixture(scope="module")
def made(spark, rows):
    memory = spark.createDataFrame(rows, "memory_id long, body string, store string").repartition(3)
    return memory, I.build(memory), spark.createDataFrame(list(enumerate(QUERIES)), "ask int, query string")


def test_snippets_like_sqlite(rows, made):
    memory, index, asked = made
    hits = P.in_order(I.search(index, asked, memory), memory, ["memory_id", "store"])
    got = P.passages(index, asked, hits, memory).collect()
    for k, query in enumerate(QUERIES):
        own = [(r["memory_id"], r["store"], r["snippet"]) for r in sorted((r for r in got if r["ask"] == k), key=lambda r: r["rank"])]
        assert own == plain_hits(rows, query), query


def test_related_and_accepted(spark, rows, made):
    memory, index, asked = made
    got = {r["ask"]: r["related"] for r in P.related(index, asked, memory).collect()}
    best = {r["ask"]: r for r in P.accepted_matches(index, asked, memory).collect()}
    sets = lambda texts: spark.createDataFrame([(t,) for t in texts], "t string").select(T.token_set("t").alias("s")).collect()
    for k, query in enumerate(QUERIES):
        hits = plain_hits(rows, query)
        assert got[k] == [i for i, *_ in hits[:5]]
        mine = set(sets([query])[0]["s"])
        overlaps = []
        for r in sets([h[2] for h in hits]):
            other = set(r["s"])
            overlaps.append(len(mine & other) / min(len(mine), len(other)) if mine and other else 0.0)
        at = overlaps.index(max(overlaps))
        assert (best[k]["memory_id"], best[k]["store"]) == hits[at][:2] and best[k]["overlap"] == pytest.approx(overlaps[at])
        assert best[k]["duplicate"] == (overlaps[at] >= 0.6) and best[k]["topic"] == (overlaps[at] >= 0.3)


def test_nothing_to_find(spark, made):
    memory, index, _ = made
    asked = spark.createDataFrame([(1, "zebra"), (2, ""), (3, None)], "ask int, query string")
    assert P.related(index, asked, memory).count() == P.accepted_matches(index, asked, memory).count() == 0
    hits = memory.limit(1).select(F.lit(1).alias("ask"), "memory_id", "store")
    assert P.passages(index, asked, hits, memory).first()["snippet"] is None


@pytest.mark.parametrize("most", [1, 4, 30, 500])
def test_the_first_hits_alone(spark, made, most):
    """The first hits as all hits in order have them, also where global ones follow; places of their texts alone."""
    memory, index, asked = made
    names = ["memory_id", "store"]
    hits = I.search(index, asked, memory)
    key = lambda df: sorted((r["ask"], r["rank"], r["memory_id"], r["store"]) for r in df.collect())
    first = P.in_order(hits, memory, names, most)
    assert key(first) == key(P.in_order(hits, memory, names).where(F.col("rank") <= most))
    shown = lambda few: sorted((r["ask"], r["rank"], r["snippet"]) for r in P.passages(index, asked, first, memory, few).collect())
    assert shown(True) == shown(False)
    terms, texts = I._terms(I.query_terms(asked)), memory.where("memory_id % 9 = 1").select(*names)
    assert {r["memory_id"] % 9 for r in I.places(index, terms, texts).collect()} == {1}


@pytest.mark.parametrize("most", [2, 30])
def test_first_hits_are_those_of_the_whole_search(spark, most):
    """Also where bodies have to tell whether enough terms occur, and where a query has few project hits."""
    pick = random.Random(3)
    words = ["lock", "locks", "blocked", "order", "disorder", "café", "config.toml", "pool", "retry", "the", "straße", "timeouts"]
    data = [(i, "global" if i % 3 == 0 else "project", " ".join(pick.choice(words) for _ in range(pick.choice([2, 5, 30])))) for i in range(160)]
    data += [(200 + i, "global", data[i][2]) for i in range(12)] + [(300, "project", None)]
    rows = spark.createDataFrame(data, "memory_id long, store string, body string")
    asked = ["lock order pool", "config.toml retry lock", "ock rder disorder", "timeouts", "straße café the lock", "absent"]
    asked = spark.createDataFrame(list(enumerate(asked)), "ask int, query string")
    index, names = I.build(rows), ["memory_id", "store"]
    some = rows.where("memory_id % 7 <> 0")
    want = P.in_order(I.search(index, asked, some).join(some.select(*names), names, "left_semi"), some, names, most)
    got = P.first_hits(index, asked, some, most)
    cut = lambda df: sorted((r["ask"], r["rank"], r["memory_id"], r["store"], r["score"]) for r in df.collect())
    assert cut(got) == cut(want) and got.count() >= 2 * most


def test_tokens_that_hold_a_term_inside_are_not_read(spark):
    """Each of them was a row a place and a term before, also for searches that return a few hits."""
    index = I.build(spark.createDataFrame([(0, "project", "block lock locks order pool")], "memory_id long, store string, body string"))
    terms = I._terms(I.query_terms(spark.createDataFrame([(0, "lock order pool")], "ask int, query string")))
    assert sorted(r["word"] for r in I.resolved(index, terms, True).collect()) == ["lock", "locks", "order", "pool"]
    assert all(r["covers"] for r in I.resolved(index, terms, True).collect())
