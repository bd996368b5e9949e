"""The inverted index against SQLite's FTS5: plain terms, prefixes, phrases, stores, many queries at once."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import index as I

WORDS = ["lock", "locks", "locked", "blocks", "order", "orders", "config", "toml", "yaml", "café", "cafe", "foo", "bar", "a1", "v2", "the", "operator", "safe", "Safety", "é", "naïve"]
QUERIES = [
    "locks", "lock order", "deadlock locks order", "the of", "", "operator-safe", "config.toml", "foo_bar", "config.toml order locks", "cafe", "café order", "x-ray foo bar a1",
    "lock lock order", "(safe), order; v2", "foo.bar.a1", "foo-bar-", "foo.foo", "a1 v2", "no such words here",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "_", "-", ", ", ": "]) for _ in range(rng.randint(0, 30))), rng.choice(["project", "project", "global"])) for i in range(300)]
    out += [(300, None, "project"), (301, "", "global"), (302, "config.toml " * 300, "project"), (303, "foo foo foo.foo", "global"), (5, "config toml locks", "project" if out[5][2] == "global" else "global")]
    return [(i, None if b is None else b.replace("-", "- ") if i % 3 else b, s) for i, b, s in out]


@pytest.fixture(scope="module")
def index(spark, rows):
    return I.build(table(spark, rows))


def table(spark, rows):
    return spark.createDataFrame(rows, "memory_id long, body string, store string").withColumn("len", F.lit(1)).repartition(3)


def sqlite_hits(rows, query):
    """memory_id, store -> score, each store searched alone."""
    terms = T.significant_terms(query)
    out = {}
    for store in ("project", "global"):
        con = sqlite3.connect(":memory:")
        con.execute("create virtual table f using fts5(body)")
        own = [(i, b or "") for i, b, s in rows if s == store]
        con.executemany("insert into f(rowid, body) values (?, ?)", own)
        if terms:
            match = " OR ".join(f'"{t}"*' if len(t) >= 4 else f'"{t}"' for t in terms)
            for i, score, body in con.execute("select rowid, bm25(f), body from f where f match ?", (match,)):
                low = "".join(c.lower() if c.isascii() else c for c in body)
                if len(terms) < 3 or sum("".join(c.lower() if c.isascii() else c for c in t) in low for t in terms) >= 2:
                    out[i, store] = round(-score, 6)
    return out


@pytest.mark.parametrize("query", QUERIES)
def test_like_sqlite(spark, rows, index, query):
    got = {(r["memory_id"], r["store"]): r["rank_score"] for r in I.search_one(index, query, table(spark, rows)).collect()}
    assert got == pytest.approx(sqlite_hits(rows, query), abs=2e-6)


@pytest.mark.parametrize("few", [0, 64])
def test_many_queries_at_once(spark, rows, index, few, monkeypatch):
    monkeypatch.setattr(I, "FEW", few)
    monkeypatch.setattr(I, "NAMED_TERMS", few * 10)
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "ask int, query string")
    got = {(r["ask"], r["memory_id"], r["store"]): r["rank_score"] for r in I.search(index, asked, table(spark, rows)).collect()}
    want = {(k, *m): v for k, q in enumerate(QUERIES) for m, v in sqlite_hits(rows, q).items()}
    assert got == pytest.approx(want, abs=2e-6)
    top = I.search(index, asked, table(spark, rows), most=3).collect()
    for k in range(len(QUERIES)):
        best = sorted(((-v, i, s) for (a, i, s), v in got.items() if a == k))[:3]
        assert [(r["memory_id"], r["store"]) for r in sorted((r for r in top if r["ask"] == k), key=lambda r: r["rank"])] == [(i, s) for _, i, s in best]


def test_terms_on_driver_and_in_columns(spark):
    got = spark.createDataFrame([(q,) for q in QUERIES], "q string").select("q", T.significant("q").alias("t")).collect()
    assert {r["q"]: r["t"] for r in got} == {q: T.significant_terms(q) for q in QUERIES}


def test_a_search_opens_only_the_folders_of_its_terms(spark, index):
    terms = I._terms(I.query_terms(spark.createDataFrame([(0, "toml")], "ask int, query string")))
    plan = I.term_rows(index, terms)._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any(re.search(r"head#\d+ = to\b", f) for f in filters)
    opened = index.table("postings").where("head in ('to')").select(F.input_file_name().alias("f")).distinct().collect()
    assert opened and all("/head=to/" in r["f"] for r in opened)


def test_empty_index(spark):
    index = I.build(table(spark, []))
    assert I.search_one(index, "locks order config.toml", table(spark, [])).count() == 0


def test_an_index_of_another_session(spark, rows, index):
    again = I.opened(spark, index.path)
    key = lambda i: sorted(map(tuple, I.search_one(i, "config.toml", table(spark, rows)).collect()))
    assert key(again) == key(index) != []
