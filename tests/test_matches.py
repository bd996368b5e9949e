"""The nearest texts of many queries, told in groups and blocks, are those of all passages of all hits."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import index as I
from lorekeep.operators import matches as X
from lorekeep.operators import passages as P

WORDS = ["lock", "locks", "order", "café", "config.toml", "pool", "error", "the", "retry", "Straße", "zz", "timeouts"]
QUERIES = ["locks order pool", "config.toml retry", "lock the timeout café", "orde", "pool, retry: config.toml error", "café"]


def plain(index, asked, rows):
    """The best of all hits, by their passages."""
    names = ["memory_id", "store"]
    hits = P.in_order(I.search(index, asked, rows).join(rows.select(*names), names, "left_semi"), rows, names)
    shown = P.passages(index, asked, hits, rows).join(asked, "ask")
    shown = shown.withColumn("overlap", T.overlap(T.token_set("query"), T.token_set(F.coalesce("snippet", F.lit("")))))
    best = shown.groupBy("ask").agg(F.max(F.struct("overlap", (-F.col("rank")).alias("r"), *names)).alias("b"))
    return sorted((r["ask"], r["b"]["memory_id"], r["b"]["store"], round(r["b"]["overlap"], 9)) for r in best.collect())


@pytest.mark.parametrize("size,block", [(8_000_000, 8192), (3000, 2)])
def test_nearest_texts_in_groups_and_blocks(spark, monkeypatch, size, block):
    monkeypatch.setattr(X, "GROUP_CHARS", size)
    monkeypatch.setattr(X, "BLOCK", block)
    pick = random.Random(5)
    cut = lambda: "".join(pick.choice(WORDS) + pick.choice([" ", " ", ". ", ": ", ", "]) for _ in range(pick.choice([3, 20, 40, 120])))
    # ids that both stores have, with texts of their own and with copies
    data = [(i % 50, "project" if i < 50 else "global", cut()) for i in range(100)]
    data += [(200 + i, "global", data[i][2]) for i in range(10)] + [(300, "project", None), (301, "global", "")]
    rows = spark.createDataFrame(data, "memory_id long, store string, body string")
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "ask int, query string")
    index = I.build(rows)
    got = P.accepted_matches(index, asked, rows).collect()
    assert sorted((r["ask"], r["memory_id"], r["store"], round(r["overlap"], 9)) for r in got) == plain(index, asked, rows)
    assert len(got) == len(QUERIES)


def test_a_place_of_a_token_is_no_row(spark):
    """Of a token of several texts one row is stored; each place is read as one."""
    index = I.build(spark.createDataFrame([(i, "project", "locks hold locks") for i in range(40)], "memory_id long, store string, body string").coalesce(1))
    assert index.stored("postings").where("term = 'locks'").count() == 1
    assert index.table("postings").where("term = 'locks'").count() == 80
