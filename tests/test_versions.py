"""Tables of versions: what a change writes, what a killed one leaves, and random changes against a dictionary."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import versions as V

SCHEMA = "id long, word string, hits long"


def rows_of(frame):
    return {r["id"]: (r["word"], r["hits"]) for r in frame.collect()}


def test_random_changes_match_a_dictionary(spark, tmp_path):
    pick = random.Random(5)
    state = {i: (f"w{i}", i % 3) for i in range(40)}
    table = V.create(V.Table(spark, str(tmp_path / "t"), "id"), spark.createDataFrame([(k, *v) for k, v in state.items()], SCHEMA))
    past = {0: dict(state)}
    for step in range(8):
        ids = pick.sample(range(60), 9)
        asked = spark.createDataFrame([(i,) for i in ids + ids[:2]], "id long")
        if step % 4 == 0:
            number = V.upsert(table, spark.createDataFrame([(i, f"s{step}", 9) for i in ids], SCHEMA), keep=("hits",))
            state |= {i: (f"s{step}", state[i][1] if i in state else 9) for i in ids}
        elif step % 4 == 1:
            number = V.alter(table, asked, {"hits": F.col("hits") + 1})
            state |= {i: (state[i][0], state[i][1] + 1) for i in ids if i in state}
        elif step % 4 == 2:
            number = V.delete(table, asked)
            state = {k: v for k, v in state.items() if k not in ids}
        else:
            number = V.alter(table, asked, {"word": F.lit("same")})
            state |= {i: ("same", state[i][1]) for i in ids if i in state}
            V.compact(table)
        past[number] = dict(state)
    assert number == 8 and rows_of(V.read(table)) == state
    for version, then in past.items():
        assert rows_of(V.read(table, version)) == then
    assert V.vacuum(table) == [8] and rows_of(V.read(table)) == state


def test_a_change_writes_only_what_differs(spark, tmp_path):
    table = V.create(V.Table(spark, str(tmp_path / "t"), "id"), spark.range(1000).select("id", F.lit("w").alias("word"), F.lit(0).cast("long").alias("hits")))
    V.alter(table, spark.range(10, 13), {"word": F.when(F.col("id") == 11, "w").otherwise("x")})
    assert V.changes(table, 0, 1).count() == 2
    V.delete(table, spark.range(999, 1005))
    assert V.changes(table, 1, 2).count() == 1 and V.read(table).count() == 999
    V.commit(table, spark.createDataFrame([(None, "n", 1), (5, None, None)], SCHEMA))
    assert V.read(table).where("id is null").count() == 0 and rows_of(V.read(table).where("id = 5")) == {5: (None, None)}


def test_a_killed_change_leaves_the_version_before_it(spark, tmp_path):
    table = V.create(V.Table(spark, str(tmp_path / "t"), "id"), spark.createDataFrame([(1, "a", 0), (2, "b", 0)], SCHEMA))
    before = rows_of(V.read(table))

    def fails(batches):
        for batch in batches:
            if (batch["id"] == 2).any():
                raise RuntimeError("lost")
            yield batch

    with pytest.raises(Exception, match="lost"):
        V.commit(table, V.read(table).repartition(2, "id").mapInPandas(fails, SCHEMA))
    assert V.newest(table) == 0 and rows_of(V.read(table)) == before
    assert V.commit(table, spark.createDataFrame([(2, "c", 1)], SCHEMA)) == 1
    assert rows_of(V.read(table)) == {1: ("a", 0), 2: ("c", 1)}
    # a caller that repeats its numbered change changes nothing
    V.commit(table, spark.createDataFrame([(1, "late", 7)], SCHEMA), version=1)
    assert rows_of(V.read(table)) == {1: ("a", 0), 2: ("c", 1)}
    # a version without its mark doesn't count
    V.delete(table, spark.createDataFrame([(1,)], "id long"))
    assert rows_of(V.read(table)) == {2: ("c", 1)}
    (tmp_path / "t" / "delta" / "version=2" / "_SUCCESS").unlink()
    shutil.rmtree(tmp_path / "t" / "delta" / "version=2" / "x", ignore_errors=True)
    assert rows_of(V.read(table)) == {1: ("a", 0), 2: ("c", 1)}


def test_empty_table_and_empty_change(spark, tmp_path):
    table = V.create(V.Table(spark, str(tmp_path / "t"), "id"), spark.createDataFrame([], SCHEMA))
    V.delete(table, spark.range(3))
    V.upsert(table, spark.createDataFrame([], SCHEMA))
    assert V.read(table).count() == 0
    with pytest.raises(ValueError):
        V.read(V.Table(spark, str(tmp_path / "none"), "id"))
