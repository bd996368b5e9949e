"""Overlapping sets in blocks against all pairs, and what their shuffle carries."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import overlaps as O
from lorekeep.operators import search as R
from lorekeep.operators import state as S


@pytest.mark.parametrize("threshold", [0.3, 0.7, 1.0])
def test_like_all_pairs(spark, threshold, monkeypatch):
    """Sets of 1 to 90 terms, in several blocks and slices and small steps."""
    for name, value in (("BLOCK", 900), ("SLICE", 2000), ("TASKS", 3), ("CELLS", 500)):
        monkeypatch.setattr(O, name, value)
    rng = random.Random(4)
    sets = set()
    for i in range(160):
        base = rng.sample(range(120), rng.choice([1, 2, 3, 8, 25, 60, 90]))
        sets.add(frozenset(base))
        sets.add(frozenset([*rng.sample(base, (len(base) * 4 + 4) // 5), *rng.sample(range(1000), rng.randint(0, 5))]))
    sets = {i: s for i, s in enumerate(sorted(sets, key=sorted))}
    rows = spark.createDataFrame([(i, [f"t{x}" for x in s], len(s)) for i, s in sets.items()], "id long, _set array<string>, n int")
    want = {(i, j): round(c / m, 6) for i in sets for j in sets if i < j and (c := len(sets[i] & sets[j])) and c / (m := min(len(sets[i]), len(sets[j]))) >= threshold}
    got = R.set_pairs(rows, threshold).collect()
    assert len(got) == len(want) > 100 and {(r["a"], r["b"]): r["overlap"] for r in got} == want


def test_a_set_is_sent_once_a_block(spark):
    """Candidates by the thousand don't take their sets along: each joined them twice before."""
    rows = spark.range(400).select("id", F.concat(F.array(F.lit("shared")), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat_ws("-", k, F.col("id")))).alias("_set")).withColumn("n", F.size("_set"))
    plan = R.set_pairs(rows, 0.7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "array_intersect" not in plan
    assert R.set_pairs(rows, 0.7).count() == 0
    assert R.set_pairs(rows.limit(0), 0.7).count() == 0


def test_pairs_that_share_targets_come_once(spark):
    """Without a distinct over the pairs, also where several targets are shared."""
    rng = random.Random(2)
    rows = lambda n, m: sorted({(i, f"t{rng.randrange(m)}") for i in range(n) for _ in range(3)})
    many, few = rows(90, 9), rows(30, 12)
    left, right = spark.createDataFrame(many * 2, "a long, target string"), spark.createDataFrame(few * 2, "b long, target string")
    got = R.sharing(left, right, "a", "b", "target")
    assert sorted(map(tuple, got.collect())) == sorted({(a, b) for a, t in many for b, u in few if t == u})
    assert "Aggregate" not in "".join(got._jdf.queryExecution().optimizedPlan().toString().split("\n")[:2])  # none follows the join


def test_contradictions_need_no_distinct(spark):
    """Pairs that are stated as well, or share two entities, come once; an entity's rows are dealt out."""
    memory = spark.createDataFrame([(i, "active", "Never do that" if i % 3 == 0 else "Do that") for i in range(12)], "memory_id long, status string, body string")
    entities = spark.createDataFrame([(i, e) for i in range(12) for e in (["x", "y"] if i < 8 else ["y"])], "memory_id long, entity string")
    said = spark.createDataFrame([(0, 1), (1, 2), (1, 2), (11, 40)], "memory_id long, target long")
    got = S.all_contradictions(memory, entities, said)
    want = {(i, j) for i in range(12) for j in range(12) if (i % 3 == 0) != (j % 3 == 0)} | {(1, 2), (2, 1), (11, 40), (40, 11)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Aggregate" not in "".join(got._jdf.queryExecution().optimizedPlan().toString().split("\n")[:4])


def test_pairs_of_a_target_take_little_space(spark, monkeypatch):
    """A page of 20,000 pairs, as Parquet compresses them, repeats a chunk; it held all rows of the target before."""
    monkeypatch.setattr(R, "PARTS", 4)
    many = spark.range(400).select(F.col("id").alias("a"), F.lit("t").alias("target"))
    few = spark.range(19_000).select(F.concat(F.lit("p"), "id").alias("b"), F.lit("t").alias("target"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = R.sharing(many, few, "a", "b", "target").cache()
    assert got.count() == 400 * 19_000
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    page = got.withColumn("part", F.spark_partition_id()).withColumn("page", F.floor((F.monotonically_increasing_id() % (1 << 33)) / 20_000))
    assert page.groupBy("part", "page").agg(F.count_distinct("b").alias("n")).agg(F.max("n")).first()[0] <= 10 * R.CHUNK
    got.unpersist()


def test_pairs_leave_a_task_step_by_step(spark, monkeypatch):
    """A task held all pairs that it found, and each set went through a shuffle once a block, before."""
    monkeypatch.setattr(O, "CELLS", 500)
    rows = spark.range(300).select("id", F.concat(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.concat_ws("-", F.lit("t"), k)), F.array(F.concat_ws("-", F.lit("own"), F.col("id")))).alias("_set")).withColumn("n", F.size("_set"))
    blocks = O._packed(O.numbered(rows), 1, 1000).collect()
    assert sum(len(b["id"]) for b in blocks) == 300 * 8 and max(len(b["terms"]) for b in blocks) <= 4000
    sizes = [len(f) // 32 for small in blocks for large in blocks for f in O._meet(small, large, 0.7)]
    assert sum(sizes) == 300 * 299 // 2 and max(sizes) <= 500
    plan = O.overlapping(rows, 0.7)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
