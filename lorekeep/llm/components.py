"""Connected components by alternating large-star and small-star contraction.

Everything stays in DataFrames: each round is two ``groupBy(min)`` passes, which
combine on the map side, and two joins whose skewed keys AQE can split.  The
edge list is written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over rows (u, v), u > v; returns rows of the same form."""
    if large:
        sides = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = sides.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(low.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge.

    Self-links and null ends are ignored.  An empty edge list gives no rows.
    The rounds end when a round changes no edge.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    now = settle(now, "edges")
    state = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == state:
            break
        state = mark
        now = settle(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v"), F.col("v")).distinct())
