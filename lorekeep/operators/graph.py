"""Graph traversal and analytics over node and edge tables.

Edges are rows (src, dst, kind, ...).  Traversals keep a frontier; each hop is a
join with the edges and an anti-join with what is known, written to the shared
folder, and the loop ends at the depth bound or at an empty frontier.

``adjacency`` and ``callers`` store what traversals walk on, once for many of them: in
ranges of the node that a hop starts from, sorted, so that a node with a third of all
edges fills several files.  A small frontier is told to the scan, which then skips
row groups, and is broadcast by Spark's own check of its size; no edge is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import settle


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst of both directions, as often as the edges tell them."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def undirected(edges: DataFrame) -> DataFrame:
    return both_ways(edges).distinct()


#: Up to so many nodes of a frontier are told to the scan by name.
NAMED = 1000


def stored(edges: DataFrame, by: str, *then: str) -> DataFrame:
    """The edges as a table in ranges of ``by``, sorted, equal rows once.

    One shuffle does it: equal rows are in one range, so that they are told apart
    where they are sorted.
    """
    order = [by, *then]
    return settle(edges.repartitionByRange(*order).distinct().sortWithinPartitions(*order), "edges")


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst of both directions, stored by src; edges may be repeated."""
    return stored(both_ways(edges), "src", "dst")


def callers(edges: DataFrame) -> DataFrame:
    """to_node, from_node, heuristic of calls and uses, stored by to_node; edges may be repeated."""
    own = edges.where(F.col("kind").isin("calls", "uses")).select(F.col("dst").alias("to_node"), F.col("src").alias("from_node"), "heuristic")
    return stored(own, "to_node", "from_node")


def _from(front: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """The edges that begin at the frontier, with its columns."""
    named = [r[0] for r in front.select("node").limit(NAMED + 1).collect()]
    some = edges.where(F.col(by).isin(named)) if len(named) <= NAMED else edges
    return front.join(some, front["node"] == some[by])


def hops(edges: DataFrame, starts: DataFrame, depth: int, node: str = "node") -> DataFrame:
    """node, hops: the least number of edges from the starts, up to ``depth``, starts included."""
    known = settle(starts.select(F.col(node).alias("node")).distinct().withColumn("hops", F.lit(0)), "hops")
    front = known
    for hop in range(1, depth + 1):
        step = _from(front, edges, "src").select(F.col("dst").alias("node")).distinct()
        front = settle(step.join(known, "node", "left_anti").withColumn("hops", F.lit(hop)), "hops")
        if front.isEmpty():
            break
        known = known.unionAll(front)
    return known


def neighbours(both: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` hops over an ``adjacency``, without the starts."""
    return hops(both, starts, depth).where("hops > 0")


def shortest_path(both: DataFrame, source: str, target: str, bound: int = 6) -> list[str]:
    """One shortest path over an ``adjacency`` (of equals that with the smallest nodes), or an empty list.

    A level is a table of nodes with their smallest predecessor; only the path
    itself comes to the driver.
    """
    spark = both.sparkSession
    known = spark.createDataFrame([(source, None, 0)], "node string, parent string, hops int")
    front = known
    for hop in range(1, bound + 1):
        if source == target:
            break
        step = _from(front, both, "src").groupBy("dst").agg(F.min("node").alias("parent"))
        front = settle(step.select(F.col("dst").alias("node"), "parent", F.lit(hop).alias("hops")).join(known, "node", "left_anti"), "path")
        if front.isEmpty():
            return []
        known = known.unionAll(front)
        if not front.where(F.col("node") == target).isEmpty():
            break
    path, at = [target], known.where(F.col("node") == target).first()
    if at is None:
        return []
    while at["parent"] is not None:
        path.append(at["parent"])
        at = known.where(F.col("node") == at["parent"]).first()
    return path[::-1]


def dependents(own: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """node, hops, via_heuristic: who depends on the seeds, over stored ``callers``.

    Of several paths of the same length one without heuristic edges counts.
    """
    known = settle(seeds.select("node").distinct().withColumn("hops", F.lit(0)).withColumn("via_heuristic", F.lit(False)), "dependents")
    front = known
    for hop in range(1, depth + 1):
        step = _from(front, own, "to_node").groupBy("from_node").agg(F.min(F.col("via_heuristic") | F.col("heuristic")).alias("via_heuristic"))
        step = step.select(F.col("from_node").alias("node"), F.lit(hop).alias("hops"), "via_heuristic").join(known, "node", "left_anti")
        front = settle(step, "dependents")
        if front.isEmpty():
            break
        known = known.unionAll(front)
    return known


def impact(reach: DataFrame, limit: int = 20) -> DataFrame:
    """The nearest dependents with their tier."""
    tier = F.when(F.col("hops") == 1, "High").when(F.col("hops") == 2, "Medium").otherwise("Low")
    return reach.where("hops > 0").withColumn("tier", tier).orderBy("hops", "node").limit(limit)


def affected_memories(reach: DataFrame, anchors: DataFrame) -> DataFrame:
    """memory_id, strength, hops of memories anchored to reached nodes."""
    return reach.join(anchors, "node").groupBy("memory_id").agg(F.max("strength").alias("strength"), F.min("hops").alias("hops"))


def stale_items(affected: DataFrame, fresh: DataFrame, queued: DataFrame, least: float = 0.6) -> DataFrame:
    """Review items of the affected memories that are strong enough and not flagged yet (those in ``fresh``).

    id, memory_id, summary, category, confidence, action, evidence, and enqueued: false
    where the queue has the item already.
    """
    name = F.col("memory_id").cast("string")
    risk = F.when(F.col("hops") == 0, "Direct").when(F.col("hops") == 1, "High").when(F.col("hops") == 2, "Medium").otherwise("Low")
    text = F.concat(F.lit("Review possibly-stale memory "), name, F.lit(": code it was anchored to changed (risk "), risk, F.lit(")."))
    own = affected.where(F.col("strength") >= least).join(fresh.select("memory_id").distinct(), "memory_id", "left_semi").select(
        F.concat(F.lit("stale-"), name).alias("id"), "memory_id", text.alias("summary"), F.lit("Process").alias("category"), F.col("strength").alias("confidence"),
        F.lit("KeepForSession").alias("action"), F.concat(F.lit("change-impact on "), name).alias("evidence"),
    )
    there = queued.select("id", F.lit(True).alias("_there")).distinct()
    return own.join(there, "id", "left").select(*own.columns, F.col("_there").isNull().alias("enqueued"))


def overview(nodes: DataFrame, edges: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Hotspots (most distinct callers) and entry points (no callers, most callees)."""
    calls = edges.where("kind = 'calls'").select("src", "dst").distinct()
    into = calls.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    out = calls.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    own = nodes.join(into, "node", "left").join(out, "node", "left").fillna(0, ["in_degree", "out_degree"])
    hot = own.where("kind in ('function', 'type') and in_degree > 0").orderBy(F.desc("in_degree"), "node").limit(top)
    entry = own.where("kind = 'function' and in_degree = 0 and out_degree > 0").orderBy(F.desc("out_degree"), "node").limit(top)
    return hot, entry


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls (file, caller, callee) to functions (file, node, name): same file first, else the only one anywhere."""
    same = functions.groupBy("file", F.col("name").alias("callee")).agg(F.count("*").alias("here"), F.min("node").alias("local"))
    anywhere = functions.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("total"), F.min("node").alias("only"))
    out = calls.join(same, ["file", "callee"], "left").join(anywhere, "callee", "left")
    local = F.col("here") == 1
    target = F.when(local, F.col("local")).when(F.col("total") == 1, F.col("only"))
    out = out.select(F.col("caller").alias("src"), target.alias("dst"), F.when(local, 0.9).otherwise(0.6).alias("confidence"))
    return out.where("dst is not null and src <> dst").distinct()


def last_write(edges: DataFrame, key: str, order: str) -> DataFrame:
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
