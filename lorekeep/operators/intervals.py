"""Joins of ranges within a path, in work proportional to the input and the output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import settle

#: Positions are below 2 to this power.
LEVELS = 40


def meeting(items: DataFrame, spans: DataFrame, start: str = "line_start", end: str = "line_end", path: str = "path") -> DataFrame:
    """Items whose closed range meets a span of the same path, each row once.

    A sweep: an item meets a span if and only if the largest end of the spans that begin
    no later than the item ends is not before its start.  That maximum runs in ranges of
    (path, position), each from those before it, so that one path may fill many tasks.
    Null bounds or paths meet nothing; a range whose end is before its start is taken as it
    stands.
    """
    of_spans = spans.where(F.col(path).isNotNull()).select(F.col(path).alias("_path"), F.col(start).cast("long").alias("_pos"), F.lit(0).alias("_k"), F.col(end).cast("long").alias("_end"), F.lit(None).cast(items.select(F.struct("*")).schema[0].dataType).alias("_item"))
    of_items = items.where(F.col(path).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(path).alias("_path"), F.col(end).cast("long").alias("_pos"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("_end"), F.struct(*items.columns).alias("_item"))
    order = ["_path", "_pos", "_k"]
    both = of_spans.where("_pos is not null and _end is not null").unionByName(of_items)
    parted = settle(both.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sweep")
    earlier = Window.partitionBy("_path").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parted.groupBy("_path", "_part").agg(F.max("_end").alias("_most"))  # a row for each path and range that hold one another
    carried = carried.withColumn("_before", F.max("_most").over(earlier)).where("_before is not null").select("_path", "_part", "_before")
    running = Window.partitionBy("_part", "_path").orderBy("_pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    swept = parted.withColumn("_reach", F.max("_end").over(running)).where("_k = 1").join(carried, ["_path", "_part"], "left")
    reach = F.greatest("_reach", "_before")  # nulls are passed over
    return swept.where(reach >= F.col(f"_item.{start}")).select("_item.*")


def _pieces(start: Column, end: Column) -> Column:
    """The aligned blocks (level, block) that make up [start, end): two a level at most."""
    empty = F.array().cast("array<struct<level:int,block:bigint>>")
    piece = lambda k, x: F.array(F.struct(k.cast("int").alias("level"), x.alias("block")))

    def step(s: Column, k: Column) -> Column:
        l, r, out = s["l"], s["r"], s["out"]
        left = (l < r) & (l % 2 == 1)
        l2 = F.when(left, l + 1).otherwise(l)
        right = (l2 < r) & (r % 2 == 1)
        more = F.concat(out, F.when(left, piece(k, l)).otherwise(empty), F.when(right, piece(k, r - 1)).otherwise(empty))
        half = lambda x: F.floor(x / 2).cast("long")
        return F.struct(half(l2).alias("l"), half(F.when(right, r - 1).otherwise(r)).alias("r"), more.alias("out"))

    begin = F.struct(start.cast("long").alias("l"), end.cast("long").alias("r"), empty.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), begin, step, lambda s: s["out"])


def innermost(points: DataFrame, items: DataFrame, at: str = "at", start: str = "byte_start", end: str = "byte_end", item: str = "item", path: str = "path") -> DataFrame:
    """path, at, item: of the half-open ranges around each point the one that begins last, of equals the largest item.

    A range is the union of aligned blocks, and a point lies in one block of each size;
    so they meet by path, size and block: a path with most of the ranges is dealt by
    block.  Points without a range around them have no row.
    """
    blocks = items.where(F.col(start) >= 0).select(F.col(path).alias("_path"), F.struct(start, item).alias("_range"), F.explode(_pieces(F.col(start), F.col(end))).alias("_b"))
    blocks = blocks.select("_path", "_b.level", "_b.block", "_range").groupBy("_path", "level", "block").agg(F.max("_range").alias("_range"))  # of ranges that hold the same block only the last to begin counts
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    asked = points.where(F.col(at) >= 0).select(F.col(path).alias("_path"), F.col(at).cast("long").alias("_at")).distinct()
    used = [r[0] for r in blocks.select("level").distinct().collect()]  # LEVELS at most
    asked = asked.select("_path", "_at", F.explode(F.filter(levels, lambda k: k.isin(*used))).alias("level")).withColumn("block", F.expr("shiftright(_at, level)"))
    met = asked.join(blocks, ["_path", "level", "block"]).groupBy("_path", "_at").agg(F.max("_range").alias("_range"))
    return met.select(F.col("_path").alias(path), F.col("_at").alias(at), F.col(f"_range.{item}").alias(item))
