"""Multidimensional clustered layout: documents in files along a bit-interleaved key.

Four values of a document (source, lang, length in bytes, date) become coordinates
by their rank among all rows; the coordinates' digits are interleaved to ``z``, rows
are laid out by (z, doc_id), and a file takes a fixed number of neighbours.

What a query over the layout has to open is told from the files' boxes.  Each box is
exploded into the (source, lang) coordinate pairs that it covers; the distinct
queries are equi-joined there, and those pairs count whose length and date ranges
overlap.  Files that really hold a row inside a query come from an equi-join of the
cells of the files with the neighbour cells of the queries.

Scale: the rows are narrow and shuffled twice, by range of (z, doc_id) and by file.
A coordinate is told by at most 15 cut values a column, so that no row meets a table
of values.  There are at most 16^4 distinct queries; equal boxes are counted before
they are joined, files inside one cell are counted by cell, and the others share
their cells' borders, so that both joins stay within a constant size however many
rows there are.  What is broadcast is a row a partition and the results of at most
16^4 queries.

Edge cases: a null source or lang is the smallest value and has the coordinate 0; a
null text has the length -1, an empty one 0, and texts of any length only count by
their bytes; a null doc_id stands first among equal z and has the date of the empty
string; rows that repeat are laid out one after the other, ties of (z, doc_id) in
the order of their other values; an empty table gives no rows; other columns of
the documents are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, settle

BINS, FILE_ROWS, REACH, DAYS = 16, 500, 2, 365
#: The values, in the order of file_bounds, and the order in which a round of digits takes them.
VALUES = ("source", "lang", "length", "date")
ROUND = ("length", "source", "date", "lang")
#: Into so many parts the boxes of a (source, lang) pair are split where they meet the queries.
SALTS = 8


def values_of(docs: DataFrame) -> DataFrame:
    """doc_id and the four values of every row."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.octet_length(text), F.lit(-1)).cast("long").alias("length"), crc_mod("doc_id", DAYS).cast("long").alias("date"),
    )


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs, free of a double's rounding."""
    return F.call_function("div", a, b)


def _before(parts: DataFrame, part: str, size: str) -> DataFrame:
    """Of a row a partition: what lies in the partitions before it."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(part, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias("_before"))


def cut_values(rows: DataFrame, total: int, bins: int = BINS) -> dict[str, list[tuple[int, object]]]:
    """Per column the smallest value of each coordinate above 0: at most bins - 1 each.

    Distinct values are counted, range-sorted with their column's number, and
    summed in ranges from the totals of those before.
    """
    each = [F.struct(F.lit(k).alias("dim"), (F.col(c) if c in ("source", "lang") else F.lit(None).cast("string")).alias("s"), (F.lit(None).cast("long") if c in ("source", "lang") else F.col(c)).alias("n")) for k, c in enumerate(VALUES)]
    counts = rows.select(F.inline(F.array(*each))).groupBy("dim", "s", "n").agg(F.count("*").alias("rows"))
    order = ["dim", "s", "n"]
    parted = settle(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "values")
    starts = _before(parted.groupBy("_part").agg(F.sum("rows").alias("_size")), "_part", "_size")
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parted.withColumn("_own", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).join(F.broadcast(starts), "_part")
    smaller = F.col("_before") + F.col("_own") - F.col("dim") * F.lit(total)
    placed = summed.withColumn("at", _div(bins * smaller, F.lit(total)))
    first = placed.where("at > 0").groupBy("dim", "at").agg(F.min(F.struct("s", "n")).alias("v")).collect()
    out: dict[str, list[tuple[int, object]]] = {c: [] for c in VALUES}
    for row in sorted(first, key=lambda r: (r["dim"], r["at"])):
        out[VALUES[row["dim"]]].append((int(row["at"]), row["v"]["s"] if row["dim"] < 2 else row["v"]["n"]))
    return out


def coordinate(column: str, cuts: list[tuple[int, object]]) -> Column:
    """The coordinate of a value: that of the largest cut not above it; null is the smallest."""
    out = F.lit(0)
    for at, value in cuts:
        out = F.when(F.col(column) >= F.lit(value), at).otherwise(out)
    return out.cast("int")


def _bits(bins: int) -> int:
    return max(1, (bins - 1).bit_length())


def interleaved(coordinates: dict[str, Column], bins: int = BINS) -> Column:
    z = F.lit(0)
    for bit in reversed(range(_bits(bins))):
        for c in ROUND:
            z = z * 2 + F.shiftright(coordinates[c], bit).bitwiseAND(1)
    return z


def apart(z: Column, bins: int = BINS) -> dict[str, Column]:
    """The coordinates that make up z."""
    bits = _bits(bins)
    out = {}
    for k, c in enumerate(ROUND):
        own = F.lit(0)
        for bit in reversed(range(bits)):
            own = own * 2 + F.shiftright(z, bit * len(ROUND) + len(ROUND) - 1 - k).bitwiseAND(1)
        out[c] = own.cast("int")
    return out


def laid_out(docs: DataFrame, bins: int = BINS, file_rows: int = FILE_ROWS) -> DataFrame:
    """doc_id, z, position, file of every row; a settled table in the order of the layout."""
    rows = settle(values_of(docs), "layout-rows")
    cuts = cut_values(rows, rows.count(), bins)
    keyed = rows.withColumn("z", interleaved({c: coordinate(c, cuts[c]) for c in VALUES}, bins))
    order = ["z", "doc_id", *VALUES]
    # the id of a row holds its partition, from bit 33 on, and its place there
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "z", F.monotonically_increasing_id().alias("_at"))
    placed = settle(placed, "layout")
    part = F.shiftright("_at", 33)
    starts = _before(placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size")), "_part", "_size")
    own = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    position = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return own.select("doc_id", F.col("z").cast("long").alias("z"), position.alias("position"), _div(position, F.lit(file_rows)).alias("file"))


def file_boxes(held: DataFrame, bins: int = BINS) -> DataFrame:
    """Per file the smallest and largest coordinate of each value, from its cells (file, z)."""
    at = apart(F.col("z"), bins)
    cells = held.select("file", *[at[c].alias(c) for c in VALUES])
    return cells.groupBy("file").agg(*[f(c).alias(f"{c}_{n}") for c in VALUES for n, f in (("min", F.min), ("max", F.max))])


def touched_files(boxes: DataFrame, queries: DataFrame, reach: int = REACH) -> DataFrame:
    """z, files_touched: the files whose boxes meet the query around each cell."""
    ranges = [f"{c}_{n}" for c in ("length", "date") for n in ("min", "max")]
    bounds = [f"{c}_{n}" for c in ("source", "lang") for n in ("min", "max")]
    same = boxes.groupBy(*bounds, *ranges).agg(F.count("*").alias("files"))
    covered = same.select(F.explode(F.sequence("source_min", "source_max")).alias("source"), "lang_min", "lang_max", *ranges, "files")
    covered = covered.select("source", F.explode(F.sequence("lang_min", "lang_max")).alias("lang"), *ranges, "files")
    covered = covered.groupBy("source", "lang", *ranges).agg(F.sum("files").alias("files")).withColumn("salt", F.pmod(F.hash(*ranges), F.lit(SALTS)))
    asked = queries.select("z", "source", "lang", "length", "date", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    meets = [(F.col(c) - reach <= F.col(f"{c}_max")) & (F.col(c) + reach >= F.col(f"{c}_min")) for c in ("length", "date")]
    met = covered.alias("b").join(asked.alias("q"), reduce(Column.__and__, [F.col(f"b.{c}") == F.col(f"q.{c}") for c in ("source", "lang", "salt")] + meets))
    return met.groupBy("z").agg(F.sum("files").alias("files_touched"))


def matching_files(held: DataFrame, queries: DataFrame, reach: int = REACH, bins: int = BINS) -> DataFrame:
    """z, files_matching: the files that hold a row inside the query around each cell.

    Files inside one cell are counted by cell.  The others follow one another along
    z, so that with each new one a cell ends: they and their cells are no more than
    twice the cells.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    near = queries.select("z", "source", "lang", "date", F.explode(F.transform(steps, lambda i: F.col("length") + i)).alias("length"))
    near = near.select("z", "source", "lang", "length", F.explode(F.transform(steps, lambda i: F.col("date") + i)).alias("date"))
    near = near.where(F.col("length").between(0, bins - 1) & F.col("date").between(0, bins - 1))
    near = near.select(F.col("z").alias("asked"), interleaved({c: F.col(c) for c in VALUES}, bins).cast("long").alias("z"))
    cells = held.groupBy("file").agg(F.min("z").alias("z"), F.max("z").alias("_last"))
    lone = cells.where("z = _last").groupBy("z").agg(F.count("*").alias("files"))
    shared = held.join(cells.where("z < _last").select("file"), "file", "left_semi")
    some = near.join(lone, "z").groupBy("asked").agg(F.sum("files").alias("lone"))
    more = near.join(shared, "z").select("asked", "file").distinct().groupBy("asked").agg(F.count("*").alias("shared"))
    return some.join(more, "asked", "full").select(F.col("asked").alias("z"), (F.coalesce("lone", F.lit(0)) + F.coalesce("shared", F.lit(0))).alias("files_matching"))


def clustered(docs: DataFrame, bins: int = BINS, file_rows: int = FILE_ROWS, reach: int = REACH) -> DataFrame:
    """One row a document: its place in the layout, its file's box, and what its query opens and finds."""
    rows = laid_out(docs, bins, file_rows)
    held = settle(rows.groupBy("file", "z").agg(F.count("*").alias("rows")).select("file", "z"), "layout-cells")
    boxes = file_boxes(held, bins)
    at = apart(F.col("z"), bins)
    queries = settle(held.select("z").distinct().select("z", *[at[c].alias(c) for c in VALUES]), "layout-queries")
    told = queries.select("z").join(touched_files(boxes, queries, reach), "z").join(matching_files(held, queries, reach, bins), "z")
    bounds = F.concat_ws(",", *[F.col(f"{c}_{n}").cast("string") for c in VALUES for n in ("min", "max")]).alias("file_bounds")
    out = rows.join(boxes.select("file", bounds).hint("merge"), "file").join(F.broadcast(told), "z")  # at most bins^4 rows
    return out.select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")
