"""Retrieval: vectors, hybrid ranking, precedence of stores.  Keyword search is in ``index``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T

from .overlaps import overlapping
from .stages import settle

def with_precedence(hits: DataFrame, key: str = "memory_id", body: str = "body", store: str = "store") -> DataFrame:
    """Project hits, and those global hits whose id and body no project hit has."""
    project, other = hits.where(F.col(store) == "project"), hits.where(F.col(store) != "project")
    other = other.join(project.select(key).distinct(), key, "left_anti").join(project.select(body).distinct(), body, "left_anti")
    return project.unionByName(other.select(*project.columns))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)


def vector_scan(vectors: DataFrame, query: Sequence[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact scan: key and cosine; vectors of other dimensions are skipped."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.size(vector) == len(query)).withColumn("cosine", cosine(F.col(vector), q))


def hybrid(keyword: DataFrame, vectors: DataFrame, limit: int, key: str = "memory_id") -> DataFrame:
    """Keyword hits, raised by their cosine where they are among the nearest vectors."""
    near = vectors.orderBy(F.desc("cosine"), key).limit(max(limit, 20)).select(key, "cosine")
    out = keyword.join(near, key, "left").withColumn("hybrid", F.round(F.col("score") + F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0)) * 100, 6))
    return out.orderBy(F.desc("hybrid"), key).limit(limit)


def downweight_foreign(hits: DataFrame, device: str | None, weight: float, score: str = "score", origin: str = "origin_device") -> DataFrame:
    if device is None or not 0 <= weight < 1:
        return hits
    foreign = F.coalesce(F.col(origin), F.lit("")).isin("", device)
    return hits.withColumn(score, F.when(foreign, F.col(score).cast("double")).otherwise(F.col(score) * weight))


def ranked(rows: DataFrame, order: Sequence, column: str) -> DataFrame:
    """``rows`` with their number in the order, from 1.

    Ranges of the order are numbered on their own, each from the count of those
    before it, so that no task sees all rows.
    """
    own = settle(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = own.groupBy("_part").agg(F.count("*").alias("_size"))  # a row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = own.withColumn(column, F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(starts), "_part")
    return out.withColumn(column, F.col(column) + F.col("_before")).drop("_part", "_before")


def rerank_window(hits: DataFrame, window: int, order: Sequence, cosine_: str = "cosine") -> DataFrame:
    """The first ``window`` hits by cosine, the rest as they were: column ``position``."""
    own = ranked(hits, order, "position")
    near = own.where(F.col("position") <= window)
    near = near.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last(cosine_), "position")).cast("long"))
    return near.unionByName(own.where(F.col("position") > window))


def rerank_scored(hits: DataFrame, window: int, rank: str = "rank", score: str = "cosine") -> DataFrame:
    """Scored hits of the window exchange places among themselves; unscored ones stay put."""
    inside = (F.col(rank) <= window) & F.col(score).isNotNull()
    scored = hits.where(inside)
    seats = scored.select(F.col(rank).alias("position"), F.row_number().over(Window.orderBy(rank)).alias("_k"))
    order = scored.withColumn("_k", F.row_number().over(Window.orderBy(F.desc(score), rank)))
    moved = order.join(seats, "_k").drop("_k")
    return moved.unionByName(hits.where(~F.coalesce(inside, F.lit(False))).withColumn("position", F.col(rank)))


def near_duplicate_pairs(rows: DataFrame, key: str, body: str, threshold: float = 0.7) -> DataFrame:
    """Pairs a < b whose token sets overlap enough, over the rare terms of the smaller set.

    Equal sets are one class first, so copies aren't expanded.  Of a pair the smaller
    set must share ``threshold`` of its n terms, and so k of its rarest
    n - ceil(threshold * n) + k: only those meet the other sets' terms, and a term
    that many sets hold is rarely among them.
    """
    sets = rows.select(key, F.array_sort(T.token_set(body)).alias("_set")).where(F.size("_set") > 0)
    return set_pairs(settle(sets.groupBy("_set").agg(F.min(key).alias("id")).withColumn("n", F.size("_set")), "classes"), threshold)


def set_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """The same of classes (id, _set, n) with distinct sets, none empty."""
    share = F.col("common") / F.col("sn")
    return overlapping(classes, threshold).select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"), F.round(share, 6).alias("overlap"))


#: Parts into which the rows of one target are dealt, and rows of the other side that stand together.
PARTS, CHUNK = 64, 200


def sharing(many: DataFrame, few: DataFrame, a: str, b: str, target: str) -> DataFrame:
    """a, b: each pair with a target in common, once; ``many`` has a and target, ``few`` b and target.

    A pair is told at the smallest target that it shares, so that no pair is shuffled; the
    rows of a target are dealt to ``PARTS`` tasks, to which those of ``few`` go that are met at all.
    These go in chunks, and a chunk meets all rows of a task before the next: results grow with the
    square of a target's rows, and as runs of one row with the same chunk they are stored in little space.
    """
    met = few.join(many.select(target).distinct(), target, "left_semi")
    sets = lambda df, key, name: df.groupBy(key).agg(F.sort_array(F.collect_set(target)).alias(name))
    left = sets(many, a, "_x").select(a, "_x", F.explode("_x").alias("_t"), F.pmod(F.xxhash64(a), F.lit(PARTS)).cast("int").alias("_k"))
    right = sets(met, b, "_y").select(b, "_y", F.explode("_y").alias("_t"))
    chunks = right.groupBy("_t").agg(F.ceil(F.count("*") / CHUNK).alias("_n")).join(right, "_t").withColumn("_c", F.pmod(F.xxhash64(b), F.col("_n")))
    alone = F.size("_y") == 1
    chunks = chunks.groupBy("_t", "_c").agg(F.collect_list(F.when(alone, F.struct(b))).alias("_alone"), F.collect_list(F.when(~alone, F.struct(b, "_y"))).alias("_other"))  # about CHUNK rows
    chunks = chunks.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = lambda df: df.repartition(2 * PARTS, "_t", "_k")  # noqa: E731  (their sizes don't tell that of the result)
    once = lambda y: (F.size("_x") == 1) | (F.col("_t") == F.array_min(F.array_intersect("_x", y)))
    told = F.transform(F.filter("_other", lambda o: once(o["_y"])), lambda o: F.struct(o[b].alias(b)))
    return dealt(chunks).hint("merge").join(dealt(left), ["_t", "_k"]).select(a, F.inline(F.concat("_alone", told)))
