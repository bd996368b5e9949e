"""Changes written as versions of a table (M1, M4, M5, M8, M9), and operations of peers as a stream (M25, M26)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import versions as V
from lorekeep.operators.stages import new_folder, settle
from lorekeep.streaming import sync

from . import bindings as B

QUERIES, ORACLES = {}, {}

COLUMNS = ("memory_id", "category", "status", "stale", "contradicted", "hit_count", "created_at", "body")
_TABLES: dict[tuple[str, str], V.Table] = {}


def _ids(frame: DataFrame, column: str) -> DataFrame:
    return frame.select(F.col(column).alias("memory_id"))


def _upserted(table: V.Table, sf: str) -> None:
    fresh = V.read(table, 0).where("memory_id % 9 = 4").withColumns({"memory_id": F.col("memory_id") + 500, "hit_count": F.lit(0).cast("long"), "stale": F.lit(False)})
    V.upsert(table, fresh, keep=("created_at", "hit_count", "contradicted"), version=1)


def _superseded(table: V.Table, sf: str) -> None:
    V.alter(table, _ids(B.read(table.spark, sf, "labels").where("quality = 0"), "doc_id"), {"status": F.lit("superseded")}, version=2)


def _bumped(table: V.Table, sf: str) -> None:
    more = F.col("hit_count") + F.when(F.col("status") == "active", 1).otherwise(0)
    V.alter(table, _ids(B.read(table.spark, sf, "events"), "user_id"), {"hit_count": more}, version=3)


def _flagged(table: V.Table, sf: str) -> None:
    V.alter(table, _ids(V.read(table).where("hit_count = 0 and status = 'active'"), "memory_id"), {"stale": F.lit(True)}, version=4)


def _deleted(table: V.Table, sf: str) -> None:
    V.delete(table, _ids(B.read(table.spark, sf, "labels").where("toxic = 1"), "doc_id"), version=5)


CHANGES = (_upserted, _superseded, _bumped, _flagged, _deleted)


def _table(spark: SparkSession, sf: str, until: int = len(CHANGES)) -> V.Table:
    """The memories (version 0) and the changes up to a version, each made at its first use in a session."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _TABLES:
        _TABLES[at] = V.create(V.Table(spark, new_folder(spark, "memories"), "memory_id"), B.memory(spark, sf).select(*COLUMNS))
    table = _TABLES[at]
    for change in CHANGES[V.newest(table) : until]:
        change(table, sf)
    return table


_KEPT = "memory_id, category, status, stale, contradicted, hit_count, created_at"
_STEPS = f"""WITH {B.MEMORY}, v0 AS (SELECT {_KEPT}, body FROM memory),
  n AS (SELECT memory_id + 500 AS memory_id, category, status, contradicted, created_at, body FROM memory WHERE memory_id % 9 = 4),
  v1 AS (SELECT coalesce(n.memory_id, o.memory_id) AS memory_id, CASE WHEN n.memory_id IS NULL THEN o.category ELSE n.category END AS category,
    CASE WHEN n.memory_id IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN n.memory_id IS NULL THEN o.stale ELSE false END AS stale,
    CASE WHEN o.memory_id IS NULL THEN n.contradicted ELSE o.contradicted END AS contradicted, coalesce(o.hit_count, 0) AS hit_count,
    CASE WHEN o.memory_id IS NULL THEN n.created_at ELSE o.created_at END AS created_at, CASE WHEN n.memory_id IS NULL THEN o.body ELSE n.body END AS body
    FROM v0 o FULL JOIN n ON o.memory_id = n.memory_id),
  v2 AS (SELECT * REPLACE (CASE WHEN memory_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'superseded' ELSE status END AS status) FROM v1),
  v3 AS (SELECT * REPLACE (hit_count + CASE WHEN status = 'active' AND memory_id IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) THEN 1 ELSE 0 END AS hit_count) FROM v2),
  v4 AS (SELECT * REPLACE (stale OR (hit_count = 0 AND status = 'active') AS stale) FROM v3),
  v5 AS (SELECT * FROM v4 WHERE memory_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def _version(number: int):
    return lambda spark, sf: V.read(_table(spark, sf, number), number).drop("body").withColumn("hit_count", F.col("hit_count").cast("long"))


for _number, _name in enumerate(("M1_upsert_version", "M4_supersede_version", "M8_bump_version", "M9_flag_version", "M5_delete_version"), 1):
    QUERIES[_name] = _version(_number)
    ORACLES[_name] = f"{_STEPS} SELECT {_KEPT.replace('hit_count', 'CAST(hit_count AS BIGINT) AS hit_count')} FROM v{_number}"


def _written(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows each version wrote: those that it changed, and no others."""
    return V.changes(_table(spark, sf), 0, 5).groupBy(F.col("version").cast("long").alias("version")).agg(F.count("*").alias("n_rows"), F.sum(F.char_length("body")).alias("chars"))


QUERIES["M1_rows_written"] = _written
ORACLES["M1_rows_written"] = f"""{_STEPS},
  w AS (SELECT 1 AS version, length(v1.body) AS chars FROM v1 JOIN n USING (memory_id)
    UNION ALL SELECT 2, length(b.body) FROM v1 a JOIN v2 b USING (memory_id) WHERE a.status <> b.status
    UNION ALL SELECT 3, length(b.body) FROM v2 a JOIN v3 b USING (memory_id) WHERE a.hit_count <> b.hit_count
    UNION ALL SELECT 4, length(b.body) FROM v3 a JOIN v4 b USING (memory_id) WHERE a.stale <> b.stale
    UNION ALL SELECT 5, NULL FROM v4 WHERE memory_id NOT IN (SELECT memory_id FROM v5))
  SELECT CAST(version AS BIGINT) AS version, count(*) AS n_rows, CAST(sum(chars) AS BIGINT) AS chars FROM w GROUP BY version"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """memory_id, kept, category, marked: the versions of each memory by its text, its category, and its text with a mark more; texts are read once."""
    version = lambda x: F.substring(F.sha2(x.cast("binary"), 256), 1, 16)
    own = B.texts(spark, sf).select("memory_id", version(F.col("body")).alias("kept"), version(F.col("category")).alias("category"), version(F.concat("body", F.lit("!"))).alias("marked"))
    return settle(own.hint("rebalance"), "versions")


def _ops(versions: DataFrame) -> DataFrame:
    """Three operations for each memory of two peers: versions by its text, its category, and its text again or with a mark more."""
    peer = F.concat(F.lit("peer"), (F.col("memory_id") % 2).cast("string"))
    kind = F.when((F.col("memory_id") % 5 == 0) & (F.col("n") == 2), "supersede").otherwise("update")
    version = F.when(F.col("n") == 0, F.col("kept")).when(F.col("n") == 1, F.col("category")).when(F.col("memory_id") % 3 == 0, F.col("kept")).otherwise(F.col("marked"))
    named = versions.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
    return named.select(peer.alias("peer"), "memory_id", kind.alias("kind"), version.alias("version"), (F.col("memory_id") * 10 + F.col("n")).alias("at"), "n")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The operations in files, the newest of half of the memories first and all of them twice, routed as a stream.

    Each micro-batch meets the memories' versions, not their texts, and the files are of a
    size that Spark picks, so that micro-batches are as many as the operations need.
    """
    inbox, root = new_folder(spark, "inbox"), new_folder(spark, "moves")
    versions = _versions(spark, sf)
    ops = _ops(versions)
    early = (F.col("memory_id") % 4 < 2) & (F.col("n") == 2)
    for part in (ops.where(early), ops.where(~early), ops):
        part.drop("n").write.mode("append").parquet(inbox)
    own = versions.where("memory_id % 7 <> 3").select("memory_id", F.col("kept").alias("version"))
    sync.run(sync.read_ops(spark, inbox, 8), own, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return sync.newest(spark.read.parquet(f"{root}/out")).select("peer", "memory_id", "version", "route")


QUERIES["M26_stream_routes"] = _stream
ORACLES["M26_stream_routes"] = f"""WITH {B.MEMORY}, v AS (SELECT memory_id, substr(sha256(body), 1, 16) AS own, substr(sha256(CASE WHEN memory_id % 3 = 0 THEN body ELSE body || '!' END), 1, 16) AS version FROM memory WHERE body IS NOT NULL)
  SELECT 'peer' || (memory_id % 2) AS peer, memory_id, version, CASE WHEN memory_id % 5 = 0 THEN CASE WHEN memory_id % 7 <> 3 THEN 'flag' ELSE 'skip' END
    WHEN memory_id % 7 = 3 THEN 'candidate' WHEN own = version THEN 'same' ELSE 'conflict' END AS route FROM v"""
