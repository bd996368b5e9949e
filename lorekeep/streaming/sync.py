"""Memories of peers as a stream of operations, each peer's newest version of a memory held in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.operators import state as S

SCHEMA = "peer string, memory_id long, kind string, version string, at long"


def read_ops(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Operations in Parquet files of a folder as they arrive: peer, memory_id, kind, version, at (the peer's own count)."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _advance(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else None
    top = held
    for chunk in chunks:  # of a few rows each, for which a sort of pandas costs most of the time
        own = max(zip(*[chunk[c].tolist() for c in ("at", "version", "kind")]))
        top = own if top is None or own > top else top
    if top != held:
        state.update(top)
    moved = held is None or top[1:] != held[1:]
    if moved:
        yield pd.DataFrame([(*key, top[2], top[1], top[0], held is None)], columns=["peer", "memory_id", "kind", "version", "at", "first"])


def advance(ops: DataFrame) -> DataFrame:
    """The operations that move a peer's cursor: peer, memory_id, kind, version, at, first.

    Of a memory's operations in a micro-batch the one with the largest (at, version, kind)
    counts, if it is newer than the one held and tells of another version or kind.  Repeated
    and late operations move nothing, so files may be replayed and come in any order: the
    last row of a memory has the version and kind of its newest operation.  The state is a
    row for each peer and memory and is never dropped, since a forgotten version would be
    taken in again.  Rows with a null among their columns are left out.
    """
    whole = ops.dropna(subset=["peer", "memory_id", "kind", "version", "at"])
    out = SCHEMA + ", first boolean"
    moved = whole.groupBy("peer", "memory_id").applyInPandasWithState(_advance, out, "at long, version string, kind string", "append", GroupStateTimeout.NoTimeout)
    # the operator hands on columnar rows, which a shuffle can't take: a projection copies them
    return moved.withColumn("first", F.coalesce("first", F.lit(False)))


def routed(moves: DataFrame, memory: DataFrame) -> DataFrame:
    """``moves`` with ``route`` by the own memory's version: flag, skip, same, conflict or candidate.  Works on streams and tables."""
    own = memory.select("memory_id", F.col("version").alias("_own"))
    return moves.join(own, "memory_id", "left").select(*moves.columns, S.route_of(F.col("kind"), F.col("version"), F.col("_own")).alias("route"))


def run(ops: DataFrame, memory: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Route what has arrived into Parquet files of ``out``, each move once."""
    sink = routed(advance(ops), memory).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return sink.outputMode("append").trigger(availableNow=True).start()


def newest(moves: DataFrame) -> DataFrame:
    """Each peer's last move of each memory: what the same operations give in one batch, however they came."""
    rest = [c for c in moves.columns if c not in ("peer", "memory_id", "first")]
    last = moves.groupBy("peer", "memory_id").agg(F.max_by(F.struct(*rest), F.struct("at", "version")).alias("_row"))
    return last.select("peer", "memory_id", *[f"_row.{c}" for c in rest])
