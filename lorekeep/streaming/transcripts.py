"""Transcripts as a stream of files: redacted lines, windows of activity, and a table without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lorekeep.functions import text as T
from lorekeep.operators import versions as V
from lorekeep.operators.stages import settle

SCHEMA = "session string, at timestamp, role string, line string"


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines of a folder as they arrive, redacted before anything else sees them."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return raw.withColumn("line", T.redact("line"))


def activity(lines: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Lines and failures of each session and window; state older than the watermark is dropped."""
    own = lines.withWatermark("at", late).groupBy("session", F.window("at", window).alias("window"))
    return own.agg(F.count("*").alias("lines"), F.count_if(T.failure_line("line")).alias("failures"))


def distinct_lines(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each canonical line of a session once within the watermark."""
    return lines.withColumn("canonical", T.canonical("line")).withWatermark("at", late).dropDuplicatesWithinWatermark(["session", "canonical"])


def upsert_into(rows: DataFrame, path: str, key: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame], compact_every: int = 20) -> StreamingQuery:
    """Micro-batches merged into a table of versions (``operators.versions``): a batch writes the rows of its own keys.

    ``merge`` gets the rows that the table has of those keys and the new ones.  A version is
    numbered as its batch, so a batch that is run again after a failure changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        table = V.Table(batch.sparkSession, path, key)
        fresh = settle(batch.dropDuplicates([key]), "batch")
        if number == 0:
            V.create(table, fresh)
        else:
            V.commit(table, merge(V.touched(table, fresh), fresh), version=number)
        if (number + 1) % compact_every == 0:
            V.compact(table)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
