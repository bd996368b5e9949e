"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local, one temporary folder is made
    for the session and used for checkpoints as well; a cluster without it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not own:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lorekeep-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The table survives the loss of executors and is not computed again by a
    range partitioner's sampling pass or by a second consumer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorekeep-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, mod: int):
    """crc32 of an id written as text, modulo ``mod`` (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` with its memory handed back to the system when a task's rows end.

    Python workers outlive their tasks; what one stage used would otherwise stay
    with them beside the next stage's.
    """

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def sampled(docs: DataFrame, chosen: DataFrame, group: list[str], max_bytes: int) -> DataFrame:
    """Rows (doc_id, *group, text) of the chosen documents, one for each id.

    ``chosen`` (doc_id, *group, _h) has a bounded number of rows, and no id twice
    in a group; of rows that repeat an id the smallest text counts.  In the order of
    ``_h`` every text is taken that fits into what is left of its group's ``max_bytes``;
    longer ones are passed over and take nothing from the others.  Of a group in
    which no text fits the shortest one gives its beginning.
    """
    keys = ["doc_id", *group]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in group if c in docs.columns])
    on = [c for c in keys if c in texts.columns]
    rows = texts.where("text is not null and text <> ''").join(F.broadcast(chosen), on)
    rows = settle(rows.groupBy(*keys, "_h").agg(F.min("text").alias("text")), "sample")
    sizes = sorted(rows.select("_h", *keys, F.octet_length("text").alias("n")).collect())
    held: dict[tuple, int] = defaultdict(int)
    keep, shortest = [], {}
    for row in sizes:
        which = tuple(row[c] for c in group)
        if held[which] + row["n"] <= max_bytes:
            held[which] += row["n"]
            keep.append((*(row[c] for c in keys), False))
        elif which not in shortest or row["n"] < shortest[which]["n"]:
            shortest[which] = row
    keep += [(*(row[c] for c in keys), True) for which, row in shortest.items() if not held[which]]
    if not keep:
        return rows.limit(0).select(*keys, "text")
    kept = docs.sparkSession.createDataFrame(keep, rows.select(*keys, F.lit(False).alias("_cut")).schema)
    rows = rows.join(F.broadcast(kept), keys)  # no more rows than were chosen
    begun = F.substring("text", 1, max(1, max_bytes // 4))  # a character takes four bytes at most
    return rows.select(*keys, F.when(F.col("_cut"), begun).otherwise(F.col("text")).alias("text"))
