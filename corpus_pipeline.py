"""A corpus pipeline of five stages, each written as Parquet and read again.

Quality classifier, MinHash near-dedup, suffix-array dedup, secret scans, packing.
All stages but the last return the columns of ``documents``; other columns are
dropped.  Every stage takes an empty table (and gives one), null texts (as empty),
null and repeated ids, and texts of any length; a row that repeats is kept once, by
the near-dedup stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm import minhash, packing, quality_zstd, secrets, suffix
from lorekeep.llm.common import settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.5 or more).

    Null and empty texts share a score; without labels of both kinds all stay.
    """
    model = quality_zstd.fit(*quality_zstd.sample(docs, table(spark, sf_dir, "labels")))
    return _columns(quality_zstd.score(_columns(docs), model).where("score >= 0.5"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the first by id, a null id last.

    Rows are told apart by a key of id and text, since ids may repeat or be null; of
    rows that agree in both (128 bits more tell texts whose keys collide) the first by
    the other columns stays.  Texts without a
    word are linked with nothing and stay, once for each id.
    """
    docs = docs.withColumn("_key", F.xxhash64("doc_id", "text", F.col("text").isNull()))
    groups = minhash.near_duplicates(docs.select(F.col("_key").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key"))
    first = docs.select("_key", "doc_id").distinct().join(groups, "_key").groupBy("component_id").agg(F.min(order).alias("one"))
    kept = docs.join(first.select(F.col("one._key").alias("_key")), "_key", "left_semi")
    rest = [F.col(c) for c in COLUMNS if c in docs.columns and c not in ("doc_id", "text")]
    once = Window.partitionBy("_key", "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).orderBy(*(rest or [F.col("_key")]))
    return _columns(kept.withColumn("_n", F.row_number().over(once)).where("_n = 1"))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut out of the texts; no row goes.

    Null texts stay null.  A removed range gives way at either end to whole characters, so that the rest
    stays valid UTF-8.
    """
    rest = suffix.remove_repeats(docs, COLUMNS, whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    return _columns(rest.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark, overlapping ones by one; no row goes and null texts stay null."""
    out = secrets.redact(_columns(docs).withColumn("_was", F.col("text")))
    return _columns(out.withColumn("n_chars", F.when(F.col("text") != F.col("_was"), F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens along the curve; an empty text is its end id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("secret scans", redaction),
    ("packing", pack),
]

#: SQL can't express the classifier, the packing order or the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
