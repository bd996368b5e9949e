"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bpe_rounds, embed, interactions, langid, layout, minhash, packing, quality_zstd, rules, secrets, suffix, warc
from .common import table
from .oracles import ORACLES


def _tokenizer(name: str) -> str:
    """Where a public tokenizer file lies; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_zstd.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_rounds.digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op12_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.clustered(table(spark, sf_dir, "documents"))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_secret_scan, op2_suffix_dedup, op3_warc, op4_packing, op5_quality, op6_language, op7_minhash, op8_bpe, op9_embedding, op10_rules,
        op11_bpe_rounds, op12_layout, op13_interactions,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
