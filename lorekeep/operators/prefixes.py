"""Words and the words that begin them, met in sorted order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import settle

#: So many targets of a word tell whether one other than a given target is its only one.
FEW = 3


def _some(*lists: Iterable[str]) -> list[str]:
    """Up to FEW different targets of the lists, the smallest of those looked at."""
    return sorted({t for x in lists for t in x})[:FEW]


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of a part in order, on a stack of those that begin the present one."""
    stack: list[list] = []  # word, asked, own targets, targets of the words that begin it, of those that it begins
    part, out = None, []

    def pop() -> None:
        word, asked, own, above, below = stack.pop()
        if stack:
            stack[-1][4] = _some(stack[-1][4], own, below)
        met = _some(above, below)
        if asked and met:
            out.append((word, met))

    for batch in batches:
        for number, word, asked, own in zip(batch["_part"], batch["word"], batch["asked"], batch["few"], strict=True):
            while stack and (number != part or not word.startswith(stack[-1][0])):
                pop()
            part = number
            above = _some(stack[-1][3], stack[-1][2]) if stack else []
            stack.append([word, asked, [] if own is None else list(own), above, []])
        yield pd.DataFrame(out, columns=["word", "few"])
        out.clear()
    while stack:
        pop()
    yield pd.DataFrame(out, columns=["word", "few"])


def few_targets(known: DataFrame) -> DataFrame:
    """word, few: up to FEW targets of each word of (word, target), the smallest ones."""
    first = F.row_number().over(Window.partitionBy("word").orderBy("target"))
    own = known.where("word is not null and target is not null").distinct()
    return own.withColumn("_n", first).where(F.col("_n") <= FEW).groupBy("word").agg(F.collect_list("target").alias("few"))


def _heads(text: Column) -> Column:
    """All proper prefixes of a text, the empty one included."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0))), lambda n: F.substring(text, F.lit(1), n))


def related(asked: DataFrame, few: DataFrame) -> DataFrame:
    """word, few: targets of the known words that begin each asked word or are begun by it, itself not among them.

    All of them where there are FEW or less, else FEW of them.  ``asked`` has word, ``few`` is
    that of ``few_targets``.  In sorted order the words that begin with a word follow it, so one
    pass over each range of the order keeps them on a stack; what earlier ranges hold
    of it are the words that begin its first one, and only those are spelled out.
    """
    one = asked.select("word").where("word is not null").distinct().withColumn("_asked", F.lit(True))
    words = one.join(few, "word", "full_outer").select("word", F.coalesce("_asked", F.lit(False)).alias("asked"), "few")
    parted = settle(words.repartitionByRange("word").withColumn("_part", F.spark_partition_id()), "prefixes")
    firsts = parted.groupBy("_part").agg(F.min("word").alias("_first"))
    heads = firsts.select(F.col("_part").alias("_to"), "_first", F.explode(_heads(F.col("_first"))).alias("word")).where("word <> _first")
    carried = parted.join(heads, "word").select("word", "asked", "few", F.col("_to").alias("_part"))
    ordered = parted.unionByName(carried).repartition("_part").sortWithinPartitions("_part", "word")
    found = ordered.select("_part", "word", "asked", "few").mapInPandas(_sweep, "word string, few array<string>")
    whole = F.array_distinct(F.flatten(F.collect_list("few")))  # a list for each range that the words after it fill
    return found.groupBy("word").agg(F.slice(F.array_sort(whole), 1, FEW).alias("few"))
