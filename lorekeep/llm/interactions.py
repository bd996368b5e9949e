"""Filter interaction audit by a subset-zeta transform.

Five filters judge every document; which of them it fails is a mask of five bits.
Masks are counted by part (a language), with the counts of good and of toxic
documents.  For a part the counts of its masks, added over one bit after the other,
become the survivors of every subset of filters: those documents whose mask lies
within the filters left out.  A step of an order takes one filter more, so all that
it removes is the difference of two neighbouring subsets, for all documents and for
labelled ones.

Scale: a text is read once, in built-in functions, and leaves as a row of its id,
its SHA-256, its part and its mask.  The smallest id of each text comes from partial
minima.  Rows meet it by text *and* id, so that a text which a third of the rows
share is dealt by their ids.  After that only counts travel: at most 32 a part.

Edge cases: null texts count as empty ones, and so are copies of one another; a null
lang is the part ''; a null id is neither smaller nor larger than others and never
fails as a copy, and no label is its own; rows that repeat an id and a text don't fail by each other; of
several label rows of an id any that says 1 counts; texts of any length take the
same path; parts without documents don't exist, so an empty table gives no rows;
other columns aren't read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

# Fixed values of the filters.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = r"[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"

MEASURES = ("n", "good", "toxic")
SUBSETS = 1 << len(FILTERS)


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        F.lit(100).cast("long") * capitals > MAX_CAPITAL_PERCENT * F.char_length(text),
        F.regexp_like(text, F.lit(SYMBOLS)),
    )
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"),
    )
    rows = settle(rows, "masks")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))  # rows that repeat are one from here on
    rows = rows.join(first, ["doc_id", "digest"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = rows.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), "n")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    )
    rows = rows.join(said, "doc_id", "left")
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """A row a part: for each measure the counts by mask, and those that each subset of filters leaves.

    ``n``, ``good``, ``toxic`` are arrays by mask; ``n_left``, ... by subset.
    """
    one = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES)))).alias("found"))  # 32 entries at most
    every = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    counted = lambda c: F.transform(every, lambda m: F.coalesce(F.try_element_at("found", m)[c], F.lit(0).cast("long")))
    own = one.select("part", *[counted(c).alias(c) for c in MEASURES])
    own = own.select("*", *[F.col(c).alias(f"{c}_left") for c in MEASURES])
    for bit in (1 << k for k in range(len(FILTERS))):
        # counts of the masks within each set: a bit is added a pass
        own = own.select("part", *MEASURES, *[_pass(f"{c}_left", bit) for c in MEASURES])
    # filters in a subset leave the masks within the other filters
    return own.select("part", *MEASURES, *[F.reverse(f"{c}_left").alias(f"{c}_left") for c in MEASURES])


def _pass(column: str, bit: int) -> Column:
    lower = lambda x, i: F.when(i.bitwiseAND(bit) != 0, x + F.element_at(column, i - bit + 1)).otherwise(x)
    return F.transform(F.col(column), lower).alias(column)


def _steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, the bit of its filter, the filters before it: all 600."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), k + 1, bit, before))
            before |= bit
    return out


def _shapley(bit: int) -> Column:
    """What a filter removes, over all orders: a subset comes before it in |S|! (4 - |S|)! of them."""
    sets = [s for s in range(SUBSETS) if not s & bit]
    orders = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
    return sum(((F.col("n_left")[s] - F.col("n_left")[s | bit]) * orders(s) for s in sets), F.lit(0).cast("long"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    bits = [1 << k for k in range(len(FILTERS))]
    own = survivors(masks(docs, labels)).withColumn("shapleys", F.array(*map(_shapley, bits)))
    steps = docs.sparkSession.createDataFrame(_steps(), "filter_order string, step int, bit int, before int")
    rows = own.crossJoin(F.broadcast(steps))  # 600 rows, whatever the input
    left = lambda c, s: F.element_at(f"{c}_left", s + 1)
    before, bit = F.col("before"), F.col("bit")
    after = before.bitwiseOR(bit)
    removed = left("n", before) - left("n", after)
    failing = F.element_at("n_left", 1) - left("n", bit)
    return rows.select(
        "part", "filter_order", "step", left("n", after).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"),
        F.element_at("n", bit + 1).alias("unique_fails"), (left("good", before) - left("good", after)).alias("good_lost"),
        (left("toxic", before) - left("toxic", after)).alias("toxic_lost"), F.element_at("shapleys", F.log2(bit).cast("int") + 1).alias("shapley"),
    )
