"""Quality rules on documents, and on hosts.

Per document, base counts are taken from the whole text.  Per host (the
``source`` column) failures are summed, the host's failure rate is shrunk with a
beta prior fitted to all hosts by moments, and a host whose shrunk rate passes a
limit takes its documents with it.

Edge cases: null or empty texts have no words and fail the least length; a null
host forms a group of its own, which is never rejected as a whole; an empty table
gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

# Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
_SPACES = dict.fromkeys(map(ord, " \t\n\r\x0b\x0c"))
_NOT_SYMBOLS = str.maketrans("", "", SYMBOLS)

#: A host goes when its shrunk failure rate is above this.
HOST_LIMIT = 0.5


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split on exactly \x20 and \x09-\x0D
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            reach = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(i, reach)
                    reach = i + 3
    return len(words), len(text.translate(_SPACES)), len(text) - len(text.translate(_NOT_SYMBOLS)), dup, repeat


def document_rules(docs: DataFrame) -> DataFrame:
    """doc_id, source, the base counts and base_failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [base_counts(x or "") for x in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")
            out.insert(0, "doc_id", batch["doc_id"])
            out.insert(1, "source", batch["source"])
            yield out

    own = docs.select(F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    out = own.mapInPandas(run, "doc_id string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("base_failed", failed)


def host_verdicts(rules: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: documents, failures, the shrunk rate and whether it is kept.

    The prior Beta(m*s, (1-m)*s) has the mean m and, by moments, the strength s of
    the hosts' rates; where the rates vary no more than chance (or there are too
    few hosts) s is the number of documents of a mean host.
    """
    hosts = rules.where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(
        F.count("*").alias("hosts"), F.avg("n").alias("mean_n"), F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(F.lit(1.0) / F.col("n")).alias("inv_n"),
    ).first()
    m, v = prior["m"] or 0.0, prior["v"] or 0.0
    # variance beyond the sampling noise of a mean host
    noise = m * (1 - m) * (prior["inv_n"] or 0.0)
    extra = v - noise
    strength = m * (1 - m) / extra - 1 if extra > 0 else (prior["mean_n"] or 1.0)
    strength = max(strength, 1.0)
    shrunk = (F.col("failed") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= limit)


def quality_rules(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row a document: the base counts, base_failed, the host's shrunk rate, kept."""
    rules = settle(document_rules(docs), "rules")
    hosts = host_verdicts(rules, limit).select("source", "host_rate", "host_kept")
    out = rules.join(hosts, "source", "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"),
    )
