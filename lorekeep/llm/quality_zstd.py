"""Quality classifier by compression.

Two zstandard dictionaries are trained on whole good and bad labelled texts.  A
text is compressed in blocks with either and with none.  Three normalised size
differences become a score by a logistic curve, fitted to labelled rows that the
dictionaries haven't seen: bad less good over the plain size, of the whole text and
of its worst block, and none less good over the length (what the good dictionary
saves, which is little where a text repeats itself).

The fit reads at most ``MAX_TEXTS`` texts of each label and part, in the order of a
hash of their ids, those that fit into ``MAX_BYTES`` bytes together: the documented
bound of the classifier's sample.  The share of each label among all labelled rows is
counted and restored in the curve.  All rows are scored, whole.

Edge cases: null and empty texts have a difference of 0 and score alike; with
fewer than two labels to learn from every score is 0.5; labels without a document,
null labels, labels other than 0 and 1 and ids with both labels are ignored; of
documents that repeat a labelled id the smallest text is learned; repeated rows
score alike; an empty table gives no rows; a very long text is compressed block by
block; a column ``score`` of the input is replaced, others are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, released, sampled

MAX_TEXTS = 1200
MAX_BYTES = 16 << 20
DICT_BYTES = 131_072
BLOCK = 1024
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


class Scorer:
    def __init__(self, model: Model):
        import zstandard as z

        press = lambda d: z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.weights = model.weights
        self.plain = z.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        self.sides = []
        for raw in (model.good, model.bad):
            own = z.ZstdCompressionDict(raw) if raw else None
            if own is not None:
                own.precompute_compress(level=LEVEL)
            self.sides.append(press(own) if own is not None else self.plain)

    def features(self, text: str) -> tuple[float, ...]:
        """1 and normalised size differences: bad less good, also of the worst block, and none less good."""
        data = text.encode("utf-8", "surrogatepass")
        sums = np.zeros(3, dtype=np.int64)
        worst = None
        for i in range(0, len(data), BLOCK):
            block = data[i : i + BLOCK]
            good, bad, plain = (len(x.compress(block)) for x in (*self.sides, self.plain))
            sums += (good, bad, plain)
            if worst is None or (len(block) >= 256 and (bad - good) / plain < worst):
                worst = (bad - good) / plain
        good, bad, plain = sums.tolist()
        return (1.0, (bad - good) / plain, worst, (plain - good) / len(data)) if data else (1.0, 0.0, 0.0, 0.0)

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.5
        x = sum(w * f for w, f in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps; features are scaled inside."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[0] = 0.0, 1.0
    scale[scale == 0] = 1.0
    z = (x - mean) / scale
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(z) * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * len(z) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    out = w / scale
    out[0] -= (out * mean)[1:].sum()
    return out


def sample(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES) -> tuple[list, dict[int, int]]:
    """(part, quality, text) rows to learn from, never of the held-out fold, and how many rows have each label."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    ids = ids.where(crc_mod("doc_id", folds) != held_out).withColumn("_part", (F.xxhash64("doc_id") % 2 != 0).cast("int")).withColumn("_h", F.xxhash64("doc_id", F.lit(7)))
    totals = {r["quality"]: r["n"] for r in ids.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for quality in (0, 1):
        for part in (0, 1):
            one = ids.where((F.col("quality") == quality) & (F.col("_part") == part)).orderBy("_h", "doc_id").limit(max_texts)
            chosen = one if chosen is None else chosen.unionAll(one)
    # at most 4 * max_texts rows of four numbers: the broadcast has a fixed bound
    rows = sampled(docs.select("doc_id", "text"), chosen.select("doc_id", "_part", "quality", "_h"), ["_part", "quality"], max_bytes)
    return sorted((r["_part"], r["quality"], r["text"]) for r in rows.collect()), totals


def fit(rows: list, totals: dict[int, int] | None = None) -> Model:
    """The model of a sample.

    With ``totals`` the curve's intercept is moved from the labels' shares in the
    sample to those of all labelled rows, so that a score means the same however many
    rows the sample leaves out of either label.
    """
    import zstandard as z

    def trained(texts: list[bytes]) -> bytes:
        if not texts:
            return b""
        try:
            return z.train_dictionary(DICT_BYTES, texts, k=256, d=8).as_bytes()
        except z.ZstdError:  # too little to train on: the texts themselves serve
            return b"".join(texts)[-DICT_BYTES:]

    learn = {q: [t.encode("utf-8", "surrogatepass") for part, label, t in rows if part == 0 and label == q] for q in (0, 1)}
    if not (learn[0] and learn[1]):
        return Model(b"", b"", ())
    model = Model(trained(learn[1]), trained(learn[0]), ())
    tune = [(t, q) for part, q, t in rows if part == 1]
    if len({q for _, q in tune}) < 2:
        tune = [(t, q) for _, q, t in rows]
    scorer = Scorer(model)
    x, y = np.array([scorer.features(t) for t, _ in tune]), np.array([float(q) for _, q in tune])
    weights = logistic(x, y)
    if totals and all(totals.get(q) for q in (0, 1)) and 0 < y.sum() < len(y):
        weights[0] += math.log(totals[1] / totals[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(model.good, model.bad, tuple(float(w) for w in weights))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score``; rows pass through Arrow once, whole."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of fixed size

    @F.pandas_udf("double")
    @released
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.Series([scorer.score(x or "") for x in batch], dtype="float64")

    return docs.withColumn("score", run(F.col(text).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(*sample(docs, labels, held_out, folds))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
