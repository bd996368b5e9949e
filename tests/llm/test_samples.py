"""Bounded samples: giant texts take nothing from others, shares of labels and languages are kept; tiny and huge vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import embed, langid, quality_zstd

P = pytest.importorskip("public_tokenizers")


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("where", ["one giant text", "only giant texts", "none"])
def test_a_giant_text_leaves_the_languages(spark, where):
    rng = random.Random(6)
    giant = words(rng, "klmnop", 420_000)  # above the bound of a language
    assert len(giant) > langid.MAX_BYTES
    rows = [(i, words(rng, "abcdef", 60), "aa") for i in range(60)]
    rows += [(100 + i, giant if where == "only giant texts" and i < 2 else words(rng, "klmnop", 60), "bb") for i in range(2 if where == "only giant texts" else 60)]
    rows += [(300 + i, giant, "bb") for i in range(5 if where == "one giant text" else 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    tested = docs if where != "only giant texts" else docs.unionAll(spark.createDataFrame([(900 + i, words(rng, "klmnop", 60), None) for i in range(20)], docs.schema))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(tested, P.path("piece_bpe_32k.model")).collect()}
    assert len(got) == tested.count()
    assert all(v == ("aa" if k < 100 else "bb") for k, v in got.items())


def test_an_empty_table_has_no_language(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(docs, P.path("piece_bpe_32k.model")).count() == 0
    one = spark.createDataFrame([(1, "some words", None), (2, None, "en")], docs.schema)
    assert {r["lang_pred"] for r in langid.identify(one, P.path("piece_bpe_32k.model")).collect()} == {"und"}


def test_the_share_of_a_label_is_kept(spark):
    """Nine of ten labelled rows are good; a sample with as many of either label scores alike."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        good = i % 10 != 0
        noisy = rng.random() < 0.25  # some rows look like the other label
        rows.append((i, words(rng, "abcdef" if good != noisy else "uvwxyz", 40)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    said = spark.createDataFrame(labels, "doc_id long, quality int")
    whole, totals = quality_zstd.sample(docs, said)
    capped, same = quality_zstd.sample(docs, said, max_texts=45)
    assert totals == same and totals[1] > 8 * totals[0] and len(capped) < len(whole) / 3
    a, b = (quality_zstd.Scorer(quality_zstd.fit(r, totals)) for r in (whole, capped))
    free = quality_zstd.Scorer(quality_zstd.fit(capped))
    texts = [t for _, t in rows[:200]]
    mean = lambda s: float(np.mean([s.score(t) for t in texts]))
    assert abs(mean(a) - mean(b)) < 0.1 and abs(mean(a) - 0.9) < 0.1
    assert mean(free) < mean(b)


def test_a_giant_text_leaves_the_labels(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, "abcdef" if i % 2 else "uvwxyz", 40)) for i in range(120)] + [(1000 + i, "x " * 2000) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows, _ = quality_zstd.sample(docs, labels, max_bytes=3000)
    assert {(p, q) for p, q, _ in rows} == {(0, 0), (0, 1), (1, 0), (1, 1)} and all(len(t) <= 3000 for *_, t in rows)
    assert all(len(t) < 1000 for *_, t in rows)


def test_vectors_of_any_size(spark):
    rows = [
        (1, [1e-200, 0.0, 0.0, 0.0]), (2, [0.0, 1e-200, 0.0, 0.0]), (3, [3e-200, 1e-210, 0.0, 0.0]), (4, [1e200, 0.0, 0.0, 0.0]),
        (5, [0.0, 1e300, 1e300, 0.0]), (6, [0.0, 5e-324, 5e-324, 0.0]), (7, [0.0, 0.0, 0.0, 0.0]),
    ]
    got = {r["vec_id"]: r["component_id"] for r in embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
