"""Prefix relations in sorted order, over ranges that cut families of words, against all pairs."""

from __future__ import annotations

import random

from lorekeep.operators import prefixes as P
from lorekeep.operators import review as V


def test_related_words_against_all_pairs(spark):
    pick = random.Random(11)
    word = lambda: "".join(pick.choice("ab") for _ in range(pick.randrange(7)))
    known = [(word(), f"f{i:03}") for i in range(60)] + [("abé", "f900"), (None, "f901"), ("ab", None)]
    asked = [(word(),) for _ in range(50)] + [("abéx",), (None,), ("zz",)]
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few = P.few_targets(spark.createDataFrame(known, "word string, target string"))
        got = {r["word"]: r["few"] for r in P.related(spark.createDataFrame(asked, "word string"), few).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])
    pairs = [(w, t) for w, t in known if w is not None and t is not None]
    for (a,) in set(asked):
        want = {t for w, t in pairs if a is not None and w != a and (w.startswith(a) or a.startswith(w))}
        if want:
            assert set(got.pop(a)) <= want if len(want) > P.FEW else sorted(want) == got.pop(a)
    assert got == {}


def test_imports_of_a_stem_with_many_files(spark):
    files = spark.createDataFrame([(f"m{i}/mod.rs", "mod") for i in range(30)] + [("a/io.rs", "io"), ("b/iota.rs", "iota"), ("c/solo.rs", "solo")], "file string, stem string")
    paths = ["crate::mod::x", "std::io", "std::io;", "solo_thing::y", "crate::iot", "nothing::here", "::;", None]
    uses = spark.createDataFrame([("a/io.rs", i, p) for i, p in enumerate(paths)] + [("q.rs", 20, "io"), ("q.rs", 21, "i")], "file string, line int, path string")
    got = {r["line"]: (r["target"], r["heuristic"]) for r in V.import_edges(uses, files).collect()}
    # a file doesn't answer itself: io leads from io.rs to iota.rs only
    assert got == {1: ("b/iota.rs", True), 2: ("b/iota.rs", True), 3: ("c/solo.rs", True), 4: ("b/iota.rs", True), 20: ("a/io.rs", False)}
