from pyspark.sql import functions as F

from lorekeep.operators import review as V


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_code_language(spark):
    df = spark.createDataFrame([("a/b.RS",), ("Makefile",), ("x.d/y.tsx",), (None,), ("z.",)], "path string")
    assert [r[0] for r in df.select(V.code_language(F.col("path"))).collect()] == ["rust", None, "tsx", None, None]


def test_dominant_language_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,)], "language string")
    assert V.dominant_language(df).collect()[0]["language"] == "a"


def test_anchors(spark):
    nodes = spark.createDataFrame([("1", "m::f", "src/a.rs", "f"), ("2", "m::g", "src/b.rs", "g"), ("3", "n::g", "src/b.rs", "g"), ("4", None, None, "h")], "node string, qualified_name string, path string, name string")
    hints = spark.createDataFrame([("x", " m::f "), ("x", "src\\a.rs"), ("x", "h"), ("x", "g"), ("x", "src/b.rs"), ("x", "none"), ("x", " "), ("x", None)], "memory_id string, hint string")
    got = {r["hint"]: (r["node"], r["confidence"]) for r in V.anchor_memories(hints, nodes).collect()}
    assert got == {"m::f": ("1", 0.9), "src\\a.rs": ("1", 0.9), "h": ("4", 0.6), "g": (None, None), "src/b.rs": (None, None), "none": (None, None)}


def test_imports(spark):
    files = spark.createDataFrame([("a", "alpha"), ("b", "beta"), ("c", "be")], "file string, stem string")
    uses = spark.createDataFrame([("a", 1, "crate::beta;"), ("a", 2, "alphabet"), ("b", 3, "super::alphabet"), ("a", 4, "bet"), ("b", 5, "alpha.be")], "file string, line int, path string")
    assert rows(V.import_edges(uses, files), "line", "target", "heuristic") == [(1, "b", False), (3, "a", True)]


def test_relevance(spark):
    df = spark.createDataFrame([(["Retry", "zzz"], 2.0), ([], 1.0), (None, 1.0), (["retry budget now"], -1.0)], "asked array<string>, rate double")
    got = [r[0] for r in df.select(V.relevance(F.col("asked"), F.array(F.lit("retry budget")), F.col("rate"))).collect()]
    assert got == [0.35, 0.0, 0.0, 0.0]


def test_contained(spark):
    c = spark.createDataFrame(
        [("s", 1, 1, "Use the  retry budget"), ("s", 2, 2, "always use the retry budget here"), ("s", 3, 3, "use the retry BUDGET"), ("s", 4, 4, "short"), ("t", 5, 5, "use the retry budget"), ("s", 6, 6, None)],
        "session string, id int, place int, summary string",
    )
    assert rows(V.contained(c), "id", "duplicate_of") == [(2, 1), (3, 1)]


def test_decide_sourced_items_stay_manual(spark):
    items = spark.createDataFrame([(1, True, 0.9, False, None, False, True), (2, False, 0.9, True, "m", False, True), (3, False, 0.5, False, None, False, True), (4, False, 0.9, True, None, False, True)], "id int, sourced boolean, confidence double, conflict boolean, target string, duplicate boolean, general boolean")
    assert rows(V.decide(items, "trusted"), "id", "decision") == [(1, "manual"), (2, "supersede"), (3, "manual"), (4, "manual")]
    assert rows(V.decide(items, "automatic"), "id", "decision")[2] == (3, "accept")


def test_promote_and_receipts(spark):
    items = spark.createDataFrame([(1, "accepted", True, None, "s", True, None), (2, "edited", True, "r", "s", True, "t"), (3, "pending", False, None, "s", False, None)], "item_id int, state string, needs_edit boolean, replacement string, summary string, wants_global boolean, target string")
    assert rows(V.promote(items, False), "item_id", "error", "body", "scope") == [(1, "needs edit", None, None), (2, None, "r", "project"), (3, "not accepted", None, None)]
    held = spark.createDataFrame([("p", "f", "x"), ("q", "f", "y")], "proposal_id string, fingerprint string, survivor string")
    new = spark.createDataFrame([("p", "f", "n"), ("q", "g", "n"), ("r", "f", "n")], "proposal_id string, fingerprint string, survivor string")
    assert rows(V.receipts(held, new), "proposal_id", "outcome", "survivor") == [("p", "replayed", "x"), ("q", "conflict", None), ("r", "new", "n")]
