import json

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import exchange as E
from lorekeep.operators import extraction as X
from lorekeep.operators import search as R
from lorekeep.operators import state as S
from lorekeep.operators import workspace as W
from lorekeep.operators import versions
from lorekeep.streaming import transcripts


def test_workspace_search(spark):
    """Anchored knowledge comes along with code in scope; a focus orders by distance."""
    nodes = spark.createDataFrame([("geometry::area", "function", "area", 0.9), ("geometry::volume", "function", "volume", 0.9), ("audio::mix", "function", "mix", 0.9)], "node string, kind string, name string, confidence double").withColumn("created_at", F.lit("2025-01-01").cast("date"))
    memory = spark.createDataFrame([(1, "anchored lesson"), (2, "area of a circle"), (3, "unrelated")], "memory_id long, body string")
    hits = spark.createDataFrame([(2, 3)], "memory_id long, score long").withColumn("created_at", F.lit("2025-01-01").cast("date"))
    anchors = spark.createDataFrame([(1, "geometry::area", 0.8), (3, "audio::mix", 0.9)], "memory_id long, node string, strength double")
    today = F.lit("2025-01-01").cast("date")
    got = {r["id"]: r for r in W.search(nodes, hits, memory, anchors, ["area"], today).collect()}
    assert set(got) == {"geometry::area", "1", "2"} and got["1"]["structural"] == 0.8 and got["1"]["intent"] == 0 and got["2"]["intent"] == pytest.approx(0.75)
    hops = spark.createDataFrame([("audio::mix", 0), ("geometry::volume", 1)], "node string, hops int")
    near = {r["id"]: r["score"] for r in W.search(nodes, hits, memory, anchors, ["nothing"], today, hops).collect()}
    assert set(near) == {"audio::mix", "geometry::volume", "2", "3"} and near["audio::mix"] > near["geometry::volume"] and near["3"] == pytest.approx(0.4 * 0.9)


def test_overview_and_primer(spark):
    files = spark.createDataFrame([("src/core.rs",), ("src/util.rs",), ("app/main.py",), ("notes.txt",)], "path string")
    symbols = spark.createDataFrame([(n, "function") for n in ("hub", "a", "b", "run")] + [("T", "type")], "node string, kind string")
    calls = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("run", "a"), ("run", "b")], "src string, dst string")
    own = W.architecture(files, symbols, calls)
    rows = {(r["section"], r["rank"]): (r["name"], r["n"]) for r in own.collect()}
    assert rows["hotspot", 1] == ("hub", 2) and rows["entry_point", 1] == ("run", 2) and rows["language", 1] == ("rust", 2) and rows["package", 1] == ("src", 2)
    digest = W.overview_digest(own).first()[0]
    assert digest == "f4s5|Lrust:2|Lother:1|Lpython:1|Psrc:2|P.:1|Papp:1|Erun|Hhub:2|Ha:1|Hb:1"
    assert W.primer_body(own, "r", "c").first()[0].startswith("Repository primer for r@c.\n4 files, 5 symbols.\nLanguages: rust (2), other (1), python (1).\n")
    none = W.architecture(files.limit(0), symbols.limit(0), calls.limit(0))
    assert W.overview_digest(none).first()[0] == "f0s0"


def test_tests_of_functions(spark):
    functions = spark.createDataFrame([("f", "f::x", "x"), ("g", "g::x", "x"), ("g", "g::y", "y"), ("h", "h::z", "z"), ("k", "k::z", "z")], "file string, node string, name string")
    calls = spark.createDataFrame([("f", "t1", "x"), ("f", "t1", "y"), ("f", "t1", "z")], "file string, test string, callee string")
    got = {(r["src"], r["derivation"], r["confidence"]) for r in W.tests_of_functions(calls, functions).collect()}
    assert got == {("f::x", "parsed", 1.0), ("g::y", "heuristic", 0.6)}


def test_concept_files(spark):
    rows = spark.createDataFrame([("---\ntype: Table\ntitle: 'It''s'\ntags: [a, \"b\"]\n---\n\nbody\nmore\n",), ("---\ntitle: x\n---\nbody",), ("no front matter",)], "okf string")
    got = E.from_okf(rows).collect()
    assert (got[0]["type"], got[0]["title"], got[0]["tags"], got[0]["body"], got[0]["error"]) == ("Table", "It's", ["a", "b"], "body\nmore", None)
    assert [r["error"] for r in got[1:]] == ["MissingType", "MissingFrontMatter"] and got[1]["id"] is None
    notes = spark.createDataFrame([("m/MEMORY.md", "---\nname: a\n---\n"), ("m/a.md", "---\nname: a\ndescription: \"b: c\"\nmetadata:\n  type: feedback\n---\ntext"), ("m/b.md", "plain")], "path string, text string")
    assert [tuple(r) for r in E.agent_notes(notes).collect()] == [("m/a.md", "b: c", "feedback")]


def test_entropy_backstop(spark):
    secret = "Zq8vX2mN7pLr4TkW9sYb3HcJ6fGd1AeU"
    rows = spark.createDataFrame([(f"a {secret}, b {'a' * 40} {secret}",), ("short",), (None,), ("",)], "x string")
    got = [r[0] for r in rows.select(E.redact_entropy("x")).collect()]
    assert got == [f"a [REDACTED:high_entropy], b {'a' * 40} [REDACTED:high_entropy]", "short", None, ""]


def test_explicit_contradictions(spark):
    memory = spark.createDataFrame([(1, "active", "use tabs"), (2, "active", "do not use tabs"), (3, "active", "use spaces")], "memory_id long, status string, body string")
    entities = spark.createDataFrame([(1, "style"), (2, "style")], "memory_id long, entity string")
    said = spark.createDataFrame([(3, 1)], "memory_id long, target long")
    assert {tuple(r) for r in S.all_contradictions(memory, entities, said).collect()} == {(1, 2), (2, 1), (3, 1), (1, 3)}


def test_ingest_and_reindex(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    return g()\n\ndef test_f():\n    f()\n"), ("b.py", "def g():\n    pass\n"), ("c.py", "def broken(")], "path string, text string")
    nodes, edges = X.ingest(files)
    got = {(r["src"], r["dst"], r["kind"], r["confidence"]) for r in edges.where("kind <> 'contains'").collect()}
    assert got == {("a.py::f", "b.py::g", "calls", 0.6), ("a.py::test_f", "a.py::f", "calls", 0.9), ("a.py::f", "a.py::test_f", "tested_by", 1.0)}
    run = X.reindex(nodes, files.where("path <> 'b.py'"), spark.createDataFrame([("a.py", "def h():\n    pass\n")], files.schema))
    assert {(r["node"], r["state"]) for r in run.collect()} == {("a.py::h", "indexed"), ("a.py", "indexed"), ("b.py::g", "pruned"), ("b.py", "pruned"), ("c.py", "kept")}


def test_ranked_and_near_duplicates(spark):
    rows = spark.range(1000).selectExpr("(id * 37) % 1000 as k").repartition(7)
    assert all(r["k"] + 1 == r["at"] for r in R.ranked(rows, ["k"], "at").collect())
    texts = ["alpha beta gamma delta", "alpha beta gamma omega", "delta gamma beta alpha", "alpha", "one two three four five six", "one two three four five seven eight"]
    words = [frozenset(t.split()) for t in texts]
    got = {(r["a"], r["b"]) for r in R.near_duplicate_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", 0.7).collect()}
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if words[i] != words[j] and 2 not in (i, j) and len(words[i] & words[j]) >= 0.7 * min(len(words[i]), len(words[j]))}
    assert got == want


def test_streams(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put = lambda name, rows: (inbox / name).write_text("\n".join(json.dumps(r) for r in rows))
    line = lambda s, at, text: {"session": s, "at": f"2025-01-01T00:{at}:00", "role": "user", "line": text}
    put("1.json", [line("a", "01", "error: it broke"), line("a", "02", "password=hunter22 here"), line("a", "02", "Error: it broke!")])
    lines = transcripts.read_lines(spark, str(inbox), 1)
    merge = lambda old, new: S.upsert(old, new, "canonical")
    run = lambda: transcripts.upsert_into(transcripts.distinct_lines(lines), str(tmp_path / "table"), "canonical", str(tmp_path / "check"), merge).awaitTermination()
    run()
    put("2.json", [line("b", "03", "all fine")])
    run()
    table = versions.read(versions.Table(spark, str(tmp_path / "table"), "canonical")).collect()
    assert len(table) == 3 and not any("hunter22" in r["line"] for r in table)
    sums = transcripts.activity(lines).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    sums.awaitTermination()
    assert {(r["session"], r["lines"], r["failures"]) for r in spark.table("activity").collect()} == {("a", 3, 2), ("b", 1, 0)}


def test_lines_keep_their_last_digits(spark):
    """A line's number in its text is no list of characters to trim."""
    rows = spark.createDataFrame([("0 first 10\n 1 second 101 ",)], "body string")
    assert tuple(rows.select(E.title(F.col("body"), F.lit("c")), E.description(F.col("body"))).first()) == ("0 first 10", "1 second 101")
