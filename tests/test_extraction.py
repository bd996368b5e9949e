from pyspark.sql import functions as F

from lorekeep.operators import extraction as X
from lorekeep.sources import files as S


def test_chunker():
    got = S.chunk_markdown("lead\n# One\nbody\n## Two\n\n#notahead\n" + "\n\n".join("p" * 700 for _ in range(4)))
    assert [h for h, _ in got] == [None, "One", "Two", "Two"] and got[0][1] == "lead"
    assert len(S.chunk_markdown("x" * 5000)) == 1 and S.chunk_markdown("# only\n\n") == []


def test_pairing_jumps_behind_a_fix(spark):
    rows = ["Error: the build broke again today", "Error: the build broke once more", "fixed it by raising the pool timeout", "Error: the other thing failed to start", "nothing here"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "session long, line_no long, line string")
    assert [tuple(r) for r in X.failure_resolutions(lines).collect()] == [(1, 0, 2)]


def test_markdown_round_trip(spark):
    rows = spark.createDataFrame([("1", "project", "Process", "active", "0.5", "2024-01-01", "body\n---\nmore")], "id string, scope string, category string, status string, confidence string, created_at string, body string")
    assert [tuple(r) for r in S.from_markdown(S.to_markdown(rows)).collect()] == [tuple(r) for r in rows.collect()]


def test_tree_and_admission(spark, tmp_path):
    for name in ("a.md", "x/b.MD", ".git/c.md", "node_modules/d.md", "e.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# T\nbody text")
    files = S.tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.collect()) == ["a.md", "x/b.MD"]
    kept, rejected = S.admitted(files, ["x/"])
    assert [r["path"] for r in kept.collect()] == ["a.md"] and rejected.count() == 1
    assert S.chunks(kept).first()["chunk_id"] == "a.md#0"


def test_parser_and_helpers(spark):
    items, calls = X.parse_python("m.py", "class A:\n  def f(self):\n    g(1)\ndef test_x(): pass\n")
    assert [i[:2] for i in items] == [("type", "m.py::A"), ("function", "m.py::A::f"), ("test", "m.py::test_x")] and calls == [("m.py::A::f", "g")]
    assert X.parse_python("m.py", "def (") == ([], [])
    assert S.lesson_bullets("- a long enough lesson bullet\n  goes on\n- short\n- [link](x) is an entry of the index\n") == ["a long enough lesson bullet goes on"]
    assert X.doc_search_state(1, True, True, 3, 0) == "IndexMismatch"
    rows = spark.createDataFrame([('<think>{</think>```json\n{"a": 1}\n```',), ("none",)], "x string")
    assert [r[0] for r in rows.select(S.json_payload(F.col("x"))).collect()] == ['{"a": 1}', None]
    assert S.embed(spark.createDataFrame([(1, "x")], "memory_id long, body string"), lambda texts: [[float(len(t))] for t in texts]).collect()[0]["vector"] == [1.0]
