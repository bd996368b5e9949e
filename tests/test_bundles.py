"""Bundles and concept indexes as files, review items, summaries, markers and chunks."""

from __future__ import annotations

import pytest

from lorekeep.functions import text as T
from lorekeep.operators import bundles as U
from lorekeep.operators import extraction as X
from lorekeep.operators import graph as G
from lorekeep.sources import files

MEMORY = "memory_id string, store string, category string, status string, body string, label string, uri string"


def memories(spark):
    rows = [
        ("b", "project", "Tool Use", "active", "# Title here \nmore", "token: ghp_abcdefghij0123456789ABCDEFGHIJ", None),
        ("a", "project", "", "active", "\n　 \n", "plain", "https://me:pw12345678@host/x"),
        ("c", "global", "Misc", "active", "x" * 100, None, None),
        ("d", "project", "Misc", "superseded", "old", None, None),
        ("e f", "project", "Misc", "active", None, None, None),
    ]
    return spark.createDataFrame(rows, MEMORY)


def test_bundle(spark, tmp_path):
    out = U.export(memories(spark), ("project",), ("body", "label", "uri"))
    got = {r["memory_id"]: r for r in out.collect()}
    assert set(got) == {"a", "b", "e f"}
    assert got["b"]["redactions"] > 0 and "ghp_" not in got["b"]["label"] and got["a"]["redactions"] > 0 and "pw12345678" not in got["a"]["uri"]
    assert got["e f"]["redactions"] == 0 and got["e f"]["body"] is None
    path = str(tmp_path / "x")
    U.write(out.repartition(3), path, "memory_id", "me", ("project",))
    lines = [x for f in sorted((tmp_path / "x" / "entries").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x[14] for x in lines] == ["a", "b", "e"] and lines[1].startswith('{"memory_id":"b","store":"project",')
    back = U.read(spark, path, MEMORY)
    assert sorted(map(str, back.collect())) == sorted(map(str, out.drop("redactions").collect()))
    head = spark.read.json(f"{path}/header").head()
    assert (head["entry_count"], head["redaction_count"]) == (3, sum(r["redactions"] for r in got.values()))
    damaged = next(f for f in (tmp_path / "x" / "entries").glob("part-*") if f.read_text())
    damaged.write_text(damaged.read_text().replace("Title", "Other").replace("Misc", "Else"))
    (damaged.parent / f".{damaged.name}.crc").unlink()
    with pytest.raises(ValueError, match="written"):
        U.read(spark, path, MEMORY)
    U.write(out, str(tmp_path / "new"), "memory_id", "me", ("project",), version=U.FORMAT_VERSION + 1)
    with pytest.raises(ValueError, match="newer"):
        U.read(spark, str(tmp_path / "new"), MEMORY)


def test_entries_join_what_they_repeat(spark):
    row = lambda *x: spark.createDataFrame(list(x), "id long, summary string")
    incoming = row((1, "alpha beta gamma delta"), (2, "Delta gamma beta alpha!"), (3, "one two three"), (4, None), (5, "waiting words here"))
    got = {r["id"]: r["outcome"] for r in U.enqueued(incoming, row((90, "waiting words here"), (91, "waiting words here"))).collect()}
    assert got == {1: "added", 2: "duplicate", 3: "added", 4: "added", 5: "duplicate"}
    assert U.enqueued(incoming.limit(0), incoming).count() == 0


def test_indexes(spark, tmp_path):
    folders, root = U.index_lines(memories(spark))
    got = {}
    for r in folders.orderBy("dir", "at").collect():
        got.setdefault(r["dir"], []).append(r["line"])
    assert got["tool-use"] == ["# tool-use", "", "- [Title here](b.md)"]
    assert got["concepts"] == ["# concepts", "", "- [a](a.md)"]
    assert got["misc"] == ["# misc", "", "- [" + "x" * 80 + "](c.md)", "- [old](d.md)", "- [e f](e-f.md)"]
    assert [r["line"] for r in root.orderBy("at").collect()] == ["# OKF bundle", "", "- [concepts](concepts/index.md)", "- [misc](misc/index.md)", "- [tool-use](tool-use/index.md)"]
    U.write_indexes(folders, root, str(tmp_path / "o"))
    assert {p.name for p in (tmp_path / "o" / "concepts").glob("dir=*")} == {"dir=concepts", "dir=misc", "dir=tool-use"}


def test_items_of_stale_memories(spark):
    affected = spark.createDataFrame([(1, 0.9, 1), (2, 0.59, 0), (3, 0.6, 4), (4, 0.8, 2)], "memory_id long, strength double, hops long")
    fresh = spark.createDataFrame([(1,), (1,), (2,), (3,)], "memory_id long")
    got = {r["id"]: r for r in G.stale_items(affected, fresh, spark.createDataFrame([("stale-3",), (None,)], "id string")).collect()}
    assert set(got) == {"stale-1", "stale-3"} and got["stale-1"]["enqueued"] and not got["stale-3"]["enqueued"]
    assert got["stale-1"]["summary"] == "Review possibly-stale memory 1: code it was anchored to changed (risk High)."
    assert "(risk Low)" in got["stale-3"]["summary"]


def test_summaries_and_markers(spark):
    lines = [("a", i, x) for i, x in enumerate(["", "first", "it is Blocked", "stale risk", None, "x", "y", "use that instead"])] + [("b", 0, "")]
    (got,) = X.summaries(spark.createDataFrame(lines, "session string, line_no long, line string")).collect()
    assert tuple(got) == ("a", "first", "first\nit is Blocked\nstale risk\nx\ny", "it is Blocked\nstale risk", "stale risk")
    said = ["user: Lesson: keep it ", "lesson:", "a lesson: no", "This Could Be A Reusable thing", None]
    rows = spark.createDataFrame([(x,) for x in said], "x string").select("x", T.lesson_marker("x").alias("l"), T.skill_intent("x").alias("s"), T.skill_slug("x").alias("g")).collect()
    assert {r["x"]: (r["l"], r["s"]) for r in rows} == {said[0]: ("keep it", False), said[1]: ("", False), said[2]: (None, False), said[3]: (None, True), None: (None, None)}
    assert spark.createDataFrame([("!!",)], "x string").select(T.skill_slug("x")).head()[0] == "suggested-skill"


def test_chunks_are_cut_at_line_feeds_only():
    assert files.chunk_markdown("# H\r\none\x0btwo # no heading\r\n") == [("H", "one\x0btwo # no heading")]
    long = "p" * 900
    assert files.chunk_markdown(f"# A\n\n{long}\n\n{long}\n\n# Empty\n\n# B\n\nx", 1600) == [("A", long), ("A", long), ("B", "x")]
