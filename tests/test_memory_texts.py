"""Bodies that no label has to do with: none is shuffled for a column that isn't asked for, and no version is made before it is asked for."""

from __future__ import annotations

from lorekeep.operators import versions as V
from lorekeep.plans import bindings as B
from lorekeep.plans import changes as C

SF = "/root/testdata/sf0.001"


def test_texts_are_memory_without_labels(spark):
    texts, memory = B.texts(spark, SF), B.memory(spark, SF)
    assert [c for c in memory.columns if c not in ("stale", "contradicted")] == texts.columns
    assert sorted(map(tuple, texts.collect()), key=str) == sorted(map(tuple, memory.select(*texts.columns).collect()), key=str)


def test_the_index_reads_bodies_without_a_join(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(B.I, "build", lambda rows: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or rows)
    monkeypatch.setattr(B, "_INDEXES", {})
    B.memory_index(spark, SF)
    assert len(seen) == 1 and "Join" not in seen[0]


def test_a_version_is_made_when_it_is_asked_for(spark, monkeypatch):
    monkeypatch.setattr(C, "_TABLES", {})
    first = C.QUERIES["M1_upsert_version"](spark, SF)
    table = next(iter(C._TABLES.values()))
    assert V.newest(table) == 1 and first.count() > B.memory(spark, SF).count()
    C.QUERIES["M8_bump_version"](spark, SF)
    assert V.newest(table) == 3
    assert sorted(r["version"] for r in C.QUERIES["M1_rows_written"](spark, SF).collect()) == [1, 2, 3, 4, 5]
    assert V.newest(table) == 5 and sorted(map(tuple, C.QUERIES["M1_upsert_version"](spark, SF).collect()), key=str) == sorted(map(tuple, first.collect()), key=str)


def test_a_stream_of_operations_meets_versions_and_no_texts(spark, monkeypatch):
    seen = []
    run = C.sync.run
    monkeypatch.setattr(C.sync, "run", lambda ops, memory, *rest: (seen.append(memory._jdf.queryExecution().optimizedPlan().toString()), run(ops, memory, *rest))[1])
    assert C.QUERIES["M26_stream_routes"](spark, SF).count() > 0
    assert len(seen) == 1 and "sha2" not in seen[0] and "text" not in seen[0]
