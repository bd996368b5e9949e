"""Operations of peers as a stream: replays and any order of files give what one batch gives."""

from __future__ import annotations

import random

from lorekeep.streaming import sync


def test_replayed_and_reordered_files_give_the_batch_result(spark, tmp_path):
    pick = random.Random(3)
    ops = [(f"p{pick.randrange(2)}", pick.randrange(6), pick.choice(["update", "supersede"]), f"v{pick.randrange(4)}", at) for at in range(60)]
    memory = spark.createDataFrame([(i, f"v{i % 4}") for i in range(4)], "memory_id long, version string")
    files = [ops[i : i + 15] for i in range(0, 60, 15)]
    pick.shuffle(files)
    inbox = str(tmp_path / "in")
    for rows in [*files, files[0]]:
        spark.createDataFrame(rows, sync.SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    spark.createDataFrame([(None, 1, "update", "v", 99), ("p0", 1, "update", None, 99)], sync.SCHEMA).write.mode("append").parquet(inbox)
    go = lambda: sync.run(sync.read_ops(spark, inbox, 1), memory, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    go()
    once = spark.read.parquet(str(tmp_path / "out")).count()
    spark.createDataFrame(files[1], sync.SCHEMA).write.mode("append").parquet(inbox)
    go()  # all of it is known
    moves = spark.read.parquet(str(tmp_path / "out"))
    assert moves.count() == once
    last = {(peer, memory_id): (version, kind) for peer, memory_id, kind, version, _ in ops}
    got = {(r["peer"], r["memory_id"]): (r["version"], r["kind"]) for r in sync.newest(moves).collect()}
    assert got == last
    for r in moves.collect():
        own = f"v{r['memory_id'] % 4}" if r["memory_id"] < 4 else None
        if r["kind"] == "supersede":
            assert r["route"] == ("flag" if own else "skip")
        else:
            assert r["route"] == ("candidate" if own is None else "same" if own == r["version"] else "conflict")
