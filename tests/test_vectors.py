"""Vectors are made for changed texts alone; failures are told, and old vectors stay."""

from lorekeep.operators import vectors as V


def test_refresh(spark):
    def embedder(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("the service is down")
        return [None if t == "nothing" else [float(len(t)), 1.0] for t in texts]

    stored = spark.createDataFrame(
        [("memory", 1, "0cc175b9c0f1b6a831c399e269772661", "m", 2, [1.0, 1.0]), ("memory", 2, "old", "m", 2, [9.0, 9.0]), ("memory", 3, "old", "m", 2, [8.0, 8.0]), ("doc", 7, "x", "m", 1, [7.0])],
        "kind string, id long, fingerprint string, model string, dimensions long, vector array<double>",
    )
    subjects = spark.createDataFrame([("memory", 1, "a"), ("memory", 2, "boom"), ("memory", 3, "new text"), ("memory", 4, "nothing"), ("memory", 5, None), ("doc", 1, "a")], "kind string, id long, text string")
    vectors, audit = V.refreshed(stored, subjects.repartition(2), embedder, "n", batch=3)
    assert sorted((r["kind"], r["id"], r["model"], r["vector"]) for r in vectors.collect()) == [
        ("doc", 1, "n", [1.0, 1.0]), ("doc", 7, "m", [7.0]), ("memory", 1, "m", [1.0, 1.0]), ("memory", 2, "m", [9.0, 9.0]), ("memory", 3, "n", [8.0, 1.0]), ("memory", 5, "n", [0.0, 1.0]),
    ]
    assert sorted((r["kind"], r["id"], r["ok"], r["error"]) for r in audit.collect()) == [
        ("doc", 1, True, None), ("memory", 2, False, "the service is down"), ("memory", 3, True, None), ("memory", 4, False, "no vector"), ("memory", 5, True, None),
    ]
    again, calls = V.refreshed(vectors, subjects.where("id <> 2 and id <> 4"), embedder, "n")
    assert calls.count() == 0 and again.count() == vectors.count()
    assert V.refreshed(stored.limit(0), subjects.limit(0), embedder, "n")[0].count() == 0
