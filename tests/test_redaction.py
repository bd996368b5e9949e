"""Redacted text and the number of matches come from one pass of the rules."""

from lorekeep.functions import text as T

TEXTS = ["password = hunter2secret and Bearer abcdefghijklmnop1234", "https://user:hunter22@example.org/path", "nothing", "", None, "pwd=abcd1 pwd=efgh2 token: abcdefghijklmnopq"]


def test_one_pass_equals_the_rules(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    done = rows.withColumn("d", T.redaction("t"))
    got = done.select("i", T.redact("t").alias("want"), "d.text", T.redaction_total(done["d"]).alias("n"), T.redaction_counts("t").alias("by")).orderBy("i").collect()
    assert [r["text"] for r in got] == [r["want"] for r in got]
    assert [r["n"] for r in got] == [sum(r["by"].values()) for r in got]
    assert got[3]["n"] == got[4]["n"] == 0 and got[0]["n"] >= 1
    # each rule is named by its search and by its cut, not once more for each later rule
    plan = done.select(T.redaction_total(done["d"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("PRIVATE KEY-----.*?") <= 2
