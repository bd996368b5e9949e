"""Queries that search for many candidates at once: snippets, accepted matches, review modes, skill drafts, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import exchange as E
from lorekeep.operators import index as I
from lorekeep.operators import passages as P
from lorekeep.operators import review as V
from lorekeep.operators import vectors as X
from lorekeep.operators.stages import settle

from . import bindings as B
from .exchange import _DRAFTS
from .exchange import _items as skill_items
from .texts import _TOKENS, _any, _list, _low

QUERIES, ORACLES = {}, {}
NAMES = ["memory_id", "store"]
#: Letters of a text that serve as a candidate's summary.
SUMMARY = 120


def query(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# SQL of the same searches.  In scope: memory, asked(ask, query), eligible(memory_id, store).
_FOLD = lambda x: f"lower(translate({x}, '{I.ACCENTED}', '{I.PLAIN}'))"
_OUTER = "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$"
_PART = "list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
SEARCHED = f"""
tk AS (SELECT memory_id, store, body, {_low('body')} AS lb, {_PART.format(_FOLD('coalesce(body, chr(32))'))} AS ws FROM memory),
st AS (SELECT store, count(*) AS n, avg(len(ws)) AS av FROM tk GROUP BY store),
qt AS (SELECT ask, unnest(range(len(ts))) AS i, unnest(ts) AS term, len(ts) AS nt FROM (SELECT ask, list_filter(list_transform(regexp_split_to_array(query, '\\s+'),
  lambda t: regexp_replace(t, '{_OUTER}', '', 'g')), lambda t: t <> '' AND NOT list_contains({_list(T.QUERY_STOP_WORDS)}, {_low('t')})) AS ts FROM asked)),
dt AS (SELECT DISTINCT {_low('term')} AS term FROM qt),
pt AS (SELECT term, {_PART.format(_FOLD('term'))} AS ps, length(term) >= {I.MIN_PREFIX} AS open FROM dt),
tp AS (SELECT memory_id, store, len(ws) AS len, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM tk),
up AS (SELECT term, len(ps) AS m, unnest(range(len(ps))) AS k, unnest(ps) AS part, open FROM pt),
rw AS (SELECT term, m, k, w FROM up JOIN (SELECT DISTINCT w FROM tp) ON CASE WHEN open AND k = m - 1 THEN starts_with(w, part) ELSE w = part END),
ph AS (SELECT term, memory_id, store, len, m, pos - k AS pos FROM rw JOIN tp USING (w) GROUP BY term, memory_id, store, len, m, pos - k HAVING count(*) = m),
pp AS (SELECT term, memory_id, store, m, list(pos) AS places FROM ph GROUP BY term, memory_id, store, m),
cv AS (SELECT DISTINCT dt.term, tk.memory_id, tk.store FROM dt JOIN tk ON contains(lb, term)),
pl AS (SELECT term, memory_id, store, len(ws) AS len, m, coalesce(places, []) AS places, cv.term IS NOT NULL AS covered FROM pp FULL JOIN cv USING (term, memory_id, store) JOIN tk USING (memory_id, store)),
df AS (SELECT term, store, count(*) AS df FROM pl WHERE len(places) > 0 GROUP BY term, store),
wt AS (SELECT pl.*, CASE WHEN len(places) = 0 THEN 0.0 ELSE (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * len(places) * {I.K1 + 1}
  / (len(places) + {I.K1} * (1 - {I.B} + {I.B} * len / av)) END AS score FROM pl LEFT JOIN df USING (term, store) JOIN st USING (store)),
found AS (SELECT ask, memory_id, store, round(sum(score), 6) AS rank_score, CAST(greatest(1, round(sum(score) * 100)) AS BIGINT) AS score
  FROM qt JOIN wt ON wt.term = {_low('qt.term')} JOIN eligible USING (memory_id, store)
  GROUP BY ask, nt, memory_id, store HAVING max(len(places)) > 0 AND (nt < 3 OR sum(CAST(covered AS INT)) >= 2)),
hit AS (SELECT found.*, body FROM found JOIN tk USING (memory_id, store)),
inorder AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY store <> 'project', rank_score DESC, memory_id) AS rank FROM hit h WHERE store = 'project' OR NOT EXISTS
  (SELECT 1 FROM hit p WHERE p.ask = h.ask AND p.store = 'project' AND (p.memory_id = h.memory_id OR p.body = h.body)))"""
# and the passages of those hits
SHOWN = f"""
ins AS (SELECT ask, memory_id, store, rank, len, i, m, unnest(places) AS pos FROM inorder JOIN qt USING (ask) JOIN pl USING (memory_id, store) WHERE pl.term = {_low('qt.term')}),
cut AS (SELECT memory_id, store, regexp_extract_all(body, '[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}]+') AS cw, regexp_extract(body, '[^\\p{{L}}\\p{{N}}]*$') AS tail FROM (SELECT DISTINCT memory_id, store, body FROM inorder)),
sen AS (SELECT memory_id, store, unnest(list_filter(range(len(cw)), lambda k: k = 0 OR regexp_matches(cw[k + 1], '[.:][ \\t\\r\\n]+[\\p{{L}}\\p{{N}}]'))) AS pos FROM cut),
cnd AS (SELECT DISTINCT ask, memory_id, store, len, pos AS s, pos AS fp, 0 AS kind FROM ins UNION ALL
  SELECT ask, memory_id, store, len, s, min(fp), 1 FROM (SELECT ask, ins.memory_id, ins.store, len, max(sen.pos) AS s, ins.pos AS fp FROM ins JOIN sen ON sen.memory_id = ins.memory_id AND sen.store = ins.store AND sen.pos <= ins.pos
    WHERE len > {P.TOKENS} GROUP BY ALL) WHERE s < fp GROUP BY ALL),
scd AS (SELECT c.ask, c.memory_id, c.store, c.len, s, c.fp, kind, 999 * count(DISTINCT i) + count(*) + any_value(CASE WHEN kind = 0 THEN 0 WHEN s = 0 THEN {P.FIRST_SENTENCE} ELSE {P.SENTENCE} END) AS sc,
  max({{'p': ins.pos, 'i': i, 'm': m}}) AS l FROM cnd c JOIN ins ON ins.ask = c.ask AND ins.memory_id = c.memory_id AND ins.store = c.store AND ins.pos BETWEEN s AND s + {P.TOKENS - 1} GROUP BY c.ask, c.memory_id, c.store, c.len, s, c.fp, kind),
bst AS (SELECT *, CASE WHEN kind = 1 THEN s ELSE greatest(0, least(s - CAST(trunc(({P.TOKENS} - (l.p + l.m - s)) / 2) AS BIGINT), len - {P.TOKENS})) END AS b FROM scd
  QUALIFY row_number() OVER (PARTITION BY ask, memory_id, store ORDER BY sc DESC, fp, kind) = 1),
shown AS (SELECT inorder.*, CASE WHEN b > 0 THEN '{P.ELLIPSIS}' || regexp_replace(array_to_string(list_slice(cw, b + 1, b + {P.TOKENS}), ''), '^[^\\p{{L}}\\p{{N}}]+', '') ELSE array_to_string(list_slice(cw, 1, {P.TOKENS}), '') END
  || CASE WHEN b + {P.TOKENS} >= len THEN tail ELSE '{P.ELLIPSIS}' END AS snippet FROM inorder JOIN bst USING (ask, memory_id, store) JOIN cut USING (memory_id, store))"""
_OVERLAP = "CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / least(len(x), len(y)) ELSE 0.0 END"
ACCEPTED = f"""
ovl AS (SELECT ask, memory_id, store, rank, {_OVERLAP} AS overlap FROM (SELECT shown.*, {_TOKENS('query')} AS x, {_TOKENS('snippet')} AS y FROM shown JOIN asked USING (ask))),
acc AS (SELECT * FROM ovl QUALIFY row_number() OVER (PARTITION BY ask ORDER BY overlap DESC, rank) = 1)"""
_ACTIVE = "eligible AS (SELECT memory_id, store FROM memory WHERE status = 'active')"

# R2: the passages of one query's hits
_ONE = f"asked AS (SELECT 0 AS ask, '{B.QUERY}' AS query)"


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.memory(spark, sf).where("status = 'active'")
    asked = spark.createDataFrame([(0, B.QUERY)], "ask int, query string")
    hits = P.in_order(I.search(B.memory_index(spark, sf), asked, rows, few=True).join(rows.select(*NAMES), NAMES, "left_semi"), rows, NAMES)
    return P.passages(B.memory_index(spark, sf), asked, hits, rows).select("memory_id", "rank", "snippet")


query("R2_snippets", snippets, f"WITH {B.MEMORY}, {_ONE}, {_ACTIVE}, {SEARCHED}, {SHOWN} SELECT memory_id, rank, snippet FROM shown")

# R9, M15: review candidates (ids divisible by 100) against the accepted memories (all others that are active)
_CANDIDATES = f"""asked AS (SELECT memory_id AS ask, substring(summary, 1, {SUMMARY}) AS query FROM memory WHERE memory_id % 100 = 0),
eligible AS (SELECT memory_id, store FROM memory WHERE status = 'active' AND memory_id % 100 <> 0)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return B.memory(spark, sf).where("memory_id % 100 = 0").withColumn("ask", F.col("memory_id")).withColumn("query", F.substring("summary", 1, SUMMARY))


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.memory(spark, sf).where("status = 'active' and memory_id % 100 <> 0")
    return P.accepted_matches(B.memory_index(spark, sf), candidates(spark, sf).select("ask", "query"), rows)


_R9 = f"WITH {B.MEMORY}, {_CANDIDATES}, {SEARCHED}, {SHOWN}, {ACCEPTED}"
query("R9_accepted_match", lambda spark, sf: accepted(spark, sf).select("ask", "memory_id", "store", F.round("overlap", 6).alias("overlap"), "topic", "duplicate"),
    f"{_R9} SELECT ask, memory_id, store, round(overlap, 6) AS overlap, overlap >= {P.TOPIC} AS topic, overlap >= {P.DUPLICATE} AS duplicate FROM acc")


def review_items(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with what the search found: target, duplicate, conflict."""
    own = candidates(spark, sf).select("ask", "query", "confidence", (F.col("category") == "CandidateSkill").alias("sourced"), (~F.col("stale")).alias("general"))
    own = own.join(accepted(spark, sf).select("ask", F.when(F.col("topic"), F.col("memory_id")).alias("target"), F.col("duplicate").alias("_same")), "ask", "left")
    return own.withColumn("duplicate", F.coalesce("_same", F.lit(False))).withColumn("conflict", T.contradicts("query", F.col("target").isNotNull()))


_REVIEWED = f"""{_R9}, items AS (SELECT a.ask, a.query, m.confidence, m.category = 'CandidateSkill' AS sourced, NOT m.stale AS general, CASE WHEN overlap >= {P.TOPIC} THEN acc.memory_id END AS target, coalesce(overlap >= {P.DUPLICATE}, false) AS duplicate
  FROM asked a JOIN memory m ON m.memory_id = a.ask LEFT JOIN acc ON acc.ask = a.ask),
rv AS (SELECT *, CASE WHEN target IS NOT NULL THEN {_any(_low('query'), T.NEGATIONS)} ELSE {_any(_low('query'), ('contradict', 'no longer'))} END AS conflict FROM items)"""
_SURE = "confidence >= 0.82"
_REPLACES, _TAKES = f"conflict AND target IS NOT NULL AND general AND {_SURE}", "NOT conflict AND NOT duplicate AND general"
for _mode, _rule in (
    ("manual", "'manual'"),
    ("assisted", "CASE WHEN sourced THEN 'manual' ELSE 'annotate' END"),
    ("trusted", f"CASE WHEN sourced THEN 'manual' WHEN {_REPLACES} THEN 'supersede' WHEN {_TAKES} AND {_SURE} THEN 'accept' ELSE 'manual' END"),
    ("automatic", f"CASE WHEN sourced THEN 'manual' WHEN {_REPLACES} THEN 'supersede' WHEN {_TAKES} THEN 'accept' ELSE 'manual' END"),
):
    query(
        f"M15_review_{_mode}",
        lambda spark, sf, mode=_mode: V.decide(review_items(spark, sf), mode).select("ask", "target", "duplicate", "conflict", "decision"),
        f"{_REVIEWED} SELECT ask, target, duplicate, conflict, {_rule} AS decision FROM rv",
    )


# K22: skill drafts with the five memories related to each
def drafts(spark: SparkSession, sf: str) -> DataFrame:
    own = skill_items(spark, sf)
    wanted = E.skill_drafts(own).select("draft_id")
    asked = own.withColumn("draft_id", F.concat(F.lit("skill-"), F.col("id").cast("string"))).join(wanted, "draft_id").select(F.col("id").alias("ask"), F.substring("summary", 1, SUMMARY).alias("query"))
    rows = B.memory(spark, sf).where("status = 'active'")
    found = P.related(B.memory_index(spark, sf), asked, rows).select(F.concat(F.lit("skill-"), F.col("ask").cast("string")).alias("draft_id"), "related")
    return E.skill_drafts(own).join(found, "draft_id", "left").withColumn("related", F.array_join(F.coalesce("related", F.array().cast("array<bigint>")), ","))


query("K22_skill_drafts", drafts,
    f"WITH {B.MEMORY}, {_DRAFTS}, asked AS (SELECT memory_id AS ask, substring(summary, 1, {SUMMARY}) AS query FROM memory WHERE 'skill-' || memory_id IN (SELECT draft_id FROM dr)), {_ACTIVE}, {SEARCHED}, "
    "rl AS (SELECT 'skill-' || ask AS draft_id, string_agg(CAST(memory_id AS VARCHAR), ',' ORDER BY rank) AS related FROM inorder WHERE rank <= 5 GROUP BY ask) SELECT dr.*, coalesce(related, '') AS related FROM dr LEFT JOIN rl USING (draft_id)")  # fmt: skip

# A14, A19: passages of the benchmark asked for by their beginnings; found where a passage of the first five shows them
_K, _WINDOW = 5, 20
_CASES = f"asked AS (SELECT item_id AS ask, substring(text, 1, {SUMMARY}) AS query, lower(substring(text, 1, 24)) AS expected FROM benchmark)"


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """ask, rank, reranked, good: the first hits of each benchmark passage, by the search and by the overlap of their passages."""
    asked = B.read(spark, sf, "benchmark").select(F.col("item_id").alias("ask"), F.substring("text", 1, SUMMARY).alias("query"), F.lower(F.substring("text", 1, 24)).alias("expected"))
    rows = B.memory(spark, sf).where("status = 'active'")
    hits = P.first_hits(B.memory_index(spark, sf), asked.select("ask", "query"), rows, _WINDOW)
    shown = P.passages(B.memory_index(spark, sf), asked.select("ask", "query"), settle(hits, "first"), rows, few=True).join(asked, "ask")
    overlap = T.overlap(T.token_set("query"), T.token_set(F.coalesce("snippet", F.lit(""))))
    good = F.contains(F.lower(F.coalesce("snippet", F.lit(""))), F.col("expected"))
    return V.best_first(shown.select("ask", "rank", overlap.alias("overlap"), good.alias("good")), "ask", "overlap", "rank", "reranked")


def recall(spark: SparkSession, sf: str, by: str) -> DataFrame:
    asked = B.read(spark, sf, "benchmark").select(F.col("item_id").alias("ask"))
    hit = cases(spark, sf).where(F.col(by) <= _K).groupBy("ask").agg(F.max("good").alias("found"))
    return asked.join(hit, "ask", "left").select("ask", F.coalesce("found", F.lit(False)).alias("found"))


_RANKED = f"""WITH {B.MEMORY}, {_CASES}, {_ACTIVE}, {SEARCHED}, {SHOWN},
cs AS (SELECT ask, rank, {_OVERLAP} AS overlap, contains(lower(snippet), expected) AS good FROM (SELECT shown.*, expected, {_TOKENS('query')} AS x, {_TOKENS('snippet')} AS y FROM shown JOIN asked USING (ask) WHERE rank <= {_WINDOW})),
rr AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY overlap DESC, rank) AS reranked FROM cs),
rc AS (SELECT asked.ask, coalesce(bool_or(good) FILTER (rank <= {_K}), false) AS found, coalesce(bool_or(good) FILTER (reranked <= {_K}), false) AS found2 FROM asked LEFT JOIN rr USING (ask) GROUP BY asked.ask)"""
query("A14_recall_at_k", lambda spark, sf: recall(spark, sf, "rank"), f"{_RANKED} SELECT ask, found FROM rc")


def lift(spark: SparkSession, sf: str) -> DataFrame:
    own = cases(spark, sf).groupBy("ask").agg(*[F.max((F.col(by) <= _K) & F.col("good")).alias(by) for by in ("rank", "reranked")])
    own = B.read(spark, sf, "benchmark").select(F.col("item_id").alias("ask")).join(own, "ask", "left")
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("int")), F.lit(1.0))
    return own.agg(F.round(share("rank"), 6).alias("baseline"), F.round(share("reranked") - share("rank"), 6).alias("lift"))


query("A19_eval_lift", lift, f"{_RANKED} SELECT round(coalesce(avg(CAST(found AS INT)), 1.0), 6) AS baseline, round(coalesce(avg(CAST(found2 AS INT)), 1.0) - coalesce(avg(CAST(found AS INT)), 1.0), 6) AS lift FROM rc")


# M37: vectors of all memories; those of contradicted ones are out of date, and the embedder stumbles over junk
_JUNK = "%%%"


def _embedder(texts: list[str]) -> list[list[float]]:
    """A stand-in for a service: letters and line breaks; it refuses calls with junk."""
    if any(_JUNK in t for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), float(t.count("\n"))] for t in texts]


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.memory(spark, sf).select(F.lit("memory").alias("kind"), F.col("memory_id").alias("id"), F.col("body").alias("text"), "contradicted")
    print_ = F.when(F.col("contradicted"), "old").otherwise(F.md5(F.col("text").cast("binary")))
    held = B.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    stored = rows.join(held, "id").select("kind", "id", print_.alias("fingerprint"), F.lit("m1").alias("model"), F.size("vector").cast("long").alias("dimensions"), "vector")
    new, audit = X.refreshed(stored, rows, _embedder, "m2")
    own = new.select("id", "model", "dimensions", F.when(F.col("model") == "m2", F.element_at("vector", 1)).alias("letters"))
    return rows.select("id").join(own, "id", "left").join(audit.select("id", "ok", "error"), "id", "left")


query("M37_refresh_vectors", vectors, f"""WITH {B.MEMORY}, h AS (SELECT memory_id AS id, body, contains(body, '{_JUNK}') AS junk, len(embedding) AS dims, vec_id IS NOT NULL AND NOT contradicted AS fresh FROM memory LEFT JOIN embeddings ON vec_id = memory_id)
SELECT id, CASE WHEN NOT fresh AND NOT junk THEN 'm2' WHEN dims IS NOT NULL THEN 'm1' END AS model, CASE WHEN NOT fresh AND NOT junk THEN 2 ELSE dims END AS dimensions,
  CASE WHEN NOT fresh AND NOT junk THEN CAST(length(body) AS DOUBLE) END AS letters, CASE WHEN NOT fresh THEN NOT junk END AS ok, CASE WHEN NOT fresh AND junk THEN 'refused' END AS error FROM h""")
