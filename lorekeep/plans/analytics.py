"""Filters, joins, aggregates, rankings, set operations and state changes over the bound tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import hashing as H
from lorekeep.functions import text as T
from lorekeep.operators import state as S

from . import bindings as B
from .texts import _CANON, _FAIL, _any, _cmd, _group, _lesson, _low, _strip

QUERIES, ORACLES = {}, {}
M, L = B.MEMORY, B.LINES
ACTIVE = "status = 'active'"


def query(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def memory_query(name: str, run, sql: str) -> None:
    """``run`` takes the memory table; ``sql`` selects from memory."""
    query(name, lambda spark, sf: run(B.memory(spark, sf)), f"WITH {M} {sql}")


# sources and scans
memory_query("IO15_scan_order", lambda m: m.where(ACTIVE).select("memory_id", "store", F.when(F.col("store") == "project", 0).otherwise(1).alias("store_rank"), "created_at"),
    f"SELECT memory_id, store, CASE WHEN store = 'project' THEN 0 ELSE 1 END AS store_rank, created_at FROM memory WHERE {ACTIVE}")
query(
    "IO14_audit_rows",
    lambda spark, sf: B.read(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), F.concat(F.lit("u"), "user_id").alias("actor"), F.get_json_object("props", "$.k").cast("long").alias("k")),
    "SELECT event_id, event_type AS kind, 'u' || user_id AS actor, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
query("IO16_newest_audit", lambda spark, sf: B.read(spark, sf, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(100), "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")

# filters
memory_query("F1_language_filter", lambda m: m.where((F.col("language") == "de") | F.col("language").isNull()).select("memory_id", "language"), "SELECT memory_id, language FROM memory WHERE language = 'de' OR language IS NULL")
memory_query("F2_never_retrieved", lambda m: m.where(f"{ACTIVE} and hit_count = 0").select("memory_id"), f"SELECT memory_id FROM memory WHERE {ACTIVE} AND hit_count = 0")
memory_query("F3_stale", lambda m: m.where(f"{ACTIVE} and stale").select("memory_id", "store"), f"SELECT memory_id, store FROM memory WHERE {ACTIVE} AND stale")
memory_query("F4_facet_filter", lambda m: m.where((F.lower("category") == "process") & (F.lower("store") == "project")).select("memory_id"), "SELECT memory_id FROM memory WHERE lower(category) = 'process' AND lower(store) = 'project'")
query("F5_symbol_search", lambda spark, sf: B.nodes(spark, sf).where(F.col("kind").isin("function", "type") & F.contains(F.lower("name"), F.lit("1"))).orderBy(F.when(F.col("kind") == "function", 0).otherwise(1), "node").limit(50).select("node", "kind"),
    f"WITH {B.NODES} SELECT node, kind FROM nodes WHERE kind IN ('function', 'type') AND contains(lower(name), '1') ORDER BY CASE WHEN kind = 'function' THEN 0 ELSE 1 END, node LIMIT 50")
query("F6_find_symbol", lambda spark, sf: B.nodes(spark, sf).where("name = 'FRANCE' or node = 'n7'").select("node", "name"), f"WITH {B.NODES} SELECT node, name FROM nodes WHERE name = 'FRANCE' OR node = 'n7'")
query("F8_nodes_by_kind", lambda spark, sf: B.nodes(spark, sf).where("kind = 'type'").select("node", "name"), f"WITH {B.NODES} SELECT node, name FROM nodes WHERE kind = 'type'")
memory_query("F10_sync_scope", lambda m: m.where(F.coalesce(F.when(F.col("memory_id") % 11 == 0, F.lit("local")), F.when(F.col("store") == "global", F.lit("sync")).otherwise("sync_annotated")).isin("sync", "sync_annotated")).select("memory_id"),
    "SELECT memory_id FROM memory WHERE coalesce(CASE WHEN memory_id % 11 = 0 THEN 'local' END, CASE WHEN store = 'global' THEN 'sync' ELSE 'sync_annotated' END) IN ('sync', 'sync_annotated')")
memory_query("F11_bundle_scope", lambda m: m.where(ACTIVE).where(F.col("store").isin("global")).select("memory_id"), f"SELECT memory_id FROM memory WHERE {ACTIVE} AND store IN ('global')")
memory_query("F12_tool_staleness", lambda m: m.where((F.col("category") == "ToolUse") & (F.lit(7) > F.col("hit_count"))).select("memory_id"), "SELECT memory_id FROM memory WHERE category = 'ToolUse' AND 7 > hit_count")
memory_query("F13_trajectory_gate", lambda m: m.where("not stale and not contradicted and hit_count > 2").select("memory_id", F.lit("ToolUse").alias("category")), "SELECT memory_id, 'ToolUse' AS category FROM memory WHERE NOT stale AND NOT contradicted AND hit_count > 2")
memory_query(
    "F14_validation",
    lambda m: m.withColumn("n", F.count("*").over(Window.partitionBy(T.ascii_lower("summary")))).select("memory_id", F.when(F.trim("summary") == "", "summary is required").when(F.col("confidence") < 0.5, "confidence is below 0.5").when(F.col("n") > 1, "duplicate candidate summary").alias("error")).where("error is not null"),
    f"SELECT memory_id, error FROM (SELECT memory_id, CASE WHEN trim(summary) = '' THEN 'summary is required' WHEN confidence < 0.5 THEN 'confidence is below 0.5' WHEN count(*) OVER (PARTITION BY {_low('summary')}) > 1 THEN 'duplicate candidate summary' END AS error FROM memory) WHERE error IS NOT NULL",
)
memory_query("F16_review_list", lambda m: m.where("category = 'Process'").select("memory_id", "created_at"), "SELECT memory_id, created_at FROM memory WHERE category = 'Process'")

# aggregates
query("A1_doc_chunks", lambda spark, sf: B.read(spark, sf, "documents").select("source", F.explode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("c")).groupBy("source").agg(F.count("*").alias("chunks")),
    "SELECT source, count(*) AS chunks FROM (SELECT source, unnest(string_split(text, chr(10))) AS c FROM documents) WHERE trim(c) <> '' GROUP BY source")
query("A2_counts", lambda spark, sf: B.read(spark, sf, "embeddings").agg(F.count("*").alias("vectors"), F.count_distinct("label").alias("models")), "SELECT count(*) AS vectors, count(DISTINCT label) AS models FROM embeddings")
query("A3_models", lambda spark, sf: B.read(spark, sf, "embeddings").select("label").distinct(), "SELECT DISTINCT label FROM embeddings")


def _facets(m):
    facets = F.array(*[F.struct(F.lit(k).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("(agnostic)")).alias("value")) for k, c in (("scope", "store"), ("category", "category"), ("language", "language"), ("status", "status"), ("stale", "stale"), ("conflict", "contradicted"))])
    return m.select(F.inline(facets)).groupBy("facet", "value").agg(F.count("*").alias("n"))


memory_query("A4_facets", _facets, " UNION ALL ".join(
    f"SELECT '{k}' AS facet, coalesce(CAST({c} AS VARCHAR), '(agnostic)') AS value, count(*) AS n FROM memory GROUP BY 2"
    for k, c in (("scope", "store"), ("category", "category"), ("language", "language"), ("status", "status"), ("stale", "stale"), ("conflict", "contradicted"))))
memory_query("A5_dashboard", lambda m: m.groupBy("store", "category").agg(F.count_if(F.col("status") == "active").alias("accepted"), F.count_if(F.col("status") != "active").alias("other")),
    f"SELECT store, category, count(*) FILTER ({ACTIVE}) AS accepted, count(*) FILTER (status <> 'active') AS other FROM memory GROUP BY store, category")
_STATES = ("pending", "accepted", "rejected", "deferred", "edited", "merged")
_state = lambda: F.element_at(F.array(*map(F.lit, _STATES)), (F.col("memory_id") % 6).cast("int") + 1)
memory_query("A6_queue_states", lambda m: m.select(_state().alias("state")).agg(*[F.count_if(F.col("state") == s).alias(s) for s in _STATES[:5]]),
    "SELECT " + ", ".join(f"count(*) FILTER (memory_id % 6 = {i}) AS {s}" for i, s in enumerate(_STATES[:5])) + " FROM memory")
memory_query("A7_status", lambda m: m.agg(F.count_if((F.col("store") == "project") & (F.col("status") == "active")).alias("project"), F.count_if((F.col("store") == "global") & (F.col("status") == "active")).alias("machine"), F.sum("hit_count").alias("hits")),
    f"SELECT count(*) FILTER (store = 'project' AND {ACTIVE}) AS project, count(*) FILTER (store = 'global' AND {ACTIVE}) AS machine, CAST(sum(hit_count) AS BIGINT) AS hits FROM memory")
memory_query("A17_grouped_proposals", lambda m: m.where("category = 'CandidateSkill'").groupBy("source_session").agg(F.sort_array(F.collect_list("memory_id")).alias("ids")),
    "SELECT source_session, list(memory_id ORDER BY memory_id) AS ids FROM memory WHERE category = 'CandidateSkill' GROUP BY source_session")
memory_query("A20_sorted_counts", lambda m: m.groupBy("language").agg(F.count("*").alias("n")), "SELECT language, count(*) AS n FROM memory GROUP BY language")
query("A12_repeated_commands", lambda spark, sf: S.first_per(B.lines(spark, sf).select("session", "line_no", T.command_text("line").alias("command")).where("octet_length(command) >= 8").withColumn("k", F.row_number().over(Window.partitionBy("session", "command").orderBy("line_no"))).where("k = 2").drop("k"), ["session"], ["line_no"], 5).select("session", "command"),
    f"WITH {L}, c AS (SELECT session, line_no, {_cmd('line')} AS command FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY session, command ORDER BY line_no) AS k FROM c WHERE strlen(command) >= 8) "
    "SELECT session, command FROM (SELECT session, command, row_number() OVER (PARTITION BY session ORDER BY line_no) AS n FROM r WHERE k = 2) WHERE n <= 5")  # fmt: skip

# rankings
memory_query("K1_most_used", lambda m: m.where(ACTIVE).orderBy(F.desc("hit_count"), "memory_id").limit(10).select("memory_id", "hit_count"), f"SELECT memory_id, hit_count FROM memory WHERE {ACTIVE} ORDER BY hit_count DESC, memory_id LIMIT 10")
_age = lambda: F.datediff(F.lit("2025-01-01").cast("date"), F.col("created_at"))
_AGE = "date_diff('day', created_at, DATE '2025-01-01')"
memory_query("K2_temporal", lambda m: m.select("memory_id", F.round(H.temporal_score(_age()), 6).alias("temporal")), f"SELECT memory_id, round(CASE WHEN {_AGE} <= 0 THEN 1.0 ELSE exp(-ln(2) / 30.0 * {_AGE}) END, 6) AS temporal FROM memory")
memory_query("K3_proximity", lambda m: m.select("memory_id", H.proximity_score(F.when(F.col("hit_count") < 8, F.col("hit_count"))).alias("proximity")), "SELECT memory_id, CASE WHEN hit_count < 8 THEN pow(0.5, hit_count) ELSE 0.0 END AS proximity FROM memory")
memory_query("K4_blend", lambda m: m.select("memory_id", F.round(H.Weights().blend(F.col("confidence"), H.temporal_score(_age()), 1 - 1 / (1 + F.col("hit_count"))), 6).alias("score")),
    f"SELECT memory_id, round(0.4 * confidence + 0.3 * CASE WHEN {_AGE} <= 0 THEN 1.0 ELSE exp(-ln(2) / 30.0 * {_AGE}) END + 0.3 * (1 - 1 / (1.0 + hit_count)), 6) AS score FROM memory")
_TERMS = ("locks", "service", "zz")
query("K5_term_match", lambda spark, sf: B.memory(spark, sf).select("memory_id", F.round(sum((F.contains(T.ascii_lower("summary"), F.lit(t)).cast("int") for t in _TERMS), F.lit(0)) / len(_TERMS), 6).alias("share")),
    f"WITH {M} SELECT memory_id, round((" + " + ".join(f"CAST(contains({_low('summary')}, '{t}') AS INT)" for t in _TERMS) + f") / {len(_TERMS)}.0, 6) AS share FROM memory")
memory_query("K6_intent", lambda m: m.select("memory_id", F.round(1 - 1 / (1 + F.col("hit_count")), 6).alias("intent")), "SELECT memory_id, round(1 - 1 / (1.0 + hit_count), 6) AS intent FROM memory")
_TIER = "(" + _group(T.TIERS, "1") + ")"
_BUCKET = "(CASE WHEN hit_count <= 0 THEN 0 WHEN hit_count = 1 THEN 1 WHEN hit_count <= 3 THEN 2 WHEN hit_count <= 7 THEN 3 ELSE 4 END)"


def primer(m, limit: int = 12, budget: int = 12_288):
    """The most salient memories: three quarters project, one quarter global, then backfilled, within a byte budget."""
    limit = max(1, min(20, limit))
    bucket = F.when(F.col("hit_count") <= 0, 0).when(F.col("hit_count") == 1, 1).when(F.col("hit_count") <= 3, 2).when(F.col("hit_count") <= 7, 3).otherwise(4)
    own = m.where(f"{ACTIVE} and not stale and not contradicted").withColumn("score", T.by_group(F.col("category"), T.TIERS, 1) * 10 + bucket)
    order = [F.desc("score"), F.desc("created_at"), "memory_id"]
    top = None
    for store in ("project", "global"):  # each store's first rows, found without a window over the table
        part = own.where(F.col("store") == store).orderBy(*order).limit(limit)
        top = part if top is None else top.unionAll(part)
    quota = F.when(F.col("store") == "global", limit // 4).otherwise(limit - limit // 4)
    ranked = top.withColumn("rn", F.row_number().over(Window.partitionBy("store").orderBy(*order)))
    ranked = ranked.withColumn("turn", F.when(F.col("rn") <= quota, 0).when(F.col("store") == "project", 1).otherwise(2))
    chosen = ranked.orderBy("turn", "rn").limit(limit)
    line = F.concat(F.lit("- `"), F.col("memory_id").cast("string"), F.lit("` ["), F.col("store"), F.lit(" · "), F.col("category"), F.lit("] "), T.first_paragraph("body"), F.lit("\n"))
    run = chosen.withColumn("bytes", F.sum(F.octet_length(line)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("bytes") <= budget).select("memory_id", "store", "score")


memory_query("K8_primer", primer,
    f", own AS (SELECT *, {_TIER} * 10 + {_BUCKET} AS score FROM memory WHERE {ACTIVE} AND NOT stale AND NOT contradicted), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY score DESC, created_at DESC, memory_id) AS rn FROM own), "
    "tn AS (SELECT *, CASE WHEN rn <= CASE WHEN store = 'global' THEN 3 ELSE 9 END THEN 0 WHEN store = 'project' THEN 1 ELSE 2 END AS turn FROM rk) "
    "SELECT memory_id, store, score FROM (SELECT * FROM tn ORDER BY turn, rn LIMIT 12)")  # fmt: skip
query("K9_freshness_pass", lambda spark, sf: S.freshness(B.memory(spark, sf), F.lit("2025-01-01").cast("date")).select("memory_id", "reason"))
memory_query("K10_freshness_age", lambda m: m.select("memory_id", F.when((_age() >= 180) & T.version_sensitive("summary"), "VersionSensitive").when((F.col("hit_count") == 0) & (_age() >= 90), "Unused").when(_age() >= 365, "Age").alias("reason")),
    f"SELECT memory_id, CASE WHEN {_AGE} >= 180 AND ({_any(_low('summary'), T.VERSION_MARKERS)} OR regexp_matches(summary, '(^|[^A-Za-z0-9.])[vV]?[0-9]+\\.[0-9]+($|[^A-Za-z0-9])')) THEN 'VersionSensitive' WHEN hit_count = 0 AND {_AGE} >= 90 THEN 'Unused' WHEN {_AGE} >= 365 THEN 'Age' END AS reason FROM memory")
memory_query("A11_freshness_counts", lambda m: m.where(f"{ACTIVE} and not stale").select(F.when((F.col("hit_count") == 0) & (_age() >= 90), "Unused").when(_age() >= 365, "Age").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
    f"SELECT CASE WHEN hit_count = 0 AND {_AGE} >= 90 THEN 'Unused' WHEN {_AGE} >= 365 THEN 'Age' END AS reason, count(*) AS n FROM memory WHERE {ACTIVE} AND NOT stale GROUP BY 1")
query("K15_user_corrections", lambda spark, sf: B.lines(spark, sf).where(T.starts_any(T.ascii_lower("line"), ("user:",))).withColumn("rest", F.trim(F.substr(F.col("line"), F.lit(6)))).where(T.starts_any(T.ascii_lower("rest"), T.CORRECTIONS) & T.lesson_like("rest")).select("session", "line_no", F.concat(F.lit("User correction: "), T.truncate("rest")).alias("summary")),
    f"WITH {L}, r AS (SELECT session, line_no, trim(substring(line, 6)) AS rest FROM lines WHERE starts_with({_low('line')}, 'user:')) SELECT session, line_no, 'User correction: ' || CASE WHEN length(rest) > 120 THEN substring(rest, 1, 120) || '…' ELSE rest END AS summary FROM r "
    "WHERE (" + " OR ".join(f"starts_with({_low('rest')}, '{m.replace(chr(39), chr(39) * 2)}')" for m in T.CORRECTIONS) + f") AND {_lesson('rest')}")  # fmt: skip
_SECTIONS = {"progress": ("fixed", "implemented", "passed"), "decisions": ("decided", "prefer", "instead"), "commands": ("failed", "error"), "risks": ("blocked", "risk"), "next_steps": ("next", "todo", "pending")}


def digest(lines):
    """Up to five lines of each keyword section of a session."""
    low = T.ascii_lower("line")
    flags = [F.when(T.has_any(low, ws) | (T.command_text("line").isNotNull() if k == "commands" else F.lit(False)), F.lit(k)) for k, ws in _SECTIONS.items()]
    rows = lines.select("session", "line_no", "line", F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("section"))
    return S.first_per(rows, ["session", "section"], ["line_no"], 5).select("session", "section", "line_no", T.truncate(T.strip_speaker("line")).alias("item"))


query("K16_digest", lambda spark, sf: digest(B.lines(spark, sf)), f"WITH {L}, f AS (" + " UNION ALL ".join(
    f"SELECT session, line_no, line, '{k}' AS section FROM lines WHERE {_any(_low('line'), ws)}" + (f" OR {_cmd('line')} IS NOT NULL" if k == "commands" else "") for k, ws in _SECTIONS.items())
    + f"), n AS (SELECT *, row_number() OVER (PARTITION BY session, section ORDER BY line_no) AS k FROM f) SELECT session, section, line_no, CASE WHEN length({_strip('line')}) > 120 THEN substring({_strip('line')}, 1, 120) || '…' ELSE {_strip('line')} END AS item FROM n WHERE k <= 5")
query("K17_key_points", lambda spark, sf: S.first_per(B.lines(spark, sf).where("line <> ''"), ["session"], ["line_no"], 5).select("session", "line_no", "line"),
    f"WITH {L} SELECT session, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line_no) AS k FROM lines WHERE line <> '') WHERE k <= 5")
memory_query("K18_corpus_budget", lambda m: S.budgeted(m, "memory_id", F.char_length("body"), ["-hit_count", "memory_id"], 32000),
    ", t AS (SELECT *, sum(length(body)) OVER (ORDER BY hit_count DESC, memory_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY hit_count DESC, memory_id) AS rn FROM memory) SELECT memory_id, CAST(run AS BIGINT) AS run FROM t WHERE rn = 1 OR run <= 32000")
memory_query("K19_revalidation_sample", lambda m: m.where(T.version_sensitive("summary") & ~F.col("stale")).orderBy("memory_id").limit(10).select("memory_id"),
    f"SELECT memory_id FROM memory WHERE ({_any(_low('summary'), T.VERSION_MARKERS)} OR regexp_matches(summary, '(^|[^A-Za-z0-9.])[vV]?[0-9]+\\.[0-9]+($|[^A-Za-z0-9])')) AND NOT stale ORDER BY memory_id LIMIT 10")
query("F_failure_lines", lambda spark, sf: B.lines(spark, sf).where(T.failure_line("line") & T.lesson_like(T.strip_speaker("line"))).select("session", "line_no"), f"WITH {L} SELECT session, line_no FROM lines WHERE {_FAIL} AND {_lesson(_strip('line'))}")

# joins on review states
query("J5_promoted_flag", lambda spark, sf: B.memory(spark, sf).select("memory_id").join(B.read(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("memory_id"), F.lit(True).alias("_p")).distinct(), "memory_id", "left").select("memory_id", F.col("_p").isNotNull().alias("promoted")),
    f"WITH {M} SELECT memory_id, memory_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS promoted FROM memory")
query("J6_awaiting_promotion", lambda spark, sf: (m := B.memory(spark, sf)).where("category <> 'Process'").join(m.where("hit_count > 4").select("memory_id"), "memory_id", "left_anti").select("memory_id"),
    f"WITH {M} SELECT memory_id FROM memory WHERE category <> 'Process' AND memory_id NOT IN (SELECT memory_id FROM memory WHERE hit_count > 4)")

# state changes
_other = lambda m: m.select((F.col("memory_id") + 500).alias("memory_id"), *[c for c in m.columns if c not in ("memory_id", "hit_count")], (F.col("hit_count") + 100).alias("hit_count"))
query("M1_upsert", lambda spark, sf: S.upsert(m := B.memory(spark, sf).select("memory_id", "category", "hit_count", "created_at"), _other(m).select(m.columns), "memory_id", ("hit_count", "created_at")),
    f"WITH {M}, n AS (SELECT memory_id + 500 AS memory_id, category, hit_count + 100 AS hit_count, created_at FROM memory) SELECT coalesce(o.memory_id, n.memory_id) AS memory_id, coalesce(n.category, o.category) AS category, coalesce(o.hit_count, n.hit_count) AS hit_count, coalesce(o.created_at, n.created_at) AS created_at FROM memory o FULL JOIN n ON o.memory_id = n.memory_id")
query("M4_supersede", lambda spark, sf: S.mark(B.memory(spark, sf).select("memory_id", "status"), B.read(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("memory_id")), "memory_id", "status", F.lit("superseded")),
    f"WITH {M} SELECT memory_id, CASE WHEN memory_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'superseded' ELSE status END AS status FROM memory")
query("M5_delete", lambda spark, sf: S.delete(B.memory(spark, sf).select("memory_id"), B.read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("memory_id")), "memory_id"),
    f"WITH {M} SELECT memory_id FROM memory WHERE memory_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
query("M8_bump_usage", lambda spark, sf: S.bump_usage(B.memory(spark, sf).select("memory_id", "status", "hit_count"), B.read(spark, sf, "events").select(F.col("user_id").alias("memory_id"))).select("memory_id", "hit_count"),
    f"WITH {M} SELECT memory_id, hit_count + CASE WHEN {ACTIVE} AND memory_id IN (SELECT user_id FROM events) THEN 1 ELSE 0 END AS hit_count FROM memory")
query("M9_flag_stale", lambda spark, sf: S.mark(B.memory(spark, sf).select("memory_id", "stale"), B.memory(spark, sf).where("hit_count = 0"), "memory_id", "stale", F.lit(True)), f"WITH {M} SELECT memory_id, stale OR hit_count = 0 AS stale FROM memory")
_ENT = lambda m: m.where("category in ('Process', 'ToolUse', 'CodePattern')").select("memory_id", F.concat(F.col("source_session"), F.lit("/"), F.col("category")).alias("entity"))
_said = lambda spark, sf: B.memory(spark, sf).where("memory_id % 10 = 3").select("memory_id", (F.col("memory_id") + 7).alias("target"))
query("M6_contradictions", lambda spark, sf: S.all_contradictions((m := B.memory(spark, sf)), _ENT(m), _said(spark, sf)),
    f"WITH {M}, e AS (SELECT memory_id, source_session || '/' || category AS entity FROM memory WHERE category IN ('Process', 'ToolUse', 'CodePattern')), p AS (SELECT memory_id, {_any(_low('body'), T.PROHIBITIONS)} AS no FROM memory WHERE {ACTIVE}), "
    "s AS (SELECT memory_id, memory_id + 7 AS target FROM memory WHERE memory_id % 10 = 3) "
    "SELECT DISTINCT a.memory_id, b.memory_id AS target FROM e a JOIN p pa ON a.memory_id = pa.memory_id JOIN e b ON a.entity = b.entity JOIN p pb ON b.memory_id = pb.memory_id WHERE pa.no <> pb.no UNION SELECT memory_id, target FROM s UNION SELECT target, memory_id FROM s")  # fmt: skip
query("M6_flags", lambda spark, sf: S.mark((m := B.memory(spark, sf)).select("memory_id", "status", "contradicted"), S.contradicted_ids(m, _ENT(m), _said(spark, sf)).join(m.where(ACTIVE).select("memory_id"), "memory_id", "left_semi"), "memory_id", "contradicted", F.lit(True)).select("memory_id", "contradicted"),
    f"WITH x AS ({ORACLES['M6_contradictions']}), {M} SELECT memory_id, contradicted OR (status = 'active' AND memory_id IN (SELECT memory_id FROM x)) AS contradicted FROM memory")
query("M7_relationships", lambda spark, sf: S.relationships(B.memory(spark, sf).withColumn("related_files", F.array(F.concat(F.lit("f"), F.col("memory_id") % 7))).withColumn("related_entities", F.array(F.lit("x"), F.lit("x")))),
    f"WITH {M} SELECT memory_id, 'category' AS relation_kind, category AS target FROM memory UNION SELECT memory_id, 'session', source_session FROM memory UNION SELECT memory_id, 'file', 'f' || (memory_id % 7) FROM memory UNION SELECT memory_id, 'entity', 'x' FROM memory")
query("M10_replace_chunks", lambda spark, sf: S.replace_by_path((d := B.read(spark, sf, "documents").select(F.col("source").alias("path"), "doc_id", F.lit("old").alias("age"))), d.where("path in ('src1', 'src2')").withColumn("age", F.lit("new"))),
    "SELECT source AS path, doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE 'old' END AS age FROM documents")
query("M12_exact_enqueue", lambda spark, sf: B.memory(spark, sf).groupBy(T.canonical("body").alias("c")).agg(F.min("memory_id").alias("memory_id"), F.count("*").alias("seen_count")).select("memory_id", "seen_count"),
    f"WITH {M} SELECT min(memory_id) AS memory_id, count(*) AS seen_count FROM memory GROUP BY {_CANON('body')}")
query("M14_decide", lambda spark, sf: S.decide(B.memory(spark, sf).select(F.col("memory_id").alias("id"), F.lit("pending").alias("state")), B.memory(spark, sf).where("hit_count > 2").select(F.col("memory_id").alias("id"), F.when(F.col("hit_count") % 2 == 0, "accept").otherwise("edit").alias("action"), F.when(F.col("hit_count") == 5, "new").alias("replacement"))),
    f"WITH {M} SELECT memory_id AS id, CASE WHEN hit_count <= 2 THEN 'pending' WHEN hit_count % 2 = 0 THEN 'accepted' WHEN hit_count = 5 THEN 'edited' ELSE 'pending' END AS state, CASE WHEN hit_count > 2 AND hit_count % 2 = 1 AND hit_count <> 5 THEN 'replacement text is required' END AS error FROM memory")
memory_query("M16_purge_pending", lambda m: m.where(_state() != "pending").select("memory_id"), "SELECT memory_id FROM memory WHERE memory_id % 6 <> 0")
memory_query("M18_annotate", lambda m: m.select("memory_id", (c := T.has_any(T.ascii_lower("summary"), ("instead", "do not", "don't", "wrong"))).alias("conflict"), F.when(c, "SupersedeExisting").when(F.contains("summary", F.lit("; ")) | (F.regexp_count(T.ascii_lower("summary"), F.lit(" and ")) >= 2), "Split").otherwise("PromoteToMemory").alias("suggested"), (F.col("confidence") < 0.6).alias("low_confidence")),
    f"SELECT memory_id, {_any(_low('summary'), ('instead', 'do not', chr(100) + 'on' + chr(39) + 't', 'wrong'))} AS conflict, CASE WHEN {_any(_low('summary'), ('instead', 'do not', chr(100) + 'on' + chr(39) + 't', 'wrong'))} THEN 'SupersedeExisting' WHEN contains(summary, '; ') OR len(regexp_extract_all({_low('summary')}, ' and ')) >= 2 THEN 'Split' ELSE 'PromoteToMemory' END AS suggested, confidence < 0.6 AS low_confidence FROM memory")
query("M21_supersede_paths", lambda spark, sf: S.supersede_paths(B.nodes(spark, sf).select("node", F.col("shard").cast("string").alias("path"), F.lit(None).cast("string").alias("superseded_at")), spark.sql("select '3' as path"), F.lit("now")).select("node", "superseded_at"),
    f"WITH {B.NODES} SELECT node, CASE WHEN shard = 3 THEN 'now' END AS superseded_at FROM nodes")
query("M22_revive_edges", lambda spark, sf: S.revive_edges(B.edges(spark, sf).withColumn("superseded_at", F.lit("x")), B.nodes(spark, sf).withColumn("superseded_at", F.when(F.col("shard") == 1, "x"))).select("src", "dst", "kind", "superseded_at"),
    f"WITH {B.NODES}, {B.EDGES}, live AS (SELECT node FROM nodes WHERE shard <> 1) SELECT src, dst, kind, CASE WHEN NOT (src IN (SELECT node FROM live) AND dst IN (SELECT node FROM live)) THEN 'x' END AS superseded_at FROM edges")
query("M23_reindex_plan", lambda spark, sf: S.reindex_plan((d := B.read(spark, sf, "documents")).where("source <> 'src3'").select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash")), d.where("source <> 'src4'").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("source") == "src5", F.upper("text")).otherwise(F.col("text"))).alias("content_hash"))),
    "SELECT doc_id AS path, CASE WHEN source = 'src4' THEN 'prune' WHEN source = 'src3' THEN 'index' WHEN source = 'src5' AND upper(text) <> text THEN 'index' ELSE 'unchanged' END AS action FROM documents")
_ver = lambda m: m.select("memory_id", "status", "store", F.substring(F.sha2(F.col("category").cast("binary"), 256), 1, 16).alias("version"))
query("M25_cursor_diff", lambda spark, sf: S.cursor_diff(m := _ver(B.memory(spark, sf)), m.where("store = 'project'").select("memory_id", F.when(F.col("status") != "active", F.col("version")).when(F.col("version") > "8", F.col("version")).otherwise("old").alias("version"))),
    f"WITH {M} SELECT memory_id, op FROM (SELECT memory_id, CASE WHEN status <> 'active' THEN CASE WHEN store = 'project' THEN 'supersede' END WHEN store <> 'project' THEN 'create' WHEN substr(sha256(category), 1, 16) <= '8' THEN 'update' END AS op FROM memory) WHERE op IS NOT NULL")
query("M26_route_ops", lambda spark, sf: S.route_ops((m := _ver(B.memory(spark, sf))).select(F.col("memory_id").alias("op_id"), (F.col("memory_id") * 2).alias("memory_id"), F.when(F.col("memory_id") % 5 == 0, "supersede").otherwise("upsert").alias("kind"), "version"), m, B.memory(spark, sf).where("hit_count = 7").select(F.col("memory_id").alias("op_id"))),
    f"WITH {M} SELECT a.memory_id AS op_id, CASE WHEN a.hit_count = 7 THEN 'skip' WHEN a.memory_id % 5 = 0 THEN CASE WHEN b.memory_id IS NOT NULL THEN 'flag' ELSE 'skip' END WHEN b.memory_id IS NULL THEN 'candidate' WHEN a.category = b.category THEN 'same' ELSE 'conflict' END AS route FROM memory a LEFT JOIN memory b ON b.memory_id = a.memory_id * 2")
def eval_scores(spark, sf):
    """Precision and recall of one keyword rule against the quality labels, per source."""
    rows = B.memory(spark, sf).select("source_session", F.col("stale").alias("expected"), T.version_sensitive("summary").alias("found"))
    own = rows.groupBy("source_session").agg(F.count_if(F.col("expected") & F.col("found")).alias("hit"), F.count_if("found").alias("n"), F.count_if("expected").alias("m"))
    return own.select("source_session", F.round(F.when(F.col("n") == 0, 1.0).otherwise(F.col("hit") / F.col("n")), 6).alias("precision"), F.round(F.when(F.col("m") == 0, 1.0).otherwise(F.col("hit") / F.col("m")), 6).alias("recall"))


query("A14_eval_scores", eval_scores, f"WITH {M}, r AS (SELECT source_session, stale AS e, {_any(_low('summary'), T.VERSION_MARKERS)} OR regexp_matches(summary, '(^|[^A-Za-z0-9.])[vV]?[0-9]+\\.[0-9]+($|[^A-Za-z0-9])') AS f FROM memory) "
    "SELECT source_session, round(CASE WHEN count(*) FILTER (f) = 0 THEN 1.0 ELSE count(*) FILTER (e AND f) / count(*) FILTER (f) END, 6) AS precision, round(CASE WHEN count(*) FILTER (e) = 0 THEN 1.0 ELSE count(*) FILTER (e AND f) / count(*) FILTER (e) END, 6) AS recall FROM r GROUP BY source_session")  # fmt: skip
query("A15_eval_means", lambda spark, sf: eval_scores(spark, sf).agg(F.round(F.coalesce(F.avg("precision"), F.lit(1.0)), 4).alias("mean_precision"), F.round(F.coalesce(F.avg("recall"), F.lit(1.0)), 4).alias("mean_recall")),
    f"SELECT round(coalesce(avg(precision), 1.0), 4) AS mean_precision, round(coalesce(avg(recall), 1.0), 4) AS mean_recall FROM ({ORACLES['A14_eval_scores']})")

