"""Interchange, redaction, proposals, skills and statistics over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import exchange as E
from lorekeep.operators import review as V
from lorekeep.operators import search as R
from lorekeep.operators import state as S
from lorekeep.sources import files as files_

from . import bindings as B
from .retrieval import _ACTIVE, bm25_sql
from .texts import _CANON, _adm, _list, _low, _q, _redacted, _redaction_total

QUERIES, ORACLES = {}, {}
M = B.MEMORY


def query(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# entropy backstop
_SEEDS = ("Zq8vX2mN7pLr4TkW9sYb3HcJ6fGd1AeU", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the-quick-brown-fox-jumps-over", "k9F/d3+Q=zXw7_Lm2-Rt5Vb8Nc4Hj6Gs1")
_token = lambda: F.element_at(F.array(*map(F.lit, _SEEDS)), (F.col("memory_id") % 4).cast("int") + 1)
_text = lambda: F.concat(F.lit("key "), _token(), F.lit(", body: "), "body")
_SEED = f"{_list(_SEEDS)}[CAST(memory_id % 4 AS INT) + 1]"
_bits = lambda t: f"list_sum(list_transform(list_distinct(string_split({t}, '')), lambda c: -(len(list_filter(string_split({t}, ''), lambda x: x = c)) / length({t})) * log2(len(list_filter(string_split({t}, ''), lambda x: x = c)) / length({t}))))"
query("A18_token_entropy", lambda spark, sf: B.memory(spark, sf).select("memory_id", F.round(E.entropy_bits(_token()), 6).alias("bits")), f"WITH {M} SELECT memory_id, round({_bits(_SEED)}, 6) AS bits FROM memory")
_PIECES = f"SELECT memory_id, string_split_regex(x, '{E.ENTROPY_TOKEN}') AS p, list_transform(regexp_extract_all(x, '{E.ENTROPY_TOKEN}'), lambda t: CASE WHEN {_bits('t')} >= {E.ENTROPY_BITS} THEN '[REDACTED:high_entropy]' ELSE t END) AS t FROM (SELECT memory_id, 'key ' || {_SEED} || ', body: ' || body AS x FROM memory)"
query("T7_entropy_backstop", lambda spark, sf: B.memory(spark, sf).select("memory_id", E.redact_entropy(_text()).alias("redacted")),
    f"WITH {M}, pc AS ({_PIECES}) SELECT memory_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(t[i], '')), '') AS redacted FROM pc")

# concept files
_TITLE = "CASE WHEN t = '' THEN category ELSE t END"
_LINES = "SELECT *, coalesce(trim(regexp_replace(c[1], '^# ', '')), '') AS t, trim(regexp_replace(c[2], '^# ', '')) AS d FROM (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS c FROM memory)"
query("T28_title_description", lambda spark, sf: B.memory(spark, sf).select("memory_id", E.title(F.col("body"), F.col("category")).alias("title"), E.description(F.col("body")).alias("description")),
    f"WITH {M} SELECT memory_id, substring({_TITLE}, 1, 120) AS title, CASE WHEN d <> '' THEN substring(d, 1, 200) END AS description FROM ({_LINES})")
_entry = lambda spark, sf: B.memory(spark, sf).select(F.col("memory_id").cast("string").alias("id"), F.col("store").alias("scope"), "category", "status", F.col("confidence").cast("string").alias("confidence"), F.col("created_at").cast("string").alias("created_at"), F.concat(F.lit("# It's "), "category", F.lit("\n"), "summary").alias("body"))
query("IO22_to_okf", lambda spark, sf: E.to_okf(files_.to_markdown(_entry(spark, sf))).select("id", F.substring_index("okf", "\nid: ", 1).alias("head")),
    f"WITH {M}, s AS (SELECT memory_id, category, 'It''s ' || category AS t, substring(trim(summary), 1, 200) AS d FROM memory) "
    "SELECT CAST(memory_id AS VARCHAR) AS id, '---' || chr(10) || 'okf_version: \"0.1\"' || chr(10) || 'type: ' || category || chr(10) || 'title: ''' || replace(t, '''', '''''') || '''' || chr(10) || 'description: ' || CASE WHEN regexp_matches(d, '[:#''\"\\[\\]]') THEN '''' || replace(d, '''', '''''') || '''' ELSE d END AS head FROM s")  # fmt: skip
_foreign = lambda spark, sf: B.read(spark, sf, "documents").select("doc_id", F.concat(F.lit("---\n"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.lit("type: 'Weird: one'\n")), F.lit('title: "Doc '), "doc_id", F.lit('"\ntags: [a, \'b c\', '), "lang", F.lit("]\n---\n\n"), "text", F.lit("\n")).alias("okf"))
query("IO6_from_okf", lambda spark, sf: E.from_okf(_foreign(spark, sf)).select("doc_id", "id", "type", "title", F.array_join("tags", "|").alias("tags"), "confidence", "error", F.md5(F.col("body").cast("binary")).alias("body_md5")),
    "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'okf-' || substr(sha256('Doc ' || doc_id || chr(10) || text), 1, 16) END AS id, CASE WHEN doc_id % 3 <> 0 THEN 'Weird: one' ELSE '' END AS type, 'Doc ' || doc_id AS title, 'a|b c|' || lang AS tags, CAST(0.4 AS DOUBLE) AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'MissingType' END AS error, md5(text) AS body_md5 FROM documents")
query("IO7_okf_layout", lambda spark, sf: B.memory(spark, sf).where(_ACTIVE).groupBy(T.slug("category").alias("dir")).agg(F.count("*").alias("entries"), F.min(E.memory_path(T.slug("category"), F.col("memory_id").cast("string"))).alias("first_path")),
    f"WITH {M} SELECT {(_slug := 'regexp_replace(regexp_replace(' + _low('category') + ', ' + chr(39) + '[^a-z0-9]+' + chr(39) + ', ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '^-+|-+$' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS dir, count(*) AS entries, min({_slug} || '/' || memory_id || '.md') AS first_path FROM memory WHERE {_ACTIVE} GROUP BY 1")
query("IO8_okf_import", lambda spark, sf: (f := E.from_okf(_foreign(spark, sf))).agg(F.count_if(F.col("error").isNull()).alias("parsed"), F.count_if(F.col("error").isNotNull()).alias("skipped"), F.count_distinct(F.when(F.col("error").isNull(), T.canonical("body"))).alias("added")),
    f"SELECT count(*) FILTER (doc_id % 3 <> 0) AS parsed, count(*) FILTER (doc_id % 3 = 0) AS skipped, count(DISTINCT CASE WHEN doc_id % 3 <> 0 THEN {_CANON('text')} END) AS added FROM documents")
_notes = lambda spark, sf: B.read(spark, sf, "documents").select(F.concat(F.lit("dir/"), F.when(F.col("doc_id") % 10 == 0, "MEMORY").otherwise(F.concat(F.lit("n"), "doc_id")), F.lit(".md")).alias("path"), F.concat(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("---\nname: note "), "doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('\ndescription: "About '), "doc_id", F.lit('"'))).otherwise(""), F.lit("\nmetadata:\n  type: "), "lang", F.lit("\n---\n"))), "text").alias("text"))
query("IO9_agent_notes", lambda spark, sf: E.agent_notes(_notes(spark, sf)),
    "SELECT 'dir/n' || doc_id || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN 'About ' || doc_id ELSE 'note ' || doc_id END AS summary, lang AS kind FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0")
query("IO20_memory_path", lambda spark, sf: B.memory(spark, sf).select("memory_id", E.memory_path(F.col("store"), F.concat(F.element_at(F.array(*map(F.lit, ("m-", "../", "a b", "M_"))), (F.col("memory_id") % 4).cast("int") + 1), F.col("memory_id").cast("string"))).alias("path")),
    f"WITH {M} SELECT memory_id, CASE memory_id % 4 WHEN 0 THEN store || '/m-' || memory_id || '.md' WHEN 3 THEN store || '/M_' || memory_id || '.md' END AS path FROM memory")
query("IO24_distilled_rows", lambda spark, sf: S.upsert(B.memory(spark, sf).where("memory_id % 2 = 0").select("memory_id", "category"), B.memory(spark, sf).where("memory_id % 3 = 0").select("memory_id", F.lower("category").alias("category")), "memory_id"),
    f"WITH {M} SELECT memory_id, CASE WHEN memory_id % 3 = 0 THEN lower(category) ELSE category END AS category FROM memory WHERE memory_id % 2 = 0 OR memory_id % 3 = 0")

# bundles
query("IO11_bundle_export", lambda spark, sf: E.bundle(B.memory(spark, sf), ("project",)).select("memory_id", "body", "redactions"),
    f"WITH {M} SELECT memory_id, {_redacted('body')} AS body, CAST({_redaction_total('body')} AS BIGINT) AS redactions FROM memory WHERE {_ACTIVE} AND store = 'project'")
query("IO23_canonical_lines", lambda spark, sf: E.canonical_lines(B.memory(spark, sf).where(_ACTIVE), "memory_id", ["memory_id", "category", "status"]),
    f"WITH {M} SELECT memory_id, '{{\"memory_id\":' || memory_id || ',\"category\":\"' || category || '\",\"status\":\"' || status || '\"}}' AS line FROM memory WHERE {_ACTIVE}")
query("IO12_bundle_import", lambda spark, sf: (m := B.memory(spark, sf)).where("store = 'global'").select("memory_id", T.canonical("body").alias("c"), F.when(F.col("origin_device") == "dev1", "trusted").otherwise("review").alias("trust")).join(m.where("store = 'project'").select(T.canonical("body").alias("c"), F.lit(True).alias("_have")).distinct(), "c", "left").select("memory_id", "trust", F.when(F.col("_have"), "duplicate").otherwise("added").alias("outcome")),
    f"WITH {M}, c AS (SELECT *, {_CANON('body')} AS c FROM memory) SELECT memory_id, CASE WHEN origin_device = 'dev1' THEN 'trusted' ELSE 'review' END AS trust, CASE WHEN c IN (SELECT c FROM c WHERE store = 'project') THEN 'duplicate' ELSE 'added' END AS outcome FROM c WHERE store = 'global'")

# insights and proposals
_reply = lambda spark, sf: B.memory(spark, sf).select("memory_id", F.to_json(F.struct(F.array(*[F.struct(F.concat(F.lit(" "), "summary").alias("summary"), "category", (F.col("confidence") + c).alias("confidence")) for c in (0.0, 0.3)]).alias("insights"))).alias("reply"))
query("F15_distillation", lambda spark, sf: E.distilled(_reply(spark, sf), "memory_id", "reply", "research").select("memory_id", "lesson_id", "category", F.round("confidence", 4).alias("confidence")),
    f"WITH {M}, x AS (SELECT memory_id, category, summary, confidence, 'research-0000' AS lesson_id FROM memory UNION ALL SELECT memory_id, category, summary, confidence + 0.3, 'research-0001' FROM memory) SELECT memory_id, lesson_id, category, round(confidence, 4) AS confidence FROM x WHERE {_adm('summary')} AND confidence BETWEEN 0 AND 1")
_SOURCE = "CASE WHEN memory_id % 11 = 0 THEN 'bad source' ELSE 'host-' || memory_id % 3 END"
_offer = lambda spark, sf, tail: B.memory(spark, sf).select(F.expr(_SOURCE).alias("source"), F.col("memory_id").alias("key"), F.when(F.col("memory_id") % 13 == 0, " ").otherwise(F.concat(F.lit("note "), "category", tail)).alias("title"), F.concat(F.lit("see "), "store").alias("body"))


def _proposed(spark, sf):
    earlier = E.proposals(_offer(spark, sf, F.lit("")).where("key % 2 = 0"), spark.createDataFrame([], "source string, key long, fingerprint string"), {})
    now = _offer(spark, sf, F.when(F.col("memory_id") % 4 == 0, " again").otherwise(F.when(F.col("memory_id") % 9 == 1, F.repeat(F.lit(" x"), 150)).otherwise("")))
    return E.proposals(now, earlier, {"title": 200, "body": 4000}).select("key", "state")


query("M13_propose", _proposed, f"WITH {M} SELECT memory_id AS key, CASE WHEN memory_id % 13 = 0 THEN 'EmptyProposal' WHEN memory_id % 11 = 0 THEN 'InvalidProposalSource' WHEN memory_id % 4 <> 0 AND memory_id % 9 = 1 THEN 'TooLong:title' WHEN memory_id % 2 = 1 THEN 'New' WHEN memory_id % 4 = 0 THEN 'Conflict' ELSE 'Replayed' END AS state FROM memory")
query("M33_bump_seen", lambda spark, sf: B.memory(spark, sf).select("memory_id", F.when(F.col("memory_id") % 7 == 0, F.lower("summary")).otherwise(F.col("summary")).alias("summary")).join(B.read(spark, sf, "events").groupBy(F.col("user_id").alias("memory_id")).agg(F.count("*").alias("again")), "memory_id", "left").select("memory_id", F.md5(F.col("summary").cast("binary")).alias("candidate"), (1 + F.coalesce("again", F.lit(0))).alias("seen_count")),
    f"WITH {M}, e AS (SELECT user_id, count(*) AS again FROM events GROUP BY user_id) SELECT memory_id, md5(CASE WHEN memory_id % 7 = 0 THEN lower(summary) ELSE summary END) AS candidate, 1 + coalesce(again, 0) AS seen_count FROM memory LEFT JOIN e ON user_id = memory_id")
query("M35_typed_audit", lambda spark, sf: B.read(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", "review").when(F.col("event_type") == "view", "context_export").when(F.col("event_type") == "error", "inference_call").otherwise("skill_draft").alias("audit"), F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k").cast("long")).alias("tokens")),
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'review' WHEN 'view' THEN 'context_export' WHEN 'error' THEN 'inference_call' ELSE 'skill_draft' END AS audit, CASE WHEN event_type = 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS tokens FROM events")
# what is stored (not stale) meets what is persisted (stale or contradicted): entries are replaced, their use is kept
_stored = lambda spark, sf: B.memory(spark, sf).where("not stale").select("memory_id", "category", "status", "hit_count")
_entries = lambda spark, sf: B.memory(spark, sf).where("stale or contradicted").select("memory_id", F.lit("AntiPattern").alias("category"), F.lit("active").alias("status"), F.lit(0).cast("long").alias("hit_count"))
query("M3_persist_entry", lambda spark, sf: S.upsert(_stored(spark, sf), _entries(spark, sf), "memory_id", ("hit_count",)),
    f"""WITH {M} SELECT memory_id, CASE WHEN stale OR contradicted THEN 'AntiPattern' ELSE category END AS category, CASE WHEN stale OR contradicted THEN 'active' ELSE status END AS status,
    CASE WHEN stale THEN 0 ELSE hit_count END AS hit_count FROM memory""")  # fmt: skip
query("M5_delete_cascade", lambda spark, sf: S.delete(S.relationships(B.memory(spark, sf).withColumn("related_files", F.array(F.lit("f"))).withColumn("related_entities", F.array(F.lit("x")))), (gone := B.read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("memory_id"))), "memory_id").select("memory_id", F.col("relation_kind").alias("part")).unionAll(S.delete(B.read(spark, sf, "embeddings").select(F.col("vec_id").alias("memory_id"), F.lit("vector").alias("part")), gone, "memory_id")),
    f"WITH {M} SELECT memory_id, unnest(['category', 'session', 'file', 'entity']) AS part FROM memory WHERE memory_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT vec_id, 'vector' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
_today = lambda: F.lit("2025-01-01").cast("date")
query("M31_freshness_dry_run", lambda spark, sf: S.freshness_report(B.memory(spark, sf), _today(), ("project",)))
query("M31_freshness_pass", lambda spark, sf: S.freshness_pass(B.memory(spark, sf), _today(), ("project", "global")).groupBy("store").agg(F.count_if("stale").alias("stale")))

# skills
_skills = lambda spark, sf: B.read(spark, sf, "part").select(F.col("p_partkey").alias("skill_id"), "p_name", F.lit("draft").alias("state"), (F.col("p_size") % 4).alias("sources"))
_acts = lambda spark, sf: B.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("skill_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.when(F.col("l_returnflag") == "R", "retire").otherwise("activate").alias("action"))
_LIFE = "WITH a AS (SELECT l_partkey AS id, max_by(CASE WHEN l_returnflag = 'R' THEN 'retire' ELSE 'activate' END, l_orderkey * 10 + l_linenumber) AS action FROM lineitem GROUP BY 1), sk AS (SELECT p_partkey AS skill_id, p_name, p_size % 4 AS sources, CASE action WHEN 'activate' THEN 'active' WHEN 'retire' THEN 'retired' ELSE 'draft' END AS state FROM part LEFT JOIN a ON id = p_partkey)"
query("M29_skill_lifecycle", lambda spark, sf: E.lifecycle(_skills(spark, sf), _acts(spark, sf)).select("skill_id", "state"), f"{_LIFE} SELECT skill_id, state FROM sk")
query("M39_skill_refresh", lambda spark, sf: E.lifecycle(_skills(spark, sf), _acts(spark, sf)).where("state = 'active' and sources > 0").agg(F.count("*").alias("refreshed")), f"{_LIFE} SELECT count(*) AS refreshed FROM sk WHERE state = 'active' AND sources > 0")
query("F18_active_skill", lambda spark, sf: E.lifecycle(_skills(spark, sf), _acts(spark, sf)).where("skill_id = 5 and state = 'active'").select("skill_id", "p_name"), f"{_LIFE} SELECT skill_id, p_name FROM sk WHERE skill_id = 5 AND state = 'active'")
_STATES = ("pending", "accepted", "rejected", "edited")
_items = lambda spark, sf: B.memory(spark, sf).select(F.col("memory_id").alias("id"), "summary", "category", F.element_at(F.array(*map(F.lit, _STATES)), (F.col("memory_id") % 4).cast("int") + 1).alias("state"), F.when(F.col("hit_count") == 3, "UpdateSkillDraft").otherwise("PromoteToMemory").alias("action"))
_DRAFTS = f"dr AS (SELECT 'skill-' || memory_id AS draft_id, regexp_replace(regexp_replace({_low('summary')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS name, 'Suggested disabled workflow draft from review item ' || memory_id || '.' AS description, 'When work resembles: ' || summary AS trigger, true AS disabled FROM memory WHERE memory_id % 4 IN (1, 3) AND (category = 'CandidateSkill' OR hit_count = 3))"
query("K21_context_export", lambda spark, sf: E.context_lines(B.hits(spark, sf), E.skill_drafts(_items(spark, sf)), "Context", B.QUERY),
    f"WITH {M}, {_DRAFTS}, {bm25_sql(B.QUERY, _ACTIVE)} SELECT '0' AS at, '# Context' AS line UNION ALL SELECT '1', 'Query: `{B.QUERY}`' UNION ALL SELECT '2', '## Accepted Memory' UNION ALL SELECT '4', '## Suggested Skills' UNION ALL "
    "SELECT * FROM (SELECT '3.' || lpad(CAST(memory_id AS VARCHAR), 12, '0') AS at, '- `' || memory_id || '` score=' || score AS line FROM (SELECT * FROM hits ORDER BY rank_score DESC, memory_id LIMIT 6)) UNION ALL "
    "SELECT '5.' || draft_id, '- `' || draft_id || '` `' || name || '`: ' || description FROM (SELECT * FROM dr ORDER BY draft_id LIMIT 6)")  # fmt: skip

# statistics
query("A8_api_status", lambda spark, sf: _items(spark, sf).join(B.read(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("_p")).distinct(), "id", "left").agg(F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("_p").isNotNull()).alias("accepted"), F.count_if(F.col("state").isin("accepted", "edited") & F.col("_p").isNull()).alias("accepted_awaiting_promotion")),
    f"WITH {M}, p AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT count(*) FILTER (memory_id % 4 = 0) AS pending, count(doc_id) AS accepted, count(*) FILTER (memory_id % 4 IN (1, 3) AND doc_id IS NULL) AS accepted_awaiting_promotion FROM memory LEFT JOIN p ON doc_id = memory_id")
