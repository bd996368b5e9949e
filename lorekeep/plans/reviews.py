"""Queries of review, promotion, anchors and imports over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import closeout as C
from lorekeep.operators import review as V

from . import bindings as B
from .texts import _adm, _any, _cmd, _lesson, _low, _q, _strip

QUERIES, ORACLES = {}, {}


def query(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# languages of code
EXTENSIONS = ("rs", "PY", "jsx", "h", "hpp", "exs", "txt", "")
query(
    "T13_code_language",
    lambda spark, sf: B.read(spark, sf, "part").select("p_partkey", V.code_language(F.concat(F.lit("src/a.b/"), "p_name", F.lit("."), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % 8).cast("int") + 1))).alias("language")),
    "SELECT p_partkey, ['rust', 'python', 'javascript', 'c', 'cpp', 'elixir', NULL, NULL][CAST(p_partkey % 8 AS INT) + 1] AS language FROM part",
)
query(
    "T12_dominant_language",
    lambda spark, sf: V.dominant_language(B.read(spark, sf, "documents").select(F.col("lang").alias("language"))),
    "SELECT lang AS language, count(*) AS n_files FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY n_files DESC, language LIMIT 1",
)


# anchors, imports and targets
def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    n = B.nodes(spark, sf).select("node", F.col("node").alias("qualified_name"), F.concat(F.lit("src/"), "shard", F.lit("/"), "node").alias("path"), "name")
    k = F.col("o_orderkey") % 300
    hint = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" p"), k.cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("src\\"), (k % 10).cast("string"), F.lit("\\s"), k.cast("string")))
    hints = B.read(spark, sf, "orders").select(F.col("o_orderkey").alias("memory_id"), hint.alias("hint"))
    named = B.read(spark, sf, "customer").select(F.col("c_custkey").alias("memory_id"), F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("hint"))
    return V.anchor_memories(hints.unionAll(named), n)


query(
    "J8_anchor_resolution", _anchors,
    f"""WITH {B.NODES}, n AS (SELECT node, node AS qualified_name, 'src/' || shard || '/' || node AS path, name FROM nodes),
    h AS (SELECT o_orderkey AS memory_id, trim(CASE WHEN o_orderkey % 3 = 0 THEN ' p' || (o_orderkey % 300) WHEN o_orderkey % 3 = 1 THEN 'src\\' || (o_orderkey % 300 % 10) || '\\s' || (o_orderkey % 300) END) AS hint FROM orders
      UNION ALL SELECT c_custkey, 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') FROM customer),
    w AS (SELECT memory_id, hint, replace(hint, '\\', '/') AS wanted FROM h WHERE hint <> ''),
    k1 AS (SELECT wanted, count(*) AS n1, min(node) AS node1 FROM (SELECT node, qualified_name AS wanted FROM n UNION SELECT node, path FROM n) GROUP BY wanted),
    k2 AS (SELECT name AS wanted, count(*) AS n2, min(node) AS node2 FROM n GROUP BY name)
    SELECT memory_id, hint, CASE WHEN n1 = 1 THEN node1 WHEN n1 IS NULL AND n2 = 1 THEN node2 END AS node,
      CAST(CASE WHEN n1 = 1 THEN 0.9 WHEN n1 IS NULL AND n2 = 1 THEN 0.6 END AS DOUBLE) AS confidence
    FROM w LEFT JOIN k1 USING (wanted) LEFT JOIN k2 USING (wanted)""",
)


def _imports(spark: SparkSession, sf: str) -> DataFrame:
    s = B.read(spark, sf, "supplier")
    files = s.select(F.concat(F.lit("f"), "s_suppkey").alias("file"), F.concat(F.lit("mod"), (F.col("s_suppkey") * 7 % 90).cast("string")).alias("stem"))
    k = F.col("c_custkey")
    path = F.concat(F.lit("crate::mod"), (k % 120).cast("string"), F.when(k % 2 == 0, F.lit("x")).otherwise(F.lit("")), F.lit("::Thing;"))
    return V.import_edges(B.read(spark, sf, "customer").select(F.concat(F.lit("f"), (k % 50).cast("string")).alias("file"), k.alias("line"), path.alias("path")), files)


query(
    "J11_import_edges", _imports,
    """WITH f AS (SELECT 'f' || s_suppkey AS target, 'mod' || (s_suppkey * 7 % 90) AS stem FROM supplier),
    u AS (SELECT 'f' || (c_custkey % 50) AS file, c_custkey AS line, unnest(['mod' || (c_custkey % 120) || CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END, 'Thing']) AS segment FROM customer),
    p AS (SELECT file, line, target, max(segment = stem) AS ex FROM u JOIN f ON target <> file AND (starts_with(segment, stem) OR starts_with(stem, segment)) GROUP BY file, line, target),
    g AS (SELECT file, line, count(*) FILTER (ex) AS ne, min(target) FILTER (ex) AS te, count(*) FILTER (NOT ex) AS np, min(target) FILTER (NOT ex) AS tp FROM p GROUP BY file, line)
    SELECT file, line, CASE WHEN ne = 1 THEN te ELSE tp END AS target, ne <> 1 AS heuristic, CAST(CASE WHEN ne = 1 THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence
    FROM g WHERE ne = 1 OR (ne = 0 AND np = 1)""",
)


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    li = B.read(spark, sf, "lineitem")
    held = li.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("file"), F.concat(F.lit("old"), "l_linenumber").alias("name"))
    fresh = li.where("l_linenumber = 3 and l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("file"), F.lit("new").alias("name"))
    return V.admit_file(held, fresh)


query(
    "J20_admit_parsed", _targets,
    """WITH n AS (SELECT l_orderkey AS file, 'new' AS name FROM lineitem WHERE l_linenumber = 3 AND l_orderkey % 2 = 0)
    SELECT l_orderkey AS file, 'old' || l_linenumber AS name FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey NOT IN (SELECT file FROM n) UNION ALL SELECT * FROM n""",
)

# ranking and caps
query(
    "K20_tool_relevance",
    lambda spark, sf: B.read(spark, sf, "orders").select("o_orderkey", V.relevance(
        F.split("o_orderpriority", "[- ]+"), F.array(F.lit("URGENT now"), F.lit("high"), F.lit("2")), F.col("o_totalprice") / 200000).alias("score")),
    """SELECT o_orderkey, len(list_filter(q, lambda x: contains('urgent now', lower(x)) OR contains(lower(x), 'urgent now') OR contains('high', lower(x)) OR contains(lower(x), 'high') OR contains('2', lower(x)) OR contains(lower(x), '2')))
      / len(q) * CAST(0.7 AS DOUBLE) * greatest(0, least(1, o_totalprice / 200000)) AS score
    FROM (SELECT o_orderkey, o_totalprice, regexp_split_to_array(o_orderpriority, '[- ]+') AS q FROM orders)""",
)
_OPENS = lambda x, markers: "(" + " OR ".join(f"starts_with({x}, {_q(m)})" for m in markers) + ")"
_FOUND = f"""
t AS (SELECT session, line_no, trim(line) AS line FROM lines),
cmd AS (SELECT session, line_no, command, row_number() OVER (PARTITION BY session, command ORDER BY line_no) AS n FROM (SELECT session, line_no, {_cmd('line')} AS command FROM t) WHERE octet_length(encode(command)) >= {C.MIN_COMMAND}),
fam AS (
  SELECT session, 1 AS family, line_no, summary FROM (SELECT session, line_no, trim(regexp_replace({_strip('line')}, '^[Ll]esson:', '')) AS summary FROM t WHERE regexp_matches({_strip('line')}, '^[Ll]esson:')) WHERE {_adm('summary')} UNION ALL
  SELECT session, 2, line_no, summary FROM (SELECT session, line_no, trim(regexp_replace(line, '^(- )+', '')) AS summary FROM t) WHERE {_any(_low('summary'), T.SKILL_INTENTS)} AND {_lesson('summary')} UNION ALL
  SELECT session, 4, line_no, 'Command repeated during this session (candidate for a reusable workflow): ' || CASE WHEN length(command) > 120 THEN substring(command, 1, 120) || '…' ELSE command END FROM cmd WHERE n = 2 UNION ALL
  SELECT session, 5, line_no, 'User correction: ' || CASE WHEN length(rest) > 120 THEN substring(rest, 1, 120) || '…' ELSE rest END
    FROM (SELECT session, line_no, trim(substr(line, 6)) AS rest FROM t WHERE starts_with({_low('line')}, 'user:')) WHERE {_OPENS(_low('rest'), T.CORRECTIONS)} AND {_lesson('rest')}),
c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, family ORDER BY line_no) AS n FROM fam) WHERE family < 3 OR n <= {C.MOST}),
c2 AS (SELECT * FROM (SELECT session, family, line_no, summary, row_number() OVER (PARTITION BY session, {_low('summary')} ORDER BY family, line_no) AS n FROM c1) WHERE n = 1),
c3 AS (SELECT * FROM (SELECT session, family, line_no, summary, row_number() OVER (PARTITION BY session, family ORDER BY line_no) AS n FROM c2) WHERE family <> 2 OR n <= {C.MOST})"""
_ACTED = """CASE WHEN family IN (2, 4) THEN 'CreateSkillDraft' WHEN contains(lower(summary), 'instead') OR contains(lower(summary), 'do not') OR contains(lower(summary), 'don''t') OR contains(lower(summary), 'wrong') THEN 'SupersedeExisting'
  WHEN contains(summary, '; ') OR len(string_split(lower(summary), ' and ')) >= 3 THEN 'Split' ELSE 'PromoteToMemory' END"""
# all families but the pairs of failures and fixes, whose scan SQL doesn't state
query(
    "K14_family_caps",
    lambda spark, sf: C.candidates(B.lines(spark, sf)).where("family <> 3").select("session", "family", "summary", F.when(F.col("duplicate_of").isNotNull(), "merged").otherwise(F.col("action")).alias("action")),
    f"""WITH {B.LINES}, {_FOUND}, p AS (SELECT *, lower(trim(regexp_replace(summary, '\\s+', ' ', 'g'))) AS x FROM c3)
    SELECT session, family, summary, CASE WHEN EXISTS (SELECT 1 FROM p e WHERE e.session = p.session AND (e.family, e.line_no) < (p.family, p.line_no)
      AND ((octet_length(encode(e.x)) >= {C.MIN_RESTATEMENT} AND contains(p.x, e.x)) OR (octet_length(encode(p.x)) >= {C.MIN_RESTATEMENT} AND contains(e.x, p.x)))) THEN 'merged' ELSE {_ACTED} END AS action FROM p""",
)
query("M19_closeout", lambda spark, sf: C.closed_out(B.lines(spark, sf)).select("session", "place", "family", "candidate_id", "summary", "category", "action", "status", "conflict", "duplicate_of", "at", "survivor"))
# review
def _items(spark: SparkSession, sf: str) -> DataFrame:
    m, k = B.memory(spark, sf), F.col("memory_id")
    return m.select(
        k.alias("item_id"), "summary", "confidence", (k % 6 == 0).alias("sourced"), F.col("contradicted").alias("conflict"), F.when(k % 3 == 0, k + 1).alias("target"),
        F.col("stale").alias("duplicate"), (k % 5 != 0).alias("general"), F.element_at(F.array(*map(F.lit, ("pending", "accepted", "edited", "rejected"))), (k % 4).cast("int") + 1).alias("state"),
        (k % 7 == 1).alias("needs_edit"), F.when(k % 9 == 1, F.concat(F.lit("edited "), k.cast("string"))).alias("replacement"), (F.col("store") == "global").alias("wants_global"),
    )


ITEMS = f"""{B.MEMORY}, items AS (SELECT memory_id AS item_id, summary, confidence, memory_id % 6 = 0 AS sourced, contradicted AS conflict, CASE WHEN memory_id % 3 = 0 THEN memory_id + 1 END AS target,
  stale AS duplicate, memory_id % 5 <> 0 AS general, ['pending', 'accepted', 'edited', 'rejected'][CAST(memory_id % 4 AS INT) + 1] AS state, memory_id % 7 = 1 AS needs_edit,
  CASE WHEN memory_id % 9 = 1 THEN 'edited ' || memory_id END AS replacement, store = 'global' AS wants_global FROM memory)"""
query(
    "M2_promotion",
    lambda spark, sf: V.promote(_items(spark, sf), True),
    f"""WITH {ITEMS}, e AS (SELECT *, CASE WHEN state NOT IN ('accepted', 'edited') THEN 'not accepted' WHEN needs_edit AND replacement IS NULL THEN 'needs edit' END AS error FROM items)
    SELECT item_id, error, CASE WHEN error IS NULL THEN coalesce(replacement, summary) END AS body, CASE WHEN error IS NULL THEN CASE WHEN wants_global THEN 'global' ELSE 'project' END END AS scope,
      CASE WHEN error IS NULL THEN target END AS supersedes FROM e""",
)
query(
    "M34_review_decisions",
    lambda spark, sf: V.apply_decisions(
        B.read(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), F.lit("pending").alias("state")),
        B.read(spark, sf, "events").select((F.col("user_id") * 3).alias("item_id"), F.col("event_type").alias("state"), F.col("event_id").alias("at"))),
    """WITH d AS (SELECT user_id * 3 AS item_id, arg_max(event_type, event_id) AS s FROM events GROUP BY 1), i AS (SELECT c_custkey AS item_id, 'pending' AS o FROM customer)
    SELECT item_id, CASE WHEN o IS NOT NULL THEN coalesce(s, o) END AS state, CASE WHEN o IS NULL THEN 'missing item' END AS error FROM i FULL JOIN d USING (item_id)""",
)
query(
    "M36_receipts",
    lambda spark, sf: V.receipts(
        B.read(spark, sf, "customer").select(F.col("c_custkey").alias("proposal_id"), F.col("c_mktsegment").alias("fingerprint"), F.concat(F.lit("i"), "c_nationkey").alias("survivor")),
        B.read(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("proposal_id"), F.lit("BUILDING").alias("fingerprint"), F.concat(F.lit("n"), "o_orderkey").alias("survivor"))),
    """SELECT o_custkey * 2 AS proposal_id, CASE WHEN c_mktsegment IS NULL THEN 'new' WHEN c_mktsegment = 'BUILDING' THEN 'replayed' ELSE 'conflict' END AS outcome,
      CASE WHEN c_mktsegment IS NULL THEN 'n' || o_orderkey WHEN c_mktsegment = 'BUILDING' THEN 'i' || c_nationkey END AS survivor
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2""",
)
query(
    "M17_contained_duplicates",
    lambda spark, sf: V.contained(B.lines(spark, sf).select("session", F.col("line_no").alias("id"), F.col("line_no").alias("place"), F.col("line").alias("summary"))),
    f"""WITH {B.LINES}, c AS (SELECT session, line_no AS id, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS words FROM lines), k AS (SELECT * FROM c WHERE strlen(words) >= 12)
    SELECT a.session, a.id, min(b.id) AS duplicate_of FROM k a JOIN k b ON a.session = b.session AND b.id < a.id AND (contains(a.words, b.words) OR contains(b.words, a.words)) GROUP BY a.session, a.id""",
)
query(
    "R10_provenance",
    lambda spark, sf: V.provenance(
        B.memory(spark, sf).select("memory_id", "source_session", "status", "confidence", "stale", "origin_device"),
        B.read(spark, sf, "lineitem").select((F.col("l_orderkey") % 200).alias("memory_id"), F.when(F.col("l_linenumber") == 1, "contradicts").otherwise("supersedes").alias("kind"), F.col("l_partkey").alias("target"))),
    f"""WITH {B.MEMORY}, r AS (SELECT l_orderkey % 200 AS memory_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS contradicts FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
    SELECT memory_id, source_session, status, confidence, stale, origin_device, coalesce(contradicts, '') AS contradicts FROM memory LEFT JOIN r USING (memory_id)""",
)
query(
    "T38_skill_markdown",
    lambda spark, sf: B.read(spark, sf, "supplier").select("s_suppkey", V.skill_markdown(F.col("s_name"), F.concat(F.lit("nation "), "s_nationkey"), {
        "Workflow Steps": F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("run"), F.lit("check"))).otherwise(F.array().cast("array<string>")), "Constraints": F.array(F.lit("none"))}).alias("body")),
    r"""SELECT s_suppkey, '---' || chr(10) || 'disabled: true' || chr(10) || 'name: ' || s_name || chr(10) || '---' || chr(10) || chr(10) || '# ' || s_name || chr(10) || chr(10) || 'nation ' || s_nationkey || chr(10) || chr(10) ||
      CASE WHEN s_suppkey % 2 = 0 THEN '## Workflow Steps' || chr(10) || chr(10) || '- run' || chr(10) || '- check' || chr(10) || chr(10) ELSE '' END || '## Constraints' || chr(10) || chr(10) || '- none' || chr(10) || chr(10) AS body FROM supplier""",
)
