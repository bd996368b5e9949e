"""Workspace search, tests, overviews and lookups over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import graph as G
from lorekeep.operators import search as R
from lorekeep.operators import workspace as W

from . import bindings as B
from .retrieval import _ACTIVE, _ANCH, _BFS, _COS, _anch, _one, bm25_sql, scan

QUERIES, ORACLES = {}, {}
M = B.MEMORY
ASKED = "locks consistent order bolt ring"
TERMS = tuple(ASKED.split())
TODAY = "2025-01-01"


def query(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


_today = lambda: F.lit(TODAY).cast("date")
_nodes = lambda spark, sf: B.nodes(spark, sf).withColumn("confidence", 0.5 + F.col("shard") / 20).withColumn("created_at", F.date_add(F.lit("2024-11-01").cast("date"), F.col("shard").cast("int")))
_hits = lambda spark, sf: B.hits(spark, sf, ASKED)


def workspace(spark, sf, focus: str | None):
    hops = G.hops(B.around(spark, sf), _one(spark, focus), 2) if focus else None
    return W.search(_nodes(spark, sf), _hits(spark, sf), B.texts(spark, sf), _anch(spark, sf), TERMS, _today(), hops)


def workspace_sql(focus: str | None) -> str:
    """SQL ending in ws(kind, id, structural, temporal, intent, score)."""
    intent = " + ".join(f"CAST(contains(lower(name) || ' ' || lower(n.node), '{t}') AS INT)" for t in TERMS)
    decay = lambda age: f"CASE WHEN {age} <= 0 THEN 1.0 ELSE exp(-ln(2) / 30.0 * {age}) END"
    head = (_BFS(focus, 2) + ", hp AS (SELECT node, min(h) AS hops FROM w GROUP BY node)") if focus else f"WITH {B.EDGES}, hp AS (SELECT '' AS node, 0 AS hops)"
    near = "CASE WHEN hops IS NULL THEN 0.0 ELSE pow(0.5, hops) END"
    return (
        f"{head}, {M}, {B.NODES}, {_ANCH}, {bm25_sql(ASKED, _ACTIVE)}, "
        f"nd AS (SELECT n.node, ({intent}) / {float(len(TERMS))} AS intent, {near if focus else '0.5 + shard / 20'} AS structural, {near if focus else '1.0'} AS pull, "
        f"{decay(f'(DATE {chr(39)}{TODAY}{chr(39)} - CAST(DATE {chr(39)}2024-11-01{chr(39)} + CAST(shard AS INT) AS DATE))')} AS temporal FROM nodes n LEFT JOIN hp ON hp.node = n.node), "
        f"sc AS (SELECT * FROM nd WHERE intent > 0 {'OR structural > 0' if focus else ''}), "
        "pl AS (SELECT memory_id, max(strength * pull) AS anchored FROM sc JOIN an USING (node) GROUP BY memory_id), "
        "al AS (SELECT 'code' AS kind, node AS id, structural, temporal, intent FROM sc UNION ALL "
        f"SELECT 'memory', CAST(h.memory_id AS VARCHAR), coalesce(anchored, 0.0), {decay(f'(DATE {chr(39)}{TODAY}{chr(39)} - created_at)')}, 1 - 1 / (1 + score) FROM hits h LEFT JOIN pl USING (memory_id) UNION ALL "
        "SELECT 'memory', CAST(memory_id AS VARCHAR), anchored, 0.0, 0.0 FROM pl WHERE anchored > 0 AND memory_id NOT IN (SELECT memory_id FROM hits) AND memory_id IN (SELECT memory_id FROM memory)), "
        "ws AS (SELECT *, 0.4 * structural + 0.3 * temporal + 0.3 * intent AS score FROM al WHERE 0.4 * structural + 0.3 * temporal + 0.3 * intent > 0)"
    )


for _name, _focus in (("R4_workspace_search", None), ("R4_workspace_focus", "n7")):
    query(_name, lambda spark, sf, f=_focus: workspace(spark, sf, f).select("kind", "id", F.round("score", 6).alias("score"), F.round("structural", 6).alias("structural"), F.round("intent", 6).alias("intent")),
        f"{workspace_sql(_focus)} SELECT kind, id, round(score, 6) AS score, round(structural, 6) AS structural, round(intent, 6) AS intent FROM ws")
query("U5_anchored_union", lambda spark, sf: workspace(spark, sf, "n7").where("kind = 'memory'").select("id", (F.col("intent") > 0).alias("by_keyword")), f"{workspace_sql('n7')} SELECT id, intent > 0 AS by_keyword FROM ws WHERE kind = 'memory'")
query("R5_workspace_reranked", lambda spark, sf: W.reranked(workspace(spark, sf, "n7").withColumn("score", F.round("score", 6)), scan(spark, sf).where("label > 1").select(F.lit("memory").alias("kind"), F.col("vec_id").cast("string").alias("id"), "cosine"), 40).select("kind", "id", "position"),
    f"{workspace_sql('n7')}, {_COS}, rk AS (SELECT ws.kind, ws.id, cosine, row_number() OVER (ORDER BY round(score, 6) DESC, ws.kind, ws.id) AS rank FROM ws LEFT JOIN cs ON label > 1 AND ws.kind = 'memory' AND ws.id = CAST(vec_id AS VARCHAR)), "
    "s AS (SELECT *, row_number() OVER (ORDER BY rank) AS seat, row_number() OVER (ORDER BY cosine DESC, rank) AS k FROM rk WHERE rank <= 40 AND cosine IS NOT NULL) "
    "SELECT a.kind, a.id, b.rank AS position FROM s a JOIN s b ON a.k = b.seat UNION ALL SELECT kind, id, rank FROM rk WHERE rank > 40 OR cosine IS NULL")  # fmt: skip
query("A16_anchor_strength", lambda spark, sf: _anch(spark, sf).join(G.hops(B.around(spark, sf), _one(spark, "n7"), 2), "node").groupBy("memory_id").agg(F.round(F.max(F.col("strength") * F.pow(F.lit(0.5), "hops")), 6).alias("strength")),
    f"{_BFS('n7', 2)}, {M}, {_ANCH} SELECT memory_id, round(max(strength * pow(0.5, h)), 6) AS strength FROM an JOIN (SELECT node, min(h) AS h FROM w GROUP BY node) USING (node) GROUP BY memory_id")
query("J7_anchors_of_memory", lambda spark, sf: B.memory(spark, sf).where("category = 'Process'").select("memory_id").join(_anch(spark, sf), "memory_id").join(B.nodes(spark, sf).select("node", "kind"), "node").select("memory_id", "node", "kind"),
    f"WITH {M}, {B.NODES}, {_ANCH} SELECT memory_id, node, kind FROM an JOIN nodes USING (node) WHERE memory_id IN (SELECT memory_id FROM memory WHERE category = 'Process')")

# tests of functions
_tests = lambda spark, sf: B.read(spark, sf, "lineitem").where("l_partkey % 4 = 0").select(F.concat(F.lit("f"), F.col("l_orderkey") % 50).alias("file"), F.concat(F.lit("t"), "l_partkey").alias("test"), F.concat(F.lit("n"), F.col("l_suppkey") % 90).alias("callee")).distinct()
_functions = lambda spark, sf: B.read(spark, sf, "part").where("p_partkey % 4 <> 0").select(F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("file"), F.concat(F.lit("p"), "p_partkey").alias("node"), F.concat(F.lit("n"), F.when(F.col("p_partkey") < 40, F.col("p_partkey")).otherwise(F.col("p_partkey") % 37 + 40)).alias("name"))
_TESTED = (
    "WITH cl AS (SELECT DISTINCT 'f' || (l_orderkey % 50) AS file, 't' || l_partkey AS test, 'n' || (l_suppkey % 90) AS callee FROM lineitem WHERE l_partkey % 4 = 0), "
    "fn AS (SELECT 'f' || (p_partkey % 50) AS file, 'p' || p_partkey AS node, 'n' || CASE WHEN p_partkey < 40 THEN p_partkey ELSE p_partkey % 37 + 40 END AS name FROM part WHERE p_partkey % 4 <> 0), "
    "sm AS (SELECT file, name, count(*) AS c, min(node) AS x FROM fn GROUP BY file, name), al AS (SELECT name, count(*) AS c, min(node) AS x FROM fn GROUP BY name), "
    "tb AS (SELECT DISTINCT * FROM (SELECT CASE WHEN sm.c = 1 THEN sm.x WHEN al.c = 1 THEN al.x END AS src, test AS dst, CASE WHEN sm.c = 1 THEN 'parsed' ELSE 'heuristic' END AS derivation, CAST(CASE WHEN sm.c = 1 THEN 1.0 ELSE 0.6 END AS DOUBLE) AS confidence FROM cl LEFT JOIN sm ON sm.file = cl.file AND sm.name = callee LEFT JOIN al ON al.name = callee) WHERE src IS NOT NULL)"
)
_tested = lambda spark, sf: W.tests_of_functions(_tests(spark, sf), _functions(spark, sf))
query("J10_test_edges", _tested, f"{_TESTED} SELECT * FROM tb")
query("G4_tests_of", lambda spark, sf: _tested(spark, sf).where("src = 'p5'").select("dst", "confidence"), f"{_TESTED} SELECT dst, confidence FROM tb WHERE src = 'p5'")
query("G8_coverage", lambda spark, sf: _functions(spark, sf).select("node").join(_tested(spark, sf).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("tests")), "node", "left").select("node", F.coalesce("tests", F.lit(0)).alias("tests")),
    f"{_TESTED} SELECT node, count(dst) AS tests FROM fn LEFT JOIN tb ON src = node GROUP BY node")

# overview and primer
_ENDINGS = (".py", ".rs", ".ts", ".txt")
_files = lambda spark, sf: B.read(spark, sf, "part").select(F.concat(F.lit("pkg"), F.col("p_partkey") % 12, F.lit("/m"), "p_partkey", F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_partkey") % 4).cast("int") + 1)).alias("path"))
_overview = lambda spark, sf: W.architecture(_files(spark, sf), B.nodes(spark, sf), B.edges(spark, sf).where("kind = 'calls'"))
_top = lambda what, order="n DESC, name": f"SELECT * FROM (SELECT row_number() OVER (ORDER BY {order}) AS rank, name, n FROM ({what})) WHERE rank <= 10"
_OVERVIEW = (
    f"WITH {B.NODES}, {B.EDGES}, c AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls'), "
    f"ov AS (SELECT 'language' AS section, * FROM ({_top(chr(32).join(['SELECT', str(list(('python', 'rust', 'typescript', 'other'))), '[CAST(p_partkey % 4 AS INT) + 1] AS name, count(*) AS n FROM part GROUP BY 1']))}) UNION ALL "
    f"SELECT 'package', * FROM ({_top('SELECT ' + chr(39) + 'pkg' + chr(39) + ' || (p_partkey % 12) AS name, count(*) AS n FROM part GROUP BY 1')}) UNION ALL "
    f"SELECT 'entry_point', * FROM ({_top('SELECT node AS name, count(*) AS n FROM nodes JOIN c ON src = node WHERE kind = ' + chr(39) + 'function' + chr(39) + ' AND node NOT IN (SELECT dst FROM c) GROUP BY node')}) UNION ALL "
    f"SELECT 'hotspot', * FROM ({_top('SELECT node AS name, count(*) AS n FROM nodes JOIN c ON dst = node WHERE kind IN (' + chr(39) + 'function' + chr(39) + ', ' + chr(39) + 'type' + chr(39) + ') GROUP BY node')}) UNION ALL "
    "SELECT 'count', 1, 'files', count(*) FROM part UNION ALL SELECT 'count', 2, 'symbols', count(*) FROM nodes WHERE kind IN ('function', 'type'))"
)
_agg = lambda section, item, glue: f"coalesce((SELECT string_agg({item}, '{glue}' ORDER BY rank) FROM ov WHERE section = '{section}'), '')"
_n = lambda name: f"(SELECT n FROM ov WHERE section = 'count' AND name = '{name}')"
_DIGEST = f"'f' || {_n('files')} || 's' || {_n('symbols')} || {_agg('language', chr(39) + '|L' + chr(39) + ' || name || ' + chr(39) + ':' + chr(39) + ' || n', '')} || {_agg('package', chr(39) + '|P' + chr(39) + ' || name || ' + chr(39) + ':' + chr(39) + ' || n', '')} || {_agg('entry_point', chr(39) + '|E' + chr(39) + ' || name', '')} || {_agg('hotspot', chr(39) + '|H' + chr(39) + ' || name || ' + chr(39) + ':' + chr(39) + ' || n', '')}"
query("A9_overview", lambda spark, sf: _overview(spark, sf).select("section", F.col("rank").cast("long").alias("rank"), "name", "n"), f"{_OVERVIEW} SELECT section, rank, name, n FROM ov")
query("A10_overview_digest", lambda spark, sf: W.overview_digest(_overview(spark, sf)).select("digest", F.sha2(F.col("digest").cast("binary"), 256).alias("sha256")), f"{_OVERVIEW} SELECT digest, sha256(digest) AS sha256 FROM (SELECT {_DIGEST} AS digest)")
_line = lambda head, section, item: f"'{head}: ' || {_agg(section, item, ', ')} || '.' || chr(10)"
_BODY = (
    f"'Repository primer for repo@abc.' || chr(10) || {_n('files')} || ' files, ' || {_n('symbols')} || ' symbols.' || chr(10) || {_line('Languages', 'language', 'name || chr(32) || chr(40) || n || chr(41)')} || {_line('Top packages', 'package', 'name || chr(32) || chr(40) || n || chr(41)')} || "
    f"{_line('Entry points', 'entry_point', 'name')} || {_line('Most-depended-on', 'hotspot', 'name || chr(32) || chr(40) || n || chr(32) || chr(99) || chr(97) || chr(108) || chr(108) || chr(101) || chr(114) || chr(115) || chr(41)')}"
)
query("T37_primer_body", lambda spark, sf: W.primer_body(_overview(spark, sf), "repo", "abc"), f"{_OVERVIEW} SELECT {_BODY} AS body")
def _stale(spark, sf):
    """The digest held for the whole graph, against the same graph and against one whose files have changed."""
    held, now = W.overview_digest(_overview(spark, sf)), W.overview_digest(W.architecture(_files(spark, sf).where("path like 'pkg1%'"), B.nodes(spark, sf), B.edges(spark, sf).where("kind = 'calls'")))
    one = held.select(F.col("digest").alias("held"))
    return held.select(F.lit("same").alias("graph"), "digest").unionAll(now.select(F.lit("changed"), "digest")).crossJoin(F.broadcast(one)).select("graph", (F.col("digest") != F.col("held")).alias("stale"))


query("G9_primer_stale", _stale, "SELECT 'same' AS graph, false AS stale UNION ALL SELECT 'changed', true")

# lookups
query("F7_resolve_symbol", lambda spark, sf: W.resolved(B.read(spark, sf, "benchmark").select(F.element_at(F.array(*map(F.lit, ("NATION_3", "small ring", "no such name", "Supplier#000000007"))), (F.col("item_id") % 4).cast("int") + 1).alias("name")).distinct(), B.nodes(spark, sf)),
    f"WITH {B.NODES}, a AS (SELECT DISTINCT ['NATION_3', 'small ring', 'no such name', 'Supplier#000000007'][CAST(item_id % 4 AS INT) + 1] AS name FROM benchmark) SELECT name, CASE WHEN count(node) = 1 THEN min(node) END AS node, CASE count(node) WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Resolved' ELSE 'Ambiguous' END AS state FROM a LEFT JOIN nodes USING (name) GROUP BY name")
query("F17_point_lookup", lambda spark, sf: B.nodes(spark, sf).where("node = 's3'"), f"WITH {B.NODES} SELECT * FROM nodes WHERE node = 's3'")
_n_files = lambda spark, sf: B.nodes(spark, sf).select("node", F.concat(F.lit("f"), F.col("shard"), F.col("kind")).alias("file"))
_FILEPAIRS = f"WITH {B.NODES}, {B.EDGES}, fl AS (SELECT node, 'f' || shard || kind AS file FROM nodes), pr AS (SELECT DISTINCT x.file AS a, y.file AS b FROM edges JOIN fl x ON x.node = src JOIN fl y ON y.node = dst WHERE x.file <> y.file), dg AS (SELECT file, count(*) AS degree FROM (SELECT a AS file FROM pr UNION ALL SELECT b FROM pr) GROUP BY file ORDER BY degree DESC, file LIMIT 12)"
query("J16_file_degrees", lambda spark, sf: W.file_degrees(B.edges(spark, sf), _n_files(spark, sf), 12)[0], f"{_FILEPAIRS} SELECT * FROM dg")
query("J16_file_edges", lambda spark, sf: W.file_degrees(B.edges(spark, sf), _n_files(spark, sf), 12)[1], f"{_FILEPAIRS} SELECT a, b FROM pr WHERE a IN (SELECT file FROM dg) AND b IN (SELECT file FROM dg)")
query("J19_topic_selection", lambda spark, sf: (h := _hits(spark, sf).select("memory_id", "score", "rank_score")) if B.texts(spark, sf).limit(13).count() > 12 else B.memory(spark, sf).select("memory_id", F.lit(0).alias("score"), F.lit(0.0).alias("rank_score")),
    f"WITH {M}, {bm25_sql(ASKED, _ACTIVE)} SELECT memory_id, score, rank_score FROM hits")
