"""Search, vectors, similarity joins and graph queries over the bound tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import extraction as X
from lorekeep.operators import graph as G
from lorekeep.operators import index as I
from lorekeep.operators import intervals as V
from lorekeep.operators import queue as Q
from lorekeep.operators import search as R
from lorekeep.operators import state as S
from lorekeep.operators import workspace as W
from lorekeep.sources import files as files_

from . import bindings as B
from .texts import _CANON, _TOKENS, _low

QUERIES, ORACLES = {}, {}
M = B.MEMORY
GRAPH = f"{B.NODES}, {B.EDGES}"


def query(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _term_sql(term: str) -> str:
    """SQL: how often a term, as a phrase of its parts, occurs among the words ``ws``."""
    parts = [p.translate(str.maketrans(I.ACCENTED, I.PLAIN)).lower() for p in re.findall(r"[^\W_]+", term)]
    last = len(parts) - 1
    tests = [
        f"starts_with(ws[i + {k}], '{p}')" if k == last and len(term) >= I.MIN_PREFIX else f"ws[i + {k}] = '{p}'"
        for k, p in enumerate(parts)
    ]
    return f"len(list_filter(range(1, len(ws) - {last} + 1), lambda i: {' AND '.join(tests)}))"


def bm25_sql(query_: str, eligible: str = "true") -> str:
    """SQL common table expressions ending in hits(memory_id, ..., score, rank_score)."""
    terms = T.significant_terms(query_)
    fold = lambda x: f"lower(translate({x}, '{I.ACCENTED}', '{I.PLAIN}'))"
    idf = lambda i: f"ln((n - df{i} + 0.5) / (df{i} + 0.5))"
    score = " + ".join(
        f"(CASE WHEN {idf(i)} <= 0 THEN 1e-6 ELSE {idf(i)} END) * tf{i} * {I.K1 + 1} / (tf{i} + {I.K1} * (1 - {I.B} + {I.B} * len / av))"
        for i in range(len(terms))
    )
    covered = " + ".join(f"CAST(contains({_low('body')}, {_low(chr(39) + t + chr(39))}) AS INT)" for t in terms)
    return (
        f"tk AS (SELECT *, list_filter(regexp_split_to_array({fold('body')}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM memory), "
        f"tc AS (SELECT * EXCLUDE (ws), len(ws) AS len, {', '.join(f'{_term_sql(t)} AS tf{i}' for i, t in enumerate(terms))} FROM tk), "
        f"st AS (SELECT store, count(*) AS n, avg(len) AS av, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(terms)))} FROM tc GROUP BY store), "
        f"hits AS (SELECT tc.*, CAST(greatest(1, round(({score}) * 100)) AS BIGINT) AS score, round({score}, 6) AS rank_score FROM tc JOIN st USING (store) "
        f"WHERE ({' OR '.join(f'tf{i} > 0' for i in range(len(terms)))}) AND {f'({covered}) >= 2' if len(terms) >= 3 else 'true'} AND {eligible})"
    )


_ACTIVE = "status = 'active'"
_HITS = bm25_sql(B.QUERY, _ACTIVE)
#: Terms of several parts, matched as phrases.
COMPOUND = "install left-pad, error[E0107] in (src/core/mod.rs:10)"
hits = B.hits
query("R1_bm25_search", lambda spark, sf: hits(spark, sf).orderBy(F.desc("rank_score"), "memory_id").limit(10).select("memory_id", "score", "rank_score"),
    f"WITH {M}, {_HITS} SELECT memory_id, score, rank_score FROM hits ORDER BY rank_score DESC, memory_id LIMIT 10")
query("R1_bm25_all_hits", lambda spark, sf: hits(spark, sf).select("memory_id", "score"), f"WITH {M}, {_HITS} SELECT memory_id, score FROM hits")
query("R1_compound_terms", lambda spark, sf: hits(spark, sf, COMPOUND).select("memory_id", "store", "score", "rank_score"),
    f"WITH {M}, {bm25_sql(COMPOUND, _ACTIVE)} SELECT memory_id, store, score, rank_score FROM hits")
query("R1_index_stats", lambda spark, sf: B.memory_index(spark, sf).table("stats").select("store", F.col("n").alias("texts"), F.round("mean", 6).alias("mean_length")),
    f"WITH {M}, {_HITS} SELECT store, count(*) AS texts, round(avg(len), 6) AS mean_length FROM tc GROUP BY store")
query("F1_language_search", lambda spark, sf: hits(spark, sf, B.QUERY, f"{_ACTIVE} and (language = 'en' or language is null)").select("memory_id", "score"),
    f"WITH {M}, {bm25_sql(B.QUERY, _ACTIVE + chr(32) + 'AND (language = ' + chr(39) + 'en' + chr(39) + ' OR language IS NULL)')} SELECT memory_id, score FROM hits")
query("U1_store_precedence", lambda spark, sf: R.with_precedence(hits(spark, sf)).select("memory_id", "store", "score"),
    f"WITH {M}, {_HITS} SELECT memory_id, store, score FROM hits WHERE store = 'project' OR (memory_id NOT IN (SELECT memory_id FROM hits WHERE store = 'project') AND body NOT IN (SELECT body FROM hits WHERE store = 'project'))")


def query_vector(spark, sf):
    """The vector of the smallest id: one row."""
    return list(B.read(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0])


scan = lambda spark, sf: R.vector_scan(B.read(spark, sf, "embeddings"), query_vector(spark, sf)).select("vec_id", "label", "cosine")
_COS = "cs AS (SELECT e.vec_id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q)"
query("R6_cosine_scan", lambda spark, sf: scan(spark, sf).select("vec_id", F.round("cosine", 6).alias("cosine")), f"WITH {_COS} SELECT vec_id, round(cosine, 6) AS cosine FROM cs")
query("R6_nearest", lambda spark, sf: scan(spark, sf).where("label = 1").orderBy(F.desc("cosine"), "vec_id").limit(20).select("vec_id", F.round("cosine", 6).alias("cosine")),
    f"WITH {_COS} SELECT vec_id, round(cosine, 6) AS cosine FROM cs WHERE label = 1 ORDER BY cs.cosine DESC, vec_id LIMIT 20")
query("J4_passage_of_vector", lambda spark, sf: scan(spark, sf).where("cosine >= 0.25").join(B.read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id").orderBy(F.desc("cosine"), "vec_id").limit(25).select("vec_id", "source", F.round("cosine", 6).alias("cosine")),
    f"WITH {_COS} SELECT vec_id, source, round(cosine, 6) AS cosine FROM cs JOIN documents d ON d.doc_id = cs.vec_id WHERE cs.cosine >= 0.25 ORDER BY cs.cosine DESC, vec_id LIMIT 25")
query("R3_hybrid", lambda spark, sf: R.hybrid(hits(spark, sf).select("memory_id", "score"), scan(spark, sf).withColumnRenamed("vec_id", "memory_id"), 15).select("memory_id", "hybrid"),
    f"WITH {M}, {_HITS}, {_COS}, nr AS (SELECT vec_id, cosine FROM cs ORDER BY cosine DESC, vec_id LIMIT 20) SELECT memory_id, round(score + greatest(coalesce(cosine, 0), 0) * 100, 6) AS hybrid FROM hits LEFT JOIN nr ON vec_id = memory_id ORDER BY hybrid DESC, memory_id LIMIT 15")
_subject = lambda spark, sf: scan(spark, sf).select("vec_id", (F.col("label") % 3).alias("kind"), F.floor(F.col("vec_id") / 2).alias("id"), F.when(F.col("vec_id") % 2 == 0, "project").otherwise("global").alias("store"), "cosine")
query("U2_vector_precedence", lambda spark, sf: (v := _subject(spark, sf)).where("store = 'project'").unionByName(v.where("store = 'global'").join(v.where("store = 'project'").select("kind", "id").distinct(), ["kind", "id"], "left_anti").select(*v.columns)).orderBy(F.desc("cosine"), "vec_id").select("vec_id", "store", F.round("cosine", 6).alias("cosine")),
    f"WITH {_COS}, v AS (SELECT vec_id, label % 3 AS kind, CAST(floor(vec_id / 2) AS BIGINT) AS id, vec_id % 2 = 0 AS own, cosine FROM cs) SELECT vec_id, CASE WHEN own THEN 'project' ELSE 'global' END AS store, round(cosine, 6) AS cosine FROM v WHERE own OR NOT EXISTS (SELECT 1 FROM v p WHERE p.own AND p.kind = v.kind AND p.id = v.id)")
query("K7_downweight_foreign", lambda spark, sf: R.downweight_foreign(hits(spark, sf), "dev1", 0.85).select("memory_id", F.round("score", 4).alias("weighted")),
    f"WITH {M}, {_HITS} SELECT memory_id, round(CASE WHEN coalesce(origin_device, '') IN ('', 'dev1') THEN CAST(score AS DOUBLE) ELSE score * 0.85 END, 4) AS weighted FROM hits")
_ranked = lambda spark, sf: R.ranked(scan(spark, sf), ["vec_id"], "rank")
_RANKED = f"{_COS}, rk AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS rank FROM cs)"
query("K11_rerank_window", lambda spark, sf: R.rerank_window(scan(spark, sf), 20, ["vec_id"]).select("vec_id", "position"),
    f"WITH {_RANKED} SELECT vec_id, row_number() OVER (ORDER BY CASE WHEN rank <= 20 THEN 0 ELSE 1 END, CASE WHEN rank <= 20 THEN -cosine END, rank) AS position FROM rk")
query("K12_rerank_scored", lambda spark, sf: R.rerank_scored(_ranked(spark, sf).withColumn("cosine", F.when(F.col("label") > 2, F.col("cosine"))), 50).select("vec_id", "position"),
    f"WITH {_RANKED}, s AS (SELECT *, row_number() OVER (ORDER BY rank) AS seat, row_number() OVER (ORDER BY cosine DESC, rank) AS k FROM rk WHERE rank <= 50 AND label > 2) SELECT a.vec_id, b.rank AS position FROM s a JOIN s b ON a.k = b.seat UNION ALL SELECT vec_id, rank FROM rk WHERE rank > 50 OR coalesce(label, 0) <= 2")
query("J18_near_duplicates", lambda spark, sf: R.near_duplicate_pairs(B.read(spark, sf, "documents"), "doc_id", "text", 0.7),
    f"WITH s AS (SELECT doc_id, list_sort({_TOKENS('text')}) AS t FROM documents), c AS (SELECT t, min(doc_id) AS id FROM s WHERE len(t) > 0 GROUP BY t), w AS (SELECT id, len(t) AS m, unnest(t) AS term FROM c) "
    "SELECT a, b, round(n / m, 6) AS overlap FROM (SELECT x.id AS a, y.id AS b, count(*) AS n, any_value(least(x.m, y.m)) AS m FROM w x JOIN w y ON x.term = y.term AND x.id < y.id GROUP BY x.id, y.id) WHERE n >= 0.7 * m")  # fmt: skip
query("T4_similarity", lambda spark, sf: B.memory(spark, sf).select("memory_id", F.round(T.overlap(T.token_set("summary"), T.token_set(F.lit("Never acquire locks before the service timeout"))), 6).alias("overlap")),
    f"WITH {M} SELECT memory_id, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0.0 END, 6) AS overlap FROM (SELECT memory_id, {_TOKENS('summary')} AS a, {_TOKENS(chr(39) + 'Never acquire locks before the service timeout' + chr(39))} AS b FROM memory)")
query("R12_passages", lambda spark, sf: B.read(spark, sf, "documents").where("source = 'src1'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "body")).select("doc_id", F.col("ordinal").cast("long"), "body"),
    "SELECT doc_id, unnest(range(len(t))) AS ordinal, unnest(t) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE source = 'src1')")
_rel = lambda m: S.relationships(m.withColumn("related_files", F.array(F.concat(F.lit("f"), F.col("memory_id") % 7))).withColumn("related_entities", F.array(F.concat(F.lit("x"), F.col("memory_id") % 5), F.lit("x0"))))
_REL = "rel AS (SELECT memory_id, 'category' AS relation_kind, category AS target FROM memory UNION SELECT memory_id, 'session', source_session FROM memory UNION SELECT memory_id, 'file', 'f' || (memory_id % 7) FROM memory UNION SELECT memory_id, 'entity', 'x' || (memory_id % 5) FROM memory UNION SELECT memory_id, 'entity', 'x0' FROM memory)"
query("R11_relationships", lambda spark, sf: _rel(B.memory(spark, sf)).where("memory_id = 7").orderBy("relation_kind", "target").select("relation_kind", "target"),
    f"WITH {M}, {_REL} SELECT relation_kind, target FROM rel WHERE memory_id = 7 ORDER BY relation_kind, target")
def _shared_entities(spark, sf):
    r = _rel(B.memory(spark, sf)).where("relation_kind = 'entity' and target <> 'x0'").select("memory_id", "target")
    asked = r.where("memory_id % 100 = 7").withColumnRenamed("memory_id", "asked")
    own = r.join(B.memory(spark, sf).where(_ACTIVE).select("memory_id"), "memory_id", "left_semi")
    return R.sharing(own, asked, "memory_id", "asked", "target").where("memory_id <> asked").select("asked", "memory_id")


query("J2_shared_entities", _shared_entities,
    f"WITH {M}, {_REL}, e AS (SELECT * FROM rel WHERE relation_kind = 'entity' AND target <> 'x0') SELECT DISTINCT a.memory_id AS asked, b.memory_id FROM e a JOIN e b ON a.target = b.target AND a.memory_id <> b.memory_id JOIN memory m ON m.memory_id = b.memory_id WHERE a.memory_id % 100 = 7 AND m.status = 'active'")
query("R8_embed_gate", lambda spark, sf: (m := B.memory(spark, sf).select("memory_id", F.md5(F.col("body").cast("binary")).alias("fingerprint"))).join(m.join(B.read(spark, sf, "embeddings").select(F.col("vec_id").alias("memory_id")), "memory_id").select("memory_id", F.when(F.col("memory_id") % 3 == 0, F.lit("stale")).otherwise(F.col("fingerprint")).alias("fingerprint")), ["memory_id", "fingerprint"], "left_anti").select("memory_id"),
    f"WITH {M} SELECT memory_id FROM memory WHERE NOT (memory_id IN (SELECT vec_id FROM embeddings) AND memory_id % 3 <> 0)")

# graph
_one = lambda spark, node: spark.createDataFrame([(node,)], "node string")
query("U3_undirected_edges", lambda spark, sf: B.adjacency(spark, sf), f"WITH {B.EDGES}, {B.UNDIRECTED} SELECT src, dst FROM und")
query("J3_outgoing", lambda spark, sf: B.edges(spark, sf).where("src = 'n7'").join(B.nodes(spark, sf).withColumnRenamed("node", "dst").select("dst", "name"), "dst").select("dst", "name"),
    f"WITH {GRAPH} SELECT dst, name FROM edges JOIN nodes ON node = dst WHERE src = 'n7'")
_WALK = "SELECT node, min(h) AS hops FROM w GROUP BY node"
_BFS = lambda start, depth: f"WITH RECURSIVE {B.EDGES}, {B.UNDIRECTED}, w(node, h) AS (SELECT '{start}', 0 UNION SELECT u.dst, h + 1 FROM w JOIN und u ON u.src = w.node WHERE h < {depth})"
query("G1_neighbours", lambda spark, sf: G.neighbours(B.around(spark, sf), _one(spark, "s3"), 2), f"{_BFS('s3', 2)} SELECT node, hops FROM ({_WALK}) WHERE hops > 0")
query("G2_focus_distances", lambda spark, sf: G.hops(B.around(spark, sf), _one(spark, "n7"), 2), f"{_BFS('n7', 2)} {_WALK}")
query("G3_path_length", lambda spark, sf: spark.createDataFrame([(len(G.shortest_path(B.adjacency(spark, sf), "n1", "n2")) - 1,)], "length long"), f"{_BFS('n1', 6)} SELECT CAST(coalesce(min(h), -1) AS BIGINT) AS length FROM w WHERE node = 'n2'")
_DEP = "WITH RECURSIVE " + B.EDGES + ", ce AS (SELECT dst, src, heuristic FROM edges WHERE kind IN ('calls', 'uses')), w(node, h, v) AS (SELECT 's3', 0, false UNION SELECT ce.src, h + 1, v OR ce.heuristic FROM w JOIN ce ON ce.dst = w.node WHERE h < 3), mh AS (SELECT node, min(h) AS h FROM w GROUP BY node), r AS (SELECT w.node, w.h AS hops, bool_and(v) AS via_heuristic FROM w JOIN mh ON w.node = mh.node AND w.h = mh.h GROUP BY w.node, w.h)"
query("G5_dependents", lambda spark, sf: G.dependents(B.callers(spark, sf), _one(spark, "s3")), f"{_DEP} SELECT node, hops, via_heuristic FROM r")
query("G6_impact", lambda spark, sf: W.change_impact(G.dependents(B.callers(spark, sf), B.nodes(spark, sf).where("shard = 3 and kind = 'type'").select("node")), B.nodes(spark, sf)).select("node", "hops", "tier"),
    _DEP.replace("SELECT 's3', 0, false UNION", "SELECT node, 0, false FROM nodes WHERE shard = 3 AND kind = 'type' UNION").replace("WITH RECURSIVE ", f"WITH RECURSIVE {B.NODES}, ") + ", sy AS (SELECT r.* FROM r JOIN nodes USING (node) WHERE kind IN ('function', 'type')) "
    "SELECT node, hops, 'Direct' AS tier FROM sy WHERE hops = 0 UNION ALL SELECT * FROM (SELECT node, hops, CASE hops WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS tier FROM sy WHERE hops > 0 ORDER BY hops, node LIMIT 20)")  # fmt: skip
_anch = lambda spark, sf: B.texts(spark, sf).select("memory_id", F.concat(F.lit("p"), F.col("hit_count") * 100 + F.floor(F.col("confidence") * 100)).alias("node"), F.col("confidence").alias("strength"))
_ANCH = "an AS (SELECT memory_id, 'p' || CAST(hit_count * 100 + floor(confidence * 100) AS BIGINT) AS node, confidence AS strength FROM memory)"
query("J7_anchored_memories", lambda spark, sf: _anch(spark, sf).join(B.nodes(spark, sf).select("node", "name"), "node").select("memory_id", "node", "name"), f"WITH {M}, {B.NODES}, {_ANCH} SELECT memory_id, node, name FROM an JOIN nodes USING (node)")
query("J15_affected_memories", lambda spark, sf: G.affected_memories(G.dependents(B.callers(spark, sf), _one(spark, "s3")), _anch(spark, sf)),
    f"{_DEP}, {M}, {_ANCH} SELECT memory_id, max(strength) AS strength, min(hops) AS hops FROM an JOIN r USING (node) GROUP BY memory_id")
query("G7_stale_flags", lambda spark, sf: G.affected_memories(G.dependents(B.callers(spark, sf), _one(spark, "s3")), _anch(spark, sf)).where("strength >= 0.6").join(B.memory(spark, sf).where("not stale").select("memory_id"), "memory_id").select("memory_id"),
    f"{_DEP}, {M}, {_ANCH} SELECT memory_id FROM (SELECT memory_id, max(strength) AS s FROM an JOIN r USING (node) GROUP BY memory_id) JOIN memory USING (memory_id) WHERE s >= 0.6 AND NOT stale")
query("A9_hotspots", lambda spark, sf: G.overview(B.nodes(spark, sf), B.edges(spark, sf))[0].select("node", "in_degree"),
    f"WITH {GRAPH} SELECT node, count(*) AS in_degree FROM nodes JOIN (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls') ON dst = node WHERE kind IN ('function', 'type') GROUP BY node ORDER BY in_degree DESC, node LIMIT 10")
query("A9_entry_points", lambda spark, sf: G.overview(B.nodes(spark, sf), B.edges(spark, sf))[1].select("node", "out_degree"),
    f"WITH {GRAPH}, c AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls') SELECT node, count(*) AS out_degree FROM nodes JOIN c ON src = node WHERE kind = 'function' AND node NOT IN (SELECT dst FROM c) GROUP BY node ORDER BY out_degree DESC, node LIMIT 10")
query("J16_file_graph", lambda spark, sf: (e := B.edges(spark, sf)).join((n := B.nodes(spark, sf)).select(F.col("node").alias("src"), F.col("shard").alias("a")), "src").join(n.select(F.col("node").alias("dst"), F.col("shard").alias("b")), "dst").where("a <> b").groupBy("a", "b").agg(F.count_distinct(e["kind"]).alias("kinds")),
    f"WITH {GRAPH} SELECT x.shard AS a, y.shard AS b, count(DISTINCT edges.kind) AS kinds FROM edges JOIN nodes x ON x.node = src JOIN nodes y ON y.node = dst WHERE x.shard <> y.shard GROUP BY 1, 2")
query("J17_local_graph", lambda spark, sf: (e := B.edges(spark, sf)).join((near := G.hops(B.around(spark, sf), _one(spark, "n7"), 1)).select(F.col("node").alias("src")), "src", "left_semi").join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "kind"),
    f"{_BFS('n7', 1)} SELECT src, dst, kind FROM edges WHERE src IN (SELECT node FROM w) AND dst IN (SELECT node FROM w)")
_CALLS = "cl AS (SELECT DISTINCT 'f' || (l_orderkey % 50) AS file, 'p' || l_partkey AS caller, 'n' || (l_suppkey % 90) AS callee FROM lineitem), fn AS (SELECT 'f' || (p_partkey % 50) AS file, 'p' || p_partkey AS node, 'n' || (p_partkey % 97) AS name FROM part)"
query("J9_call_resolution", lambda spark, sf: G.resolve_calls(
    B.read(spark, sf, "lineitem").select(F.concat(F.lit("f"), F.col("l_orderkey") % 50).alias("file"), F.concat(F.lit("p"), "l_partkey").alias("caller"), F.concat(F.lit("n"), F.col("l_suppkey") % 90).alias("callee")).distinct(),
    B.read(spark, sf, "part").select(F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("file"), F.concat(F.lit("p"), "p_partkey").alias("node"), F.concat(F.lit("n"), F.col("p_partkey") % 97).alias("name"))),
    f"WITH {_CALLS}, sm AS (SELECT file, name, count(*) AS c, min(node) AS x FROM fn GROUP BY file, name), al AS (SELECT name, count(*) AS c, min(node) AS x FROM fn GROUP BY name) "
    "SELECT DISTINCT src, dst, confidence FROM (SELECT caller AS src, CASE WHEN sm.c = 1 THEN sm.x WHEN al.c = 1 THEN al.x END AS dst, CAST(CASE WHEN sm.c = 1 THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence FROM cl LEFT JOIN sm ON sm.file = cl.file AND sm.name = callee LEFT JOIN al ON al.name = callee) WHERE dst IS NOT NULL AND src <> dst")  # fmt: skip
query("U4_last_write", lambda spark, sf: G.last_write(B.read(spark, sf, "lineitem").select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("edge"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position")), "edge", "position"),
    "SELECT edge, max(position) AS position FROM (SELECT l_partkey || '-' || l_suppkey AS edge, l_orderkey * 10 + l_linenumber AS position FROM lineitem) GROUP BY edge")
query("F9_span_overlap", lambda spark, sf: V.meeting(B.read(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("path"), F.col("o_custkey").alias("line_start"), (F.col("o_custkey") + 5).alias("line_end")), B.read(spark, sf, "nation").select(F.lit("F").alias("path"), (F.col("n_nationkey") * 10).alias("line_start"), (F.col("n_nationkey") * 10 + 2).alias("line_end"))).select("item"),
    "SELECT o_orderkey AS item FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM nation WHERE o_custkey <= n_nationkey * 10 + 2 AND n_nationkey * 10 <= o_custkey + 5)")
query("J14_innermost_definition", lambda spark, sf: V.innermost(B.read(spark, sf, "nation").select(F.lit("a").alias("path"), (F.col("n_nationkey") * 7).cast("long").alias("at")), B.read(spark, sf, "supplier").select(F.lit("a").alias("path"), F.col("s_suppkey").alias("item"), F.col("s_suppkey").alias("byte_start"), (F.col("s_suppkey") + 9).alias("byte_end"))),
    "SELECT 'a' AS path, CAST(n_nationkey * 7 AS BIGINT) AS at, max_by(s_suppkey, s_suppkey) AS item FROM nation JOIN supplier ON s_suppkey <= n_nationkey * 7 AND n_nationkey * 7 < s_suppkey + 9 GROUP BY 1, 2")
def _mentions(spark, sf):
    text = F.concat("text", F.lit(" `small ring` and `Supplier#"), F.lpad((F.col("doc_id") % 150).cast("string"), 9, "0"), F.lit("`"))
    said = B.read(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1)))).alias("name"))
    return R.sharing(said, B.nodes(spark, sf).where("kind in ('function', 'type')").select("name", "node"), "doc_id", "node", "name")


query("J12_doc_mentions", _mentions,
    f"WITH {B.NODES}, t AS (SELECT doc_id, unnest(regexp_extract_all(text || ' `small ring` and `Supplier#' || lpad(CAST(doc_id % 150 AS VARCHAR), 9, '0') || '`', '`([^`]+)`', 1)) AS name FROM documents) SELECT DISTINCT doc_id, node FROM t JOIN nodes USING (name) WHERE kind IN ('function', 'type')")
query("J13_containment", lambda spark, sf: B.read(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit(1.0).alias("confidence")), "SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst, CAST(1.0 AS DOUBLE) AS confidence FROM supplier")
query("J1_hits_by_memory", lambda spark, sf: hits(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.max("score").alias("best")), f"WITH {M}, {_HITS} SELECT category, count(*) AS n, max(score) AS best FROM hits GROUP BY category")

# order-dependent passes and text codecs
query("K13_failure_resolutions", lambda spark, sf: X.failure_resolutions(B.lines(spark, sf)))
# the queue: contradicted memories wait in it, the others arrive by id; the SQL takes one candidate at a time
_GREEDY = (
    f"WITH RECURSIVE {M}, s AS (SELECT memory_id AS id, contradicted AS waits, list_sort({_TOKENS('summary')}) AS t, {_CANON('summary')} AS c FROM memory), "
    "nb AS (SELECT x.id, list(y.id) AS near FROM s x JOIN s y ON x.id <> y.id AND (x.c = y.c OR (len(x.t) > 0 AND len(y.t) > 0 AND len(list_intersect(x.t, y.t)) >= 0.7 * least(len(x.t), len(y.t)))) GROUP BY x.id), "
    "o AS (SELECT s.id, row_number() OVER (ORDER BY s.id) AS no, coalesce(near, []) AS near FROM s LEFT JOIN nb USING (id) WHERE NOT waits), "
    "f(no, kept) AS (SELECT CAST(0 AS BIGINT), coalesce((SELECT list(id) FROM s WHERE waits), []) UNION ALL SELECT f.no + 1, CASE WHEN len(list_intersect(near, kept)) > 0 THEN kept ELSE list_append(kept, id) END FROM f JOIN o ON o.no = f.no + 1), "
    "k AS (SELECT kept FROM f ORDER BY no DESC LIMIT 1), "
    "q AS (SELECT s.id, waits, CASE WHEN list_contains(kept, s.id) THEN s.id ELSE (SELECT arg_min(z.id, CASE WHEN z.waits THEN z.id ELSE z.id + 1000000000 END) FROM s z WHERE list_contains(nb.near, z.id) AND list_contains(kept, z.id)) END AS survivor FROM s LEFT JOIN nb USING (id), k) "
)
_queue = lambda spark, sf: Q.enqueued(B.memory(spark, sf), "memory_id", "summary", "contradicted")
query("M12_greedy_enqueue", lambda spark, sf: Q.seen_counts(_queue(spark, sf)), f"{_GREEDY} SELECT survivor AS id, count(*) AS seen_count FROM q GROUP BY survivor")
query("M30_import_prediction", lambda spark, sf: Q.predicted(_queue(spark, sf)),
    f"{_GREEDY} SELECT count(*) AS total, count(*) FILTER (id = survivor) AS added, count(*) FILTER (id <> survivor) AS duplicate FROM q WHERE NOT waits")
query("T8_markdown_chunks", lambda spark, sf: files_.chunks(B.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("# Title\n"), F.regexp_replace("text", "\n", "\n\n")).alias("text"))))
_entries = lambda spark, sf: B.memory(spark, sf).select(F.col("memory_id").cast("string").alias("id"), F.col("store").alias("scope"), "category", "status", F.col("confidence").cast("string").alias("confidence"), F.col("created_at").cast("string").alias("created_at"), "body")
query("IO5_markdown_round_trip", lambda spark, sf: files_.from_markdown(files_.to_markdown(_entries(spark, sf))).select("id", "category", "status", "body"),
    f"WITH {M} SELECT CAST(memory_id AS VARCHAR) AS id, category, status, body FROM memory")
query("T27_json_payload", lambda spark, sf: B.memory(spark, sf).select("memory_id", F.get_json_object(files_.json_payload(F.concat(F.lit("<think>{x}</think>```json\n"), F.to_json(F.struct("memory_id", "category")), F.lit("\n```"))), "$.category").alias("category")),
    f"WITH {M} SELECT memory_id, category FROM memory")
