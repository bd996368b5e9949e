"""Imports, file trees, parsing and ingest over the bound tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorekeep.functions import hashing as H
from lorekeep.functions import text as T
from lorekeep.operators import extraction as X
from lorekeep.operators import state as S
from lorekeep.operators.stages import folder
from lorekeep.sources import files as files_

from . import bindings as B
from .texts import _CANON, _TOKENS, _q, _redacted

QUERIES, ORACLES = {}, {}
M = B.MEMORY


def query(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def fnv_sql(x: str) -> str:
    """SQL: FNV-1a of a string's bytes as 16 hex digits."""
    byte = f"CAST('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS INT), 2) AS HUGEINT)"
    fold = f"list_reduce(list_transform(range(0, octet_length(encode({x}))), lambda i: {byte}), lambda a, b: (xor(a, b) * {H.PRIME}) % {H.MASK + 1}, {H.OFFSET}::HUGEINT)"
    return f"lpad(lower(hex(CAST({fold} AS UBIGINT))), 16, '0')"


query("T2_canonical_hash", lambda spark, sf: B.memory(spark, sf).select("memory_id", H.fnv_hex(T.canonical("summary")).alias("hash")), f"WITH {M}, c AS MATERIALIZED (SELECT memory_id, {_CANON('summary')} AS c FROM memory) SELECT memory_id, {fnv_sql('c')} AS hash FROM c")
query("T6_fingerprint", lambda spark, sf: B.memory(spark, sf).select("memory_id", H.fingerprint_hex(F.array("category", "summary")).alias("fingerprint")),
    f"WITH {M} SELECT memory_id, {fnv_sql('category || chr(31) || summary || chr(31)')} AS fingerprint FROM memory")
query("T5_near_duplicate", lambda spark, sf: B.memory(spark, sf).select("memory_id", (T.overlap(T.token_set("summary"), T.token_set(F.concat("category", F.lit(" "), F.substring("body", 1, 200)))) >= 0.7).alias("near")),
    f"WITH {M} SELECT memory_id, CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0.0 END >= 0.7 AS near FROM (SELECT memory_id, {_TOKENS('summary')} AS a, {_TOKENS(chr(40) + 'category || chr(32) || substring(body, 1, 200)' + chr(41))} AS b FROM memory)")

# transcripts: redacted first, then named by their text
_whole = lambda spark, sf: B.read(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), B._phrase(F.col("conv_id") + F.col("turn")), F.lit("\n"), "text").alias("raw"))
_RAW = f"SELECT conv_id, turn, {_redacted('role || ' + _q(': ') + ' || ' + B._sql_list(B.PHRASES) + f'[CAST((conv_id + turn) % {len(B.PHRASES)} AS INT) + 1] || chr(10) || text')} AS x FROM conversations"
query("IO1_import_transcript", lambda spark, sf: files_.import_transcripts(_whole(spark, sf), "raw", "GenericTranscript", "PlainText").select("conv_id", "turn", "session_id", "redacted", "format"),
    f"SELECT conv_id, turn, {fnv_sql(_q('GenericTranscript') + ' || chr(10) || x')} AS session_id, x AS redacted, 'PlainText' AS format FROM ({_RAW})")


def _tree(spark, sf):
    """Documents written as files of a folder each, and the tree read back."""
    root = f"{folder(spark)}/tree-{uuid.uuid4().hex}"
    docs = B.read(spark, sf, "documents").where("source is not null").select(F.regexp_replace("text", r"[\r\n]", " ").alias("value"), F.col("source").alias("shelf"))
    docs.write.partitionBy("shelf").text(root)
    return files_.tree(spark, root, ("txt",))


query("IO3_tree_round_trip", lambda spark, sf: _tree(spark, sf).select(F.regexp_extract("path", "shelf=([^/]+)/", 1).alias("source"), F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line")).groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars")),
    "SELECT source, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE source IS NOT NULL GROUP BY source")
_paths = ("docs/a.md", "../out.md", "/abs.md", "target/x.md", "src/secret/key.md", "src/ok.rs")
_path = lambda: F.element_at(F.array(*map(F.lit, _paths)), (F.col("doc_id") % 6).cast("int") + 1)
query("IO4_boundary", lambda spark, sf: (p := files_.admitted(B.read(spark, sf, "documents").select("doc_id", _path().alias("path")), ("secret", "target/")))[0].select("doc_id", F.lit(True).alias("kept")).unionAll(p[1].select("doc_id", F.lit(False))),
    "SELECT doc_id, doc_id % 6 IN (0, 5) AS kept FROM documents")
_notes = lambda: F.concat(F.lit("# L\n- first lesson number "), "doc_id", F.lit(" goes\n  on here\nplain\n- short\n- [link](to a place that is long)\n- second lesson of "), "lang")
query("IO10_lesson_bullets", lambda spark, sf: B.read(spark, sf, "documents").select("doc_id", F.explode(files_.bullets(_notes())).alias("bullet")),
    "SELECT doc_id, unnest(CASE WHEN length('second lesson of ' || lang) >= 20 THEN ['first lesson number ' || doc_id || ' goes on here', 'second lesson of ' || lang] ELSE ['first lesson number ' || doc_id || ' goes on here'] END) AS bullet FROM documents")
query("IO21_import_lessons", lambda spark, sf: B.read(spark, sf, "documents").select("doc_id", F.explode(files_.bullets(_notes())).alias("bullet")).groupBy(T.canonical("bullet").alias("c")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("seen_count")).select("doc_id", "seen_count"),
    "SELECT doc_id, 1 AS seen_count FROM documents WHERE length('second lesson of ' || lang) < 20 OR lang IS NULL UNION ALL SELECT doc_id, 1 FROM documents WHERE length('second lesson of ' || lang) >= 20 UNION ALL SELECT min(doc_id), count(*) FROM documents WHERE length('second lesson of ' || lang) >= 20 GROUP BY lang")
query("IO19_session_candidates", lambda spark, sf: B.lines(spark, sf).select(F.from_json(F.to_json(F.struct("session", "line_no", "line")), "session long, line_no long, line string").alias("x")).select("x.*").groupBy("session", T.canonical("line").alias("c")).agg(F.min("line_no").alias("line_no"), F.count("*").alias("seen_count")).select("session", "line_no", "seen_count"),
    f"WITH {B.LINES} SELECT session, min(line_no) AS line_no, count(*) AS seen_count FROM lines GROUP BY session, {_CANON('line')}")
query("M11_ingest_docs", lambda spark, sf: (d := B.read(spark, sf, "documents").where("source is not null")) and S.replace_by_path(d.select(F.col("source").alias("path"), F.lit(-1).cast("long").alias("ordinal"), F.lit("old").alias("body")).distinct(), files_.chunks(d.where("source <> 'src4'").select(F.col("source").alias("path"), F.lit("# T\n\nshort text").alias("text")).distinct()).select("path", F.col("ordinal").cast("long").alias("ordinal"), "body")).select("path", "ordinal"),
    "SELECT DISTINCT source AS path, CAST(CASE WHEN source = 'src4' THEN -1 ELSE 0 END AS BIGINT) AS ordinal FROM documents WHERE source IS NOT NULL")

# parsing and ingest of sources
_code = lambda spark, sf: B.read(spark, sf, "part").select(F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("path"), F.concat(F.lit("def f"), "p_partkey", F.lit("():\n    return g"), F.col("p_partkey") % 7, F.lit("()\n\nclass C:\n    def test_it(self):\n        f"), "p_partkey", F.lit("()\n"), F.when(F.col("p_partkey") < 7, F.concat(F.lit("\ndef g"), "p_partkey", F.lit("():\n    pass\n"))).otherwise("")).alias("text"))
_ITEMS = "it AS (SELECT 'm' || p_partkey || '.py' AS path, unnest(['function', 'type', 'test']) AS kind, unnest(['m' || p_partkey || '.py::f' || p_partkey, 'm' || p_partkey || '.py::C', 'm' || p_partkey || '.py::C::test_it']) AS name, unnest([1, 4, 5]) AS line_start, unnest([2, 6, 6]) AS line_end FROM part UNION ALL SELECT 'm' || p_partkey || '.py', 'function', 'm' || p_partkey || '.py::g' || p_partkey, 8, 9 FROM part WHERE p_partkey < 7)"
query("G10_parse_sources", lambda spark, sf: X.parse_files(_code(spark, sf)), f"WITH {_ITEMS} SELECT path, kind, name, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end FROM it")
query("G11_ingest_edges", lambda spark, sf: X.ingest(_code(spark, sf))[1],
    f"WITH {_ITEMS} SELECT path AS src, name AS dst, 'contains' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM it UNION ALL "
    "SELECT 'm' || p_partkey || '.py::f' || p_partkey, 'm' || (p_partkey % 7) || '.py::g' || (p_partkey % 7), 'calls', CAST(CASE WHEN p_partkey < 7 THEN 0.9 ELSE 0.6 END AS DOUBLE) FROM part UNION ALL "
    "SELECT 'm' || p_partkey || '.py::C::test_it', 'm' || p_partkey || '.py::f' || p_partkey, 'calls', CAST(0.9 AS DOUBLE) FROM part UNION ALL "
    "SELECT 'm' || p_partkey || '.py::f' || p_partkey, 'm' || p_partkey || '.py::C::test_it', 'tested_by', CAST(1.0 AS DOUBLE) FROM part")  # fmt: skip
query("G12_file_nodes", lambda spark, sf: X.ingest(_code(spark, sf))[0].groupBy("kind").agg(F.count("*").alias("n")), f"WITH {_ITEMS} SELECT kind, count(*) AS n FROM it GROUP BY kind UNION ALL SELECT 'file', count(*) FROM part")
# edges of calls and uses are known; uses come again with another confidence, and containment is new
_edge = lambda e, kinds, confidence: e.where(F.col("kind").isin(*kinds)).select(F.concat_ws(">", "src", "dst", "kind").alias("edge"), F.lit(confidence).alias("confidence"))
query("M20_upsert_edges", lambda spark, sf: S.upsert(_edge(e := B.edges(spark, sf), ("calls", "uses"), 0.6), _edge(e, ("uses", "contains"), 0.9), "edge"),
    f"WITH {B.EDGES} SELECT src || '>' || dst || '>' || kind AS edge, CAST(CASE WHEN kind = 'calls' THEN 0.6 ELSE 0.9 END AS DOUBLE) AS confidence FROM edges")
query("M24_reindex_run", lambda spark, sf: X.reindex(X.ingest(_code(spark, sf).where("path <> 'm3.py'"))[0], _code(spark, sf).where("path <> 'm5.py'"), _code(spark, sf).where("path in ('m3.py')")).groupBy("state").agg(F.count("*").alias("n")),
    f"WITH {_ITEMS}, al AS (SELECT path FROM it UNION ALL SELECT 'm' || p_partkey || '.py' FROM part) SELECT CASE WHEN path = 'm5.py' THEN 'pruned' WHEN path = 'm3.py' THEN 'indexed' ELSE 'kept' END AS state, count(*) AS n FROM al GROUP BY 1")
query("R7_search_states", lambda spark, sf: B.read(spark, sf, "documents").join(B.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left").groupBy("source").agg(F.count_if(F.col("source") != "src2").alias("chunks"), F.count("label").alias("vectors"), F.count_if(F.col("label") > 2).alias("matching")).select("source", X.search_state(F.col("chunks"), F.col("source") != "src4", F.col("source") != "src5", F.when(F.col("source") == "src6", 0).otherwise(F.col("vectors")), F.col("matching")).alias("state")),
    "SELECT source, CASE WHEN count(*) FILTER (source <> 'src2') = 0 THEN 'NoDocChunks' WHEN source = 'src4' THEN 'EmbeddingsNotConfigured' WHEN source = 'src5' THEN 'EndpointUnavailable' WHEN source = 'src6' OR count(label) = 0 THEN 'NoDocVectors' WHEN count(*) FILTER (label > 2) = 0 THEN 'IndexMismatch' ELSE 'Searched' END AS state FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source")
