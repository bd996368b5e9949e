"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32_of_sha1(hexed: str) -> str:
    """SQL: 160 bits in hex as 32 base32 characters."""
    digit = lambda at: f"(strpos('0123456789abcdef', substr({hexed}, {at + 1}, 1)) - 1)"  # noqa: E731
    parts = []
    for i in range(32):
        nibble, skip = divmod(5 * i, 4)
        pair = f"({digit(nibble)} * 16 + {digit(nibble + 1) if nibble + 1 < 40 else '0'})"
        parts.append(f"substr('{_B32}', CAST(({pair} >> {3 - skip}) & 31 AS BIGINT) + 1, 1)")
    return " || ".join(parts)


OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(encode(body)) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM h GROUP BY hex)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_base32_of_sha1('hex')} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN f USING (hex)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, ws[i:i + 2] AS g FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS failed FROM b WHERE source IS NOT NULL GROUP BY source),
mo AS (SELECT avg(n) AS mean_n, coalesce(avg(failed / n), 0) AS m, coalesce(var_samp(failed / n), 0) AS v, avg(1.0 / n) AS inv FROM hosts),
pr AS (SELECT m, greatest(1.0, CASE WHEN v - m * (1 - m) * inv > 0 THEN m * (1 - m) / (v - m * (1 - m) * inv) - 1 ELSE mean_n END) AS s FROM mo),
verdict AS (SELECT source, (failed + m * s) / (n + s) <= 0.5 AS host_kept FROM hosts, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_kept, true) AS kept
FROM b LEFT JOIN verdict USING (source)
"""

#: The table of crc32: eight steps of a byte by shifts and the reflected polynomial.
_CRC_TABLE = """crc_table AS (WITH RECURSIVE r(i, k, v) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM r WHERE k < 8) SELECT list(v ORDER BY i) AS t FROM r WHERE k = 8)"""


def _crc32(text: str) -> str:
    """SQL: unsigned crc32 of an ASCII string, with crc_table in scope."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda v, b: xor(v >> 8, t[CAST(xor(v, b) & 255 AS BIGINT) + 1]), 4294967295), 4294967295)"


_BITS = lambda c, k: f"(({c} >> {k}) & 1)"  # noqa: E731
_Z = " + ".join(f"{_BITS(c, k)} * {1 << (4 * k + 3 - j)}" for k in range(4) for j, c in enumerate(("cn", "cs", "cd", "cl")))

OP12 = f"""
WITH {_CRC_TABLE},
v AS (SELECT doc_id, source, lang, CAST(coalesce(octet_length(encode(text)), -1) AS BIGINT) AS length, {_crc32('CAST(doc_id AS VARCHAR)')} % 365 AS date FROM documents, crc_table),
c AS (SELECT doc_id, 16 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // count(*) OVER () AS cs, 16 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // count(*) OVER () AS cl,
  16 * (rank() OVER (ORDER BY length) - 1) // count(*) OVER () AS cn, 16 * (rank() OVER (ORDER BY date) - 1) // count(*) OVER () AS cd FROM v),
p AS (SELECT *, {_Z} AS z FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM p),
f AS (SELECT *, position // 500 AS file FROM r),
b AS (SELECT file, min(cs) AS s0, max(cs) AS s1, min(cl) AS l0, max(cl) AS l1, min(cn) AS n0, max(cn) AS n1, min(cd) AS d0, max(cd) AS d1 FROM f GROUP BY file),
q AS (SELECT DISTINCT z, cs, cl, cn, cd FROM f),
t AS (SELECT z, count(*) AS files_touched FROM q JOIN b ON cs BETWEEN s0 AND s1 AND cl BETWEEN l0 AND l1 AND cn - 2 <= n1 AND cn + 2 >= n0 AND cd - 2 <= d1 AND cd + 2 >= d0 GROUP BY z),
m AS (SELECT q.z, count(DISTINCT f.file) AS files_matching FROM q JOIN f ON q.cs = f.cs AND q.cl = f.cl AND abs(q.cn - f.cn) <= 2 AND abs(q.cd - f.cd) <= 2 GROUP BY q.z)
SELECT doc_id, CAST(z AS BIGINT) AS z, CAST(position AS BIGINT) AS position, CAST(file AS BIGINT) AS file, files_touched, files_matching,
  concat_ws(',', s0, s1, l0, l1, n0, n1, d0, d1) AS file_bounds
FROM f JOIN b USING (file) JOIN t USING (z) JOIN m USING (z)
"""

OP13 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
lb AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
k AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
  + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g'))) > 3 * length(text) AS INT)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(doc_id > first AS INT) AS mask FROM w LEFT JOIN lb USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM k GROUP BY part, mask),
o(filter_order, step, bit, before) AS (SELECT '', 0, 0, 0 UNION ALL
  SELECT filter_order || chr(CAST(65 + i AS INT)), step + 1, 1 << i, before | bit FROM o, range(5) t(i) WHERE step < 5 AND ((before | bit) >> i) & 1 = 0),
orders AS (SELECT filter_order FROM o WHERE step = 5),
s AS (SELECT orders.filter_order, o.step, o.bit, o.before FROM orders JOIN o ON starts_with(orders.filter_order, o.filter_order) WHERE o.step > 0),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM m, s GROUP BY part, filter_order, step, bit),
sh AS (SELECT part, bit, sum(removed) AS shapley FROM r GROUP BY part, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM r JOIN sh USING (part, bit)
"""

ORACLES: dict[str, str] = {"op3_warc": OP3, "op10_rules": OP10, "op12_layout": OP12, "op13_interactions": OP13}
