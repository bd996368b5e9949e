"""Text functions and filters over memories and transcript lines (T*, F*, K13-K17)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions import text as T

from . import bindings as B

QUERIES, ORACLES = {}, {}

_low = lambda x: f"translate({x}, '{T.UPPER}', '{T.LOWER}')"
_q = lambda s: "'" + s.replace("'", "''") + "'"
_any = lambda x, markers: "(" + " OR ".join(f"contains({x}, {_q(m)})" for m in markers) + ")"
_starts = lambda x, markers: "(" + " OR ".join(f"starts_with({x}, {_q(m)})" for m in markers) + ")"
_list = lambda values: "[" + ", ".join(map(_q, values)) + "]"
_re = lambda x, p: f"regexp_matches({x}, {_q(p)})"


def over_memory(name: str, sql: str, **columns: Callable[[], Column]) -> None:
    """A query of columns computed from each memory, and its SQL twin."""
    QUERIES[name] = lambda spark, sf: B.memory(spark, sf).select("memory_id", *[c().alias(k) for k, c in columns.items()])
    ORACLES[name] = f"WITH {B.MEMORY} SELECT memory_id, {sql} FROM memory"


def over_lines(name: str, sql: str, **columns: Callable[[], Column]) -> None:
    QUERIES[name] = lambda spark, sf: B.lines(spark, sf).select("session", "line_no", *[c().alias(k) for k, c in columns.items()])
    ORACLES[name] = f"WITH {B.LINES} SELECT session, line_no, {sql} FROM lines"


_CANON = lambda x: f"translate(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^[\\s[:punct:]]+|[\\s[:punct:]]+$', '', 'g'), '{T.UPPER}', '{T.LOWER}')"
_TOKENS = lambda x: f"list_filter(list_distinct(list_filter(regexp_split_to_array({_low(x)}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) > 2)), lambda w: NOT list_contains({_list(T.STOP_WORDS)}, w))"

over_memory("T1_canonical", f"{_CANON('summary')} AS canonical", canonical=lambda: T.canonical("summary"))
over_memory("T3_token_set", f"list_sort({_TOKENS('body')}) AS tokens", tokens=lambda: F.array_sort(T.token_set("body")))
over_memory("T9_lesson_language", "CASE WHEN len(named) = 1 THEN named[1] END AS programming FROM (SELECT memory_id, list_filter([" + ", ".join(
    f"CASE WHEN {_re(_low('summary'), T.word_pattern(w))} THEN {_q(k)} END" for k, w in T.LANGUAGE_WORDS.items()) + "], lambda v: v IS NOT NULL) AS named FROM memory)", programming=lambda: T.lesson_language("summary"))
ORACLES["T9_lesson_language"] = ORACLES["T9_lesson_language"].removesuffix(" FROM memory")
over_memory(
    "T10_memory_language",
    f"CASE WHEN len(named) = 1 THEN named[1] WHEN list_contains({_list(T.LANGUAGE_BOUND)}, category) THEN language END AS resolved FROM (SELECT memory_id, category, language, list_filter(["
    + ", ".join(f"CASE WHEN {_re(_low('summary'), T.word_pattern(w))} THEN {_q(k)} END" for k, w in T.LANGUAGE_WORDS.items())
    + "], lambda v: v IS NOT NULL) AS named FROM memory)",
    resolved=lambda: T.memory_language(F.col("category"), F.col("summary"), F.col("language")),
)
ORACLES["T10_memory_language"] = ORACLES["T10_memory_language"].removesuffix(" FROM memory")
_VERSION = r"(^|[^A-Za-z0-9.])[vV]?[0-9]+\.[0-9]+($|[^A-Za-z0-9])"
over_memory("T14_version_sensitive", f"{_any(_low('summary'), T.VERSION_MARKERS)} OR {_re('summary', _VERSION)} AS versioned", versioned=lambda: T.version_sensitive("summary"))
_group = lambda groups, default: "CASE " + " ".join(f"WHEN list_contains({_list(v)}, category) THEN {k if isinstance(k, int) else _q(k)}" for k, v in groups.items()) + f" ELSE {default} END"
over_memory("T16_epistemic_status", f"{_group(T.EPISTEMIC, _q('observation'))} AS epistemic", epistemic=lambda: T.epistemic_status(F.col("category")))
over_memory("T17_default_destination", f"CASE WHEN list_contains({_list(T.GLOBAL_CATEGORIES)}, category) THEN 'global' ELSE 'project' END AS destination", destination=lambda: T.default_destination(F.col("category")))
over_memory("T19_body_prohibits", f"{_any(_low('body'), T.PROHIBITIONS)} AS prohibits", prohibits=lambda: T.prohibits("body"))
over_memory(
    "T20_is_contradiction",
    f"CASE WHEN memory_id % 2 = 0 THEN {_any(_low('summary'), T.NEGATIONS)} ELSE {_any(_low('summary'), ('contradict', 'no longer'))} END AS contradiction",
    contradiction=lambda: T.contradicts("summary", F.col("memory_id") % 2 == 0),
)
over_memory(
    "T22_summary",
    r"""CASE WHEN length(s) > 240 THEN substring(s, 1, 240) || '…' ELSE s END AS short FROM (SELECT memory_id, trim(regexp_replace(regexp_replace(regexp_replace(body, '^\s+', ''), '\n[ \t\r]*\n(.|\n)*$', ''), '\s+', ' ', 'g')) AS s FROM memory)""",
    short=lambda: T.first_paragraph("body"),
)
ORACLES["T22_summary"] = ORACLES["T22_summary"].removesuffix(" FROM memory")
over_memory("T23_truncate", "CASE WHEN length(summary) > 120 THEN substring(summary, 1, 120) || '…' ELSE summary END AS fragment", fragment=lambda: T.truncate("summary"))
over_memory("T23_truncate_body", "CASE WHEN length(body) > 200 THEN substring(body, 1, 200) || '…' ELSE body END AS fragment", fragment=lambda: T.truncate("body", 200))
over_memory("T26_slug", f"regexp_replace(regexp_replace({_low('summary')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug", slug=lambda: T.slug("summary"))
over_memory("T33_concise_body", "CASE WHEN instr(body, chr(10) || '```') > 0 AND trim(substring(body, 1, instr(body, chr(10) || '```') - 1)) <> '' THEN trim(substring(body, 1, instr(body, chr(10) || '```') - 1)) ELSE body END AS concise", concise=lambda: T.concise_body("body"))
over_memory("T35_stamp_device", "CASE WHEN store = 'project' AND memory_id % 3 = 0 THEN 'this' ELSE origin_device END AS stamped", stamped=lambda: F.when((F.col("store") == "project") & (F.col("memory_id") % 3 == 0), "this").otherwise(F.col("origin_device")))
over_memory("T36_digest", "sha256(body) AS digest, substr(sha256(category), 1, 16) AS author", digest=lambda: F.sha2(F.col("body").cast("binary"), 256), author=lambda: F.substring(F.sha2(F.col("category").cast("binary"), 256), 1, 16))


def _redacted(x: str) -> str:
    for kind, pattern in T.REDACTIONS:
        x = f"regexp_replace({x}, {_q(pattern)}, {_q(f'[REDACTED:{kind}]')}, 'g')"
    return x


over_memory("T7_redact", f"{_redacted('body')} AS redacted", redacted=lambda: T.redact("body"))


def _redaction_total(x: str) -> str:
    parts, now = [], x
    for kind, pattern in T.REDACTIONS:
        parts.append(f"len(regexp_extract_all({now}, {_q(pattern)}))")
        now = f"regexp_replace({now}, {_q(pattern)}, {_q(f'[REDACTED:{kind}]')}, 'g')"
    return " + ".join(parts)


QUERIES["A13_redaction_totals"] = lambda spark, sf: (
    B.memory(spark, sf).groupBy("category").agg(F.sum(T.redaction_total(T.redaction("body"))).alias("redactions"))
)
ORACLES["A13_redaction_totals"] = f"WITH {B.MEMORY} SELECT category, CAST(sum({_redaction_total('body')}) AS BIGINT) AS redactions FROM memory GROUP BY category"

over_memory("T29_remote_key", "lower(host) || '/' || lower(regexp_replace(source_session, '\\.git$', '')) AS key FROM (SELECT memory_id, source_session, CASE WHEN memory_id % 2 = 0 THEN 'Github.com/Org' ELSE 'gitlab.org/team' END AS host FROM memory)",
    key=lambda: T.remote_key(F.when(F.col("memory_id") % 2 == 0, F.concat(F.lit("git@Github.com:Org/"), "source_session", F.lit(".git"))).otherwise(F.concat(F.lit("https://me@gitlab.org/team/"), "source_session", F.lit("/")))))
ORACLES["T29_remote_key"] = ORACLES["T29_remote_key"].removesuffix(" FROM memory")
_PATHS = ("src/core/mod.rs", "src/lib.rs", "app/main.py", "README.md", "src/a/b.tar.gz")
_path = lambda: F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("memory_id") % len(_PATHS)).cast("int") + 1)
_sqlpath = f"{_list(_PATHS)}[CAST(memory_id % {len(_PATHS)} AS INT) + 1]"
over_memory(
    "T31_package_and_stem",
    f"CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS package, CASE WHEN list_contains(['mod', 'lib', 'main'], stem) AND regexp_extract(p, '([^/]+)/[^/]*$', 1) <> '' THEN regexp_extract(p, '([^/]+)/[^/]*$', 1) ELSE stem END AS stem FROM (SELECT memory_id, p, regexp_replace(string_split(p, '/')[-1], '\\.[^.]*$', '') AS stem FROM (SELECT memory_id, {_sqlpath} AS p FROM memory))",
    package=lambda: T.package_of(_path()), stem=lambda: T.module_stem(_path()),
)
ORACLES["T31_package_and_stem"] = ORACLES["T31_package_and_stem"].removesuffix(" FROM memory")
_EXTS = ("py", ".RS", "tsx", "hpp", "zig", "sh")
_ext = lambda: F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("memory_id") % len(_EXTS)).cast("int") + 1)
_WORDY = "regexp_extract(summary, '([A-Za-z]+)[^A-Za-z]*$', 1)"
over_memory("T11_extension_language", f"CASE lower(x) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'tsx' THEN 'typescript' WHEN 'hpp' THEN 'cpp' WHEN 'sh' THEN 'bash' END AS programming FROM (SELECT memory_id, CASE WHEN memory_id % 2 = 0 THEN {_list(_EXTS).replace(_q('.RS'), _q('RS'))}[CAST(memory_id % {len(_EXTS)} AS INT) + 1] ELSE {_WORDY} END AS x FROM memory)",
    programming=lambda: T.extension_language(F.when(F.col("memory_id") % 2 == 0, _ext()).otherwise(F.regexp_extract("summary", "([A-Za-z]+)[^A-Za-z]*$", 1))))
ORACLES["T11_extension_language"] = ORACLES["T11_extension_language"].removesuffix(" FROM memory")
over_memory("T32_verdict", f"CASE WHEN {_any(_low('said'), ('no_longer_true', 'no longer true'))} THEN 'no_longer_true' WHEN {_any(_low('said'), ('still_current', 'still current'))} THEN 'still_current' ELSE 'unknown' END AS verdict FROM (SELECT memory_id, summary || CASE memory_id % 5 WHEN 0 THEN ': this is NO LONGER TRUE, not still_current' WHEN 1 THEN ' Still current.' ELSE '' END AS said FROM memory)",
    verdict=lambda: T.verdict(F.concat("summary", F.when(F.col("memory_id") % 5 == 0, ": this is NO LONGER TRUE, not still_current").when(F.col("memory_id") % 5 == 1, " Still current.").otherwise(""))))
ORACLES["T32_verdict"] = ORACLES["T32_verdict"].removesuffix(" FROM memory")
_RAW = ("code pattern", " Security-Review ", "best practice for tests", "Gotcha", "cli usage", "doc_update", "workflow", "Weird Thing", "tool_use")
_raw = lambda: F.element_at(F.array(*map(F.lit, _RAW)), (F.col("memory_id") % len(_RAW)).cast("int") + 1)
_names = ("CodePattern", "SecurityWarning", "TestingStrategy", "AntiPattern", "ToolingNote", "DocumentationUpdate", "Process", "Weird Thing", "ToolUse")
over_memory("T18_map_category", f"{_list(_names)}[CAST(memory_id % {len(_RAW)} AS INT) + 1] AS mapped", mapped=lambda: T.category(_raw()))
QUERIES["T15_quality"] = lambda spark, sf: B.memory(spark, sf).select("memory_id", T.quality_label(F.col("category"), F.concat(F.col("summary"), F.lit("\n"))).alias("quality"))

# lines of transcripts
_strip = lambda x: f"regexp_replace({x}, '(?i)^(user|assistant|system|tool):\\s*', '')"
_cmd = lambda x: f"nullif(trim(regexp_extract({x}, '^(?:\\$ |> |PS> |❯ )(.*)$', 1)), '')"
_alpha = lambda x: f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: regexp_matches(w, '\\p{{L}}')))"
_code = lambda t: (
    f"({_re(t, '^(#|> |' + chr(92) + '||//)')} OR {_any(t, ('**', '.md:', '/archive/'))} OR {_re(t, '[{};,(' + chr(92) + '[:]$')} OR ends_with({t}, '=>') OR ends_with({t}, '\")]') "
    f"OR {_any(t, T.CODE_MARKERS)} OR ({_re(t, '^[-*] ')} AND {_any(t, ('.rs:', '.ps1:'))}))"
)
_adm = lambda x: (
    f"(trim({x}) <> '' AND NOT (NOT regexp_matches(trim(regexp_replace(trim({x}), '^[-* ]+', '')), '\\s') AND regexp_matches(trim(regexp_replace(trim({x}), '^[-* ]+', '')), '[/\\\\]')) "
    f"AND NOT {_code(f'trim({x})')} AND {_alpha(f'trim({x})')} >= 2 AND length(regexp_replace(trim({x}), '[^\\p{{L}}\\s]', '', 'g')) >= 0.65 * length(trim({x})))"
)
_lesson = lambda x: f"({_adm(x)} AND {_alpha(f'trim({x})')} >= 5)"
_fail_low = _low(f"trim({_strip('line')})")
_FAIL = (
    f"(({_starts(_fail_low, ('error', 'failed', 'failure', 'exception', 'panicked', 'traceback'))} OR ends_with({_fail_low}, 'failed') OR {_any(_fail_low, ('panicked at', 'test result: failed'))}) "
    f"AND NOT ({_any(_fail_low, ('0 errors', 'no errors', '0 failed', '0 failures', 'no failures'))} OR starts_with({_fail_low}, 'test result: ok')))"
)
over_lines("T24_prose_gates", f"{_adm('line')} AS admissible, {_lesson('line')} AS lesson_like", admissible=lambda: T.admissible("line"), lesson_like=lambda: T.lesson_like("line"))
over_lines(
    "T25_line_predicates", f"{_strip('line')} AS said, {_cmd('line')} AS command, {_FAIL} AS failure, {_any(_low('line'), T.RESOLUTIONS)} AS resolution",
    said=lambda: T.strip_speaker("line"), command=lambda: T.command_text("line"), failure=lambda: T.failure_line("line"), resolution=lambda: T.resolution_line("line"),
)

_bare = lambda x, cut: f"regexp_replace({x}, '{cut}', '')"
_first_line = _bare(f"regexp_extract(body, '^{T.SPACES}*([^\\n]*)', 1)", T.SPACES + "+$")
over_memory("T30_generic_skeleton", f"substring({_bare(_bare(_first_line, '[{]+$'), T.SPACES + '+$')}, 1, 200) AS skeleton", skeleton=lambda: T.generic_skeleton("body"))


def _definitions(spark, sf):
    """Functions with and without a body and tuple structs, whose comments and bodies are the texts."""
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    note = F.concat(F.lit("/* { "), F.replace("text", F.lit("*/"), F.lit(" ")), F.lit(" */"))
    function = F.concat(F.lit("pub fn f"), n, F.lit("(x: [u8; { 2 }], y: &'static str) -> u8 "), note, F.lit(" {\n"), F.col("text"), F.lit("\n}"))
    pair = F.concat(F.lit("pub(crate) struct S"), n, note, F.lit(" (f64, f64);"))
    required = F.concat(F.lit("fn g"), n, F.lit("(x: u8 "), note, F.lit(") -> char;;"))
    return B.read(spark, sf, "documents").select("doc_id", F.when(k % 3 == 0, function).when(k % 3 == 1, pair).otherwise(required).alias("source"))


_NOTE = "'/* { ' || replace(text, '*/', ' ') || ' */'"
QUERIES["T30_rust_skeleton"] = lambda spark, sf: _definitions(spark, sf).select("doc_id", T.rust_skeleton("source").alias("skeleton"))
ORACLES["T30_rust_skeleton"] = (
    f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pub fn f' || doc_id || '(x: [u8; {{ 2 }}], y: &''static str) -> u8 ' || {_NOTE} || ' {{ … }}' "
    f"WHEN 1 THEN 'pub(crate) struct S' || doc_id || {_NOTE} || ' {{ … }}' ELSE 'fn g' || doc_id || '(x: u8 ' || {_NOTE} || ') -> char' END AS skeleton FROM documents"
)
