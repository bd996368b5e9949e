"""Secret scans, in Catalyst expressions only.

Three fixed patterns give the base spans.  The method adds spans of high
entropy: candidate strings are runs of a secret alphabet, a window slides over
each with per-symbol counts kept incrementally (one symbol enters, one leaves),
and a window whose Shannon entropy passes its character class's threshold marks
the candidate.  Allow-listed candidates are suppressed; base spans never are.

Edge cases: a null text counts as empty and has no spans; repeated rows give
repeated results; spans that start together are ordered by kind; an empty table
gives no rows; very long texts and candidates take time in proportion (folds copy
nothing that grows); other columns of the input are carried along untouched, but
for columns named secret_base and secret_spans, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of their matches.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
WINDOW = 20
HEX_BITS = 3.0
BASE64_BITS = 3.9
#: Candidates that look random but are no secrets: UUIDs, placeholders, counting sequences.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"(?i)abcdefgh|01234567|12345678",
)


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(values: str, zero: str, op) -> str:
    """SQL: for each of an array of ints, ``op`` over those before it.

    Two levels of blocks: a plain fold would copy its growing array at each step.
    """
    size = 64
    part = f"slice(v, cast(b * {size} + 1 as int), {size})"
    blocks = f"sequence(0, cast((size(v) - 1) div {size} as int))"
    fold = lambda seq, start: f"aggregate({seq}, array({start}), (acc, x) -> concat(acc, array({op('element_at(acc, -1)', 'x')})))"
    heads = fold(f"transform({blocks}, b -> aggregate({part}, {zero}, (acc, x) -> {op('acc', 'x')}))", zero)
    inner = f"slice({fold(part, 'h[b]')}, 1, size({part}))"
    return (
        f"transform(array({values}), v -> CASE WHEN size(v) = 0 THEN cast(array() as array<int>) "
        f"ELSE transform(array({heads}), h -> flatten(transform({blocks}, b -> {inner})))[0] END)[0]"
    )


def _sum(a: str, b: str) -> str:
    return f"{a} + {b}"


def _greatest(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _matches(text: str, pattern: str) -> str:
    """SQL: array of struct(s, e, hit) for the matches of a pattern, null if there is none.

    Offsets count code points, from a running sum over the pieces between matches
    and the matches themselves.
    """
    p = _quote(pattern)
    pieces = f"zip_with(regexp_extract_all({text}, {p}, 0), slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), (h, g) -> named_struct('hit', h, 'gap', length(g)))"
    ahead = _running("transform(m, x -> x.gap + length(x.hit))", "0", _sum)
    span = "named_struct('s', a + x.gap, 'e', a + x.gap + length(x.hit), 'hit', x.hit)"
    return f"CASE WHEN {text} RLIKE {p} THEN transform(array({pieces}), m -> zip_with(m, {ahead}, (x, a) -> {span}))[0] END"


def _entropy(hit: str, alphabet: str, bits: float, window: int) -> str:
    """SQL: struct(first, last) of the high-entropy windows of ``hit``, or -1 and -1.

    The fold keeps one count per symbol and the sum of c*log2(c); each step takes
    the symbol that leaves the window out of them and adds the one that enters, so
    that the entropy log2(window) - sum/window costs no recount.
    """
    gain = ", ".join(f"{k * math.log2(k) if k else 0.0!r}D" for k in range(window + 2))
    a, n = _quote(alphabet), len(alphabet)
    codes = f"transform(slice(split({hit}, ''), 1, length({hit})), x -> instr({a}, x) - 1)"
    moves = f"transform(array({codes}), c -> zip_with(c, concat(array_repeat(-1, {window}), slice(c, 1, greatest(size(c) - {window}, 0))), (i, o) -> named_struct('i', i, 'o', o)))[0]"
    left = "CASE WHEN x.o >= 0 THEN acc.c[x.o] ELSE 0 END"
    came = "acc.c[x.i] - CASE WHEN x.o = x.i THEN 1 ELSE 0 END"
    change = f"CASE WHEN x.o >= 0 THEN g[{left} - 1] - g[{left}] ELSE 0D END + g[{came} + 1] - g[{came}]"
    hot = f"t.n >= {window} AND {math.log2(window)!r}D - t.s / {window} >= {bits!r}D"
    step = (
        f"transform(array(named_struct('n', acc.n + 1, 's', acc.s + {change})), t -> named_struct("
        "'c', transform(acc.c, (v, k) -> v + CASE WHEN k = x.i THEN 1 ELSE 0 END - CASE WHEN k = x.o THEN 1 ELSE 0 END), 'n', t.n, 's', t.s, "
        f"'first', CASE WHEN acc.first < 0 AND {hot} THEN t.n - {window} ELSE acc.first END, 'last', CASE WHEN {hot} THEN t.n ELSE acc.last END))[0]"
    )
    start = f"named_struct('c', array_repeat(0, {n}), 'n', 0, 's', 0D, 'first', -1, 'last', -1)"
    fold = f"aggregate(moves, {start}, (acc, x) -> {step}, acc -> named_struct('first', acc.first, 'last', acc.last))"
    return f"transform(array({moves}), moves -> transform(array(array({gain})), g -> {fold})[0])[0]"


def secret_spans(
    docs: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    hex_bits: float = HEX_BITS,
    base64_bits: float = BASE64_BITS,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """``docs`` with ``secret_base`` and ``secret_spans``: arrays of struct(s, k, e), by start and kind.

    ``k`` indexes KINDS, from 0; offsets count code points, the end is exclusive.
    ``secret_spans`` holds the base spans and those of the entropy windows; a window
    inside a base span is not reported again.
    """
    t, none = "_secret_text", "cast(array() as array<struct<s:int,k:int,e:int>>)"

    def spans(kind: int, pattern: str, where: str = "true") -> str:
        return f"coalesce(transform(filter({_matches(t, pattern)}, x -> {where}), x -> named_struct('s', x.s, 'k', {kind}, 'e', x.e)), {none})"

    base = ", ".join([spans(0, ASSIGN, f"length(regexp_extract(x.hit, {_quote(ASSIGN)}, 2)) >= 8"), spans(1, ACCESS), spans(2, HEX)])
    suspect = " AND ".join(["x.hit RLIKE '[0-9]'", "x.hit RLIKE '[A-Za-z]'", *(f"NOT x.hit RLIKE {_quote(a)}" for a in allow)])
    windows = (
        f"transform(filter({_matches(t, CANDIDATE)}, x -> {suspect}), x -> named_struct('s', x.s, 'hex', x.hit RLIKE '^[0-9A-Fa-f]+$', 'w', "
        f"CASE WHEN x.hit RLIKE '^[0-9A-Fa-f]+$' THEN {_entropy('lower(x.hit)', '0123456789abcdef', hex_bits, window)} ELSE {_entropy('x.hit', BASE64, base64_bits, window)} END))"
    )
    hot = f"coalesce(transform(filter({windows}, x -> x.w.first >= 0), x -> named_struct('s', x.s + x.w.first, 'k', CASE WHEN x.hex THEN 3 ELSE 4 END, 'e', x.s + x.w.last)), {none})"
    # in the joint order a window lies within a base span if one before it ends no earlier
    reach = _running("transform(o, x -> CASE WHEN x.k < 3 THEN x.e ELSE 0 END)", "0", _greatest)
    found = f"transform(array(array_sort(concat(secret_base, _secret_hot))), o -> transform(filter(zip_with(o, {reach}, (x, r) -> named_struct('x', x, 'r', r)), y -> y.x.k < 3 OR y.r < y.x.e), y -> y.x))[0]"
    out = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn("secret_base", F.expr(f"array_sort(concat({base}))")).withColumn("_secret_hot", F.expr(hot))
    out = out.withColumn("secret_spans", F.expr(f"CASE WHEN size(_secret_hot) = 0 THEN secret_base ELSE {found} END"))
    return out.drop("_secret_hot", t)


def joined(spans: str):
    """The spans as text: kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by ``mark``.

    Overlapping spans are merged first.  A null text stays null.
    """
    out = secret_spans(docs, text)
    quoted = "`" + text.replace("`", "``") + "`"
    ends = "transform(secret_spans, x -> x.e)"
    # what stands between a span and the furthest end before it, and a mark for the span
    parts = (
        f"transform(filter(zip_with(secret_spans, {_running(ends, '0', _greatest)}, (x, r) -> named_struct('s', x.s, 'r', r)), y -> y.s >= y.r), "
        f"y -> concat(substring({quoted}, y.r + 1, y.s - y.r), {_quote(mark)}))"
    )
    clean = f"concat(array_join({parts}, ''), substring({quoted}, array_max({ends}) + 1))"
    return out.withColumn(text, F.expr(f"CASE WHEN {quoted} IS NULL THEN NULL WHEN size(secret_spans) = 0 THEN {quoted} ELSE {clean} END")).drop("secret_base", "secret_spans")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts per kind, the digest of the base spans, and all spans."""
    out = secret_spans(docs.select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(secret_base, x -> x.k = {k})) as bigint)")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined("secret_base").cast("binary"), 256).alias("base_sha256"),
        joined("secret_spans").alias("spans"),
    )
