"""Scalar text functions, as Column expressions that stay inside code generation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words and markers that decide results.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "to", "of", "in", "on", "for", "with", "is", "are", "be",
    "this", "that", "it", "as", "at", "by", "from", "use", "using",
)
QUERY_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "can", "could", "did", "do", "does",
    "for", "from", "how", "i", "in", "into", "is", "it", "its", "not", "of", "on", "or", "our",
    "should", "that", "the", "these", "this", "those", "to", "was", "we", "were", "what", "when",
    "where", "which", "who", "why", "will", "with", "would", "you", "your",
)
LANGUAGE_WORDS = {
    "python": ("python", "python3", "pytest", "virtualenv"),
    "rust": ("rust", "cargo", "rustc", "clippy", "rustup"),
    "javascript": ("javascript", "node.js", "nodejs", "npm"),
    "typescript": ("typescript", "tsc"),
    "go": ("golang", "goroutine", "go.mod", "go build", "go test", "go vet", "go run", "go mod", "go fmt", "fmt.errorf", "go:"),
    "cpp": ("c++", "g++", "clang++"),
    "csharp": ("c#", "csharp", "dotnet", ".net"),
    "java": ("java",),
    "powershell": ("powershell", "pwsh", "cmdlet"),
    "bash": ("bash", "pipefail", "shellcheck"),
    "ruby": ("ruby", "rails"),
}
LANGUAGE_EXTENSIONS = {
    "python": ("py", "pyi", "pyw"), "rust": ("rs",), "javascript": ("js", "mjs", "cjs", "jsx"), "typescript": ("ts", "tsx"),
    "go": ("go",), "cpp": ("cpp", "cc", "cxx", "hpp", "hh"), "csharp": ("cs",), "java": ("java",), "powershell": ("ps1", "psm1"),
    "bash": ("sh", "bash"), "ruby": ("rb",),
}
LANGUAGE_BOUND = ("CodePattern", "AntiPattern", "DebuggingRecipe", "TestingStrategy")
VERSION_MARKERS = ("deprecat", "msrv", "nightly", "cuda", "no longer", "edition", "end of life", "eol")
PROHIBITIONS = ("do not", "don't", "never ", "avoid ", "stop ", "no longer", "instead of", "must not", "should not", "shouldn't")
NEGATIONS = ("do not", "don't", "never", "no longer", "instead", "avoid", "stop ", "rather than", "deprecated", "not ", "isn't")
TOOLING_PHRASES = (
    "working directory", "current directory", "path formatting", "path handling", "npm install", "windows shell",
    "windows environment", "shell command", "gradle build", "build tool", "package install",
)
TOOLING_WORDS = ("gradlew", "powershell", "cwd", "chdir", "enoent", "gradle")
HEDGES = ("might", "maybe", "perhaps", "possibly", "seems", "appears")
NARRATIONS = ("resolved test failure", "was thrown as", "added an extra", "test expected", "fixed the test where")
SKILL_INTENTS = (
    "create a skill", "create skill for", "add a skill", "turn this into a skill", "turn it into a skill", "could be a reusable",
    "would be a reusable", "would make a good skill", "worth turning into a skill",
)
RESOLUTIONS = ("fixed", "fix was", "fix:", "resolved", "works now", "passing", "passed", "succeeded", "solution")
CORRECTIONS = ("no,", "no ", "actually", "instead", "don't", "do not", "stop ", "that's wrong", "that is wrong", "not what")
CODE_MARKERS = ("fn ", "=>", "impl ", "pub use", "pub fn", "#[", "Result<", "Box<dyn", "{reason}", ":new(", "let mut ", "});")
#: Exact names first, then words looked for in this order.
# Names of categories and the words that stand for them.
CATEGORY_NAMES = {
    "user_preference": "UserPreference", "project_convention": "ProjectConvention", "architecture_rule": "ArchitectureRule",
    "code_pattern": "CodePattern", "debugging_recipe": "DebuggingRecipe", "tooling_note": "ToolingNote", "testing_strategy": "TestingStrategy",
    "deployment_rule": "DeploymentRule", "anti_pattern": "AntiPattern", "security_warning": "SecurityWarning",
    "documentation_update": "DocumentationUpdate", "candidate_skill": "CandidateSkill", "process": "Process", "tool_use": "ToolUse",
}
# Names of categories and the words that stand for them.
CATEGORY_WORDS = (
    (("convention",), "ProjectConvention"), (("architecture",), "ArchitectureRule"), (("security",), "SecurityWarning"), (("deploy",), "DeploymentRule"),
    (("test",), "TestingStrategy"), (("doc",), "DocumentationUpdate"), (("anti", "pitfall", "gotcha", "best_practice", "avoid", "mistake"), "AntiPattern"),
    (("debug", "recipe", "troubleshoot"), "DebuggingRecipe"), (("tool", "command", "cli"), "ToolingNote"), (("process", "workflow"), "Process"),
    (("preference",), "UserPreference"), (("pattern",), "CodePattern"),
)
#: Redaction rules in order: a span goes to the first rule that matches it.
# The rules of redaction, in their order.
REDACTIONS = (
    ("private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws_access_key_id", r"\b(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}\b"),
    ("aws_secret_access_key", r"""(?i)\baws[_-]?(?:secret[_-]?(?:access[_-]?)?key|sk)["']?\s*[:=]\s*["']?[A-Za-z0-9/+=]{40}\b"""),
    ("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}\b"),
    ("openai_api_key", r"\bsk-[A-Za-z0-9][A-Za-z0-9_-]{16,}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b"),
    ("bearer_token", r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}"),
    ("password_assignment", r"""(?i)\b(?:password|passwd|pwd)["']?\s*[:=]\s*['"]?[^'"\s;\[]{4,}"""),
    ("token_assignment", r"""(?i)\b(?:api[_-]?key|token|secret|credentials?)["']?\s*[:=]\s*['"]?[^'"\s;\[]{16,}"""),
    ("env_secret_assignment", r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_(?:KEY|SECRET|TOKEN|PASSWORD|PASSWD|PWD)\s*=\s*\S{6,}"),
    ("url_credentials", r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/\s:@]+:[^@\s/]{3,}@"),
)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x: str | Column) -> Column:
    return F.translate(col(x), UPPER, LOWER)


def has_any(x: Column, markers) -> Column:
    """Whether any of the strings occurs."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(x, F.lit(m))
    return out


def starts_any(x: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.startswith(x, F.lit(m))
    return out


def word_pattern(words) -> str:
    """Whole words bounded by anything but ASCII letters and digits."""
    return "(^|[^a-z0-9])(" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + ")([^a-z0-9]|$)"


def canonical(x: str | Column) -> Column:
    """White space collapsed, punctuation trimmed, ASCII lower case: the exact-duplicate key."""
    flat = F.regexp_replace(col(x), r"\s+", " ")
    return ascii_lower(F.regexp_replace(flat, r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", ""))


def token_set(x: str | Column) -> Column:
    """Distinct alphanumeric words of more than two bytes without stop words."""
    words = F.split(ascii_lower(x), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.octet_length(w) > 2)), F.array(*map(F.lit, STOP_WORDS)))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets, 0 where either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def redact(x: str | Column) -> Column:
    """Rules in order; later rules see what earlier ones left."""
    out = col(x)
    for kind, pattern in REDACTIONS:
        out = F.regexp_replace(out, pattern, f"[REDACTED:{kind}]")
    return out


def redaction(x: str | Column) -> Column:
    """text and counts: what ``redact`` makes of a text, and each rule's matches in order; each rule sees what earlier ones left.

    A text is searched once by each rule, and cut only where the rule matched: an array of one
    state goes through the rules, since a nested expression would be worked out again for each count.
    """
    state = F.array(F.struct(col(x).alias("text"), F.array().cast("array<bigint>").alias("counts")))
    for kind, pattern in REDACTIONS:
        state = F.transform(state, _counted(pattern))
        left = lambda s, k=kind, p=pattern: F.when(s["n"] > 0, F.regexp_replace(s["text"], p, f"[REDACTED:{k}]")).otherwise(s["text"])
        state = F.transform(state, _step(left))
    return F.element_at(state, 1)


def _counted(pattern: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["text"].alias("text"), s["counts"].alias("counts"), F.regexp_count(s["text"], F.lit(pattern)).cast("long").alias("n"))


def _step(left: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: F.struct(left(s).alias("text"), F.concat(s["counts"], F.array(s["n"])).alias("counts"))


def redaction_total(done: Column) -> Column:
    """How many matches a ``redaction`` had; 0 of a null text."""
    return F.aggregate(done["counts"], F.lit(0).cast("long"), lambda a, n: a + F.coalesce(n, F.lit(0)))


def redaction_counts(x: str | Column) -> Column:
    """Map of rule to matches, for rules that matched; each rule sees what earlier ones left."""
    counts = F.transform(redaction(x)["counts"], lambda n, k: F.struct(F.element_at(F.array(*[F.lit(kind) for kind, _ in REDACTIONS]), k + 1).alias("key"), n.alias("value")))
    return F.map_from_entries(F.filter(counts, lambda c: c["value"] > 0))


def lesson_language(x: str | Column) -> Column:
    """The one programming language named as a whole word, or null."""
    low = ascii_lower(x)
    named = F.filter(F.array(*[F.when(F.rlike(low, F.lit(word_pattern(words))), F.lit(lang)) for lang, words in LANGUAGE_WORDS.items()]), lambda v: v.isNotNull())
    return F.when(F.size(named) == 1, F.element_at(named, 1))


def memory_language(category: Column, body: Column, session: Column) -> Column:
    return F.coalesce(lesson_language(body), F.when(category.isin(*LANGUAGE_BOUND), session))


def extension_language(ext: str | Column) -> Column:
    low = ascii_lower(F.regexp_replace(col(ext), r"^\.+", ""))
    out = F.lit(None).cast("string")
    for lang, exts in LANGUAGE_EXTENSIONS.items():
        out = F.when(low.isin(*exts), F.lit(lang)).otherwise(out)
    return out


def version_sensitive(x: str | Column) -> Column:
    return has_any(ascii_lower(x), VERSION_MARKERS) | F.rlike(col(x), F.lit(r"(^|[^A-Za-z0-9.])[vV]?[0-9]+\.[0-9]+($|[^A-Za-z0-9])"))


def prohibits(x: str | Column) -> Column:
    return has_any(ascii_lower(x), PROHIBITIONS)


def contradicts(candidate: str | Column, has_related: Column) -> Column:
    low = ascii_lower(candidate)
    return F.when(has_related, has_any(low, NEGATIONS)).otherwise(has_any(low, ("contradict", "no longer")))


# What a category says about its memories.
EPISTEMIC = {
    "decision": ("UserPreference", "ProjectConvention", "ArchitectureRule", "DeploymentRule", "AntiPattern"),
    "procedure": ("CodePattern", "DebuggingRecipe", "TestingStrategy", "CandidateSkill", "Process", "ToolUse"),
    "fact": ("SecurityWarning",),
}
GLOBAL_CATEGORIES = ("UserPreference", "ToolingNote", "ToolUse", "DebuggingRecipe", "Process", "AntiPattern")
TIERS = {
    5: ("SecurityWarning", "UserPreference", "ProjectConvention", "ArchitectureRule", "DeploymentRule"),
    4: ("AntiPattern", "TestingStrategy", "Process"),
    3: ("DebuggingRecipe", "CodePattern", "ToolUse"),
    2: ("ToolingNote", "DocumentationUpdate"),
}


def by_group(x: Column, groups: dict, default) -> Column:
    """The key of the group that holds a value."""
    out = F.lit(default)
    for key, names in groups.items():
        out = F.when(x.isin(*names), F.lit(key)).otherwise(out)
    return out


def epistemic_status(category_: Column) -> Column:
    return by_group(category_, EPISTEMIC, "observation")


def default_destination(category_: Column) -> Column:
    return F.when(category_.isin(*GLOBAL_CATEGORIES), "global").otherwise("project")


def category(raw: str | Column) -> Column:
    """Free-text category: exact names, then ordered substrings, else the trimmed input."""
    low = F.regexp_replace(ascii_lower(F.trim(col(raw))), "[ -]", "_")
    out = F.trim(col(raw))
    for words, name in reversed(CATEGORY_WORDS):
        out = F.when(has_any(low, words), F.lit(name)).otherwise(out)
    for key, name in CATEGORY_NAMES.items():
        out = F.when(low == key, F.lit(name)).otherwise(out)
    return out


def truncate(x: str | Column, n: int = 120) -> Column:
    return F.when(F.char_length(col(x)) > n, F.concat(F.substring(col(x), 1, n), F.lit("…"))).otherwise(col(x))


def first_paragraph(x: str | Column, n: int = 240) -> Column:
    """First paragraph with text, on one line, cut to n characters."""
    lines = F.regexp_replace(F.regexp_replace(col(x), r"^\s+", ""), r"\n[ \t\r]*\n(.|\n)*$", "")
    return truncate(F.trim(F.regexp_replace(lines, r"\s+", " ")), n)


def concise_body(x: str | Column) -> Column:
    """What stands before the first fenced block, or the whole text if nothing does."""
    at = F.instr(col(x), "\n```")
    lead = F.trim(F.substring(col(x), F.lit(1), at - 1))
    return F.when((at > 0) & (lead != ""), lead).otherwise(col(x))


def strip_speaker(x: str | Column) -> Column:
    return F.regexp_replace(col(x), r"^(?i)(user|assistant|system|tool):\s*", "")


def command_text(x: str | Column) -> Column:
    got = F.trim(F.regexp_extract(col(x), r"^(?:\$ |> |PS> |❯ )(.*)$", 1))
    return F.when(got != "", got)


def alpha_words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: F.rlike(w, F.lit(r"\p{IsAlphabetic}"))))


def looks_like_code(x: Column) -> Column:
    t = F.trim(x)
    return (
        F.rlike(t, F.lit(r"^(#|> |\||//)")) | has_any(t, ("**", ".md:", "/archive/")) | F.rlike(t, F.lit(r"[{};,(\[:]$")) | F.endswith(t, F.lit("=>"))
        | F.endswith(t, F.lit('")]')) | has_any(t, CODE_MARKERS) | (F.rlike(t, F.lit(r"^[-*] ")) & has_any(t, (".rs:", ".ps1:")))
    )


def admissible(x: str | Column) -> Column:
    """Prose: no path, no code or markup, two words with letters, two thirds letters and space."""
    t = F.trim(col(x))
    token = F.trim(F.regexp_replace(t, r"^[-* ]+", ""))
    path = ~F.rlike(token, F.lit(r"\s")) & F.rlike(token, F.lit(r"[/\\]"))
    letters = F.char_length(F.regexp_replace(t, r"[^\p{IsAlphabetic}\s]", ""))
    return (t != "") & ~path & ~looks_like_code(t) & (alpha_words(t) >= 2) & (letters >= 0.65 * F.char_length(t))


def lesson_like(x: str | Column) -> Column:
    return admissible(x) & (alpha_words(F.trim(col(x))) >= 5)


def failure_line(x: str | Column) -> Column:
    low = ascii_lower(F.trim(strip_speaker(x)))
    fine = has_any(low, ("0 errors", "no errors", "0 failed", "0 failures", "no failures")) | F.startswith(low, F.lit("test result: ok"))
    bad = starts_any(low, ("error", "failed", "failure", "exception", "panicked", "traceback")) | F.endswith(low, F.lit("failed")) | has_any(low, ("panicked at", "test result: failed"))
    return bad & ~fine


def resolution_line(x: str | Column) -> Column:
    return has_any(ascii_lower(x), RESOLUTIONS)


def quality_label(category_: Column, text: Column) -> Column:
    """General, ToolingNoise, OverFit or EvidenceDump, the first that holds."""
    low = ascii_lower(text)
    words = lambda ws: F.rlike(low, F.lit(word_pattern(ws)))
    kept = has_any(low, ("error[", "warning[", "exit code", "exit status")) | words(("errno",)) | F.rlike(low, F.lit(r"(^|[^a-z0-9])[a-z][0-9]{3,5}([^a-z0-9]|$)"))
    tooling = ~category_.isin("CodePattern", "ArchitectureRule", "SecurityWarning") & (has_any(low, TOOLING_PHRASES) | words(TOOLING_WORDS))
    ticks = F.size(F.split(text, "`")) >= 3
    spans = F.filter(F.split(text, "`"), lambda s, i: i % 2 == 1)
    call = F.exists(spans, lambda s: F.rlike(s, F.lit(r"[A-Za-z0-9_]\([^)]+\)")))
    narration = (has_any(low, ("initial ",)) & has_any(low, ("implementation",))) | has_any(low, NARRATIONS)
    raw = F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: F.char_length(F.regexp_replace(w, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")) > 2)
    codeish = F.filter(raw, lambda w: F.rlike(w, F.lit(r"[`()]|::")) | F.rlike(F.regexp_replace(w, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", ""), F.lit(r"_|[0-9]|^.+[A-Z]")))
    dense = ticks & (F.size(raw).between(1, 14)) & (F.size(codeish) * 2 > F.size(raw))
    fences = F.split(text, r"(?m)^\s*```[^\n]*\n?")
    fenced = F.aggregate(F.filter(fences, lambda s, i: i % 2 == 1), F.lit(0), lambda a, s: a + F.char_length(s))
    dump = (F.char_length(text) >= 1500) & (fenced * 10 >= F.char_length(text) * 6)
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    chrome = ~ticks & (n_words >= 30) & (F.regexp_count(text, F.lit("[.!?]")) * 20 < n_words)
    return (
        F.when(kept, "General").when(tooling, "ToolingNoise").when(call | narration | (words(HEDGES) & ticks) | dense, "OverFit")
        .when(dump | chrome, "EvidenceDump").otherwise("General")
    )


def slug(x: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def skill_slug(x: str | Column) -> Column:
    """The slug of a skill's name, never empty."""
    return F.when(slug(x) == "", "suggested-skill").otherwise(slug(x))


def lesson_marker(x: str | Column) -> Column:
    """The lesson that a line declares after its speaker; null where it declares none."""
    said = strip_speaker(x)
    return F.when(F.rlike(said, F.lit("^[Ll]esson:")), F.trim(F.substring(said, 8, 2**31 - 1)))


def skill_intent(x: str | Column) -> Column:
    """Whether a line proposes a skill, in any case."""
    return has_any(ascii_lower(x), SKILL_INTENTS)


def remote_key(url: str | Column) -> Column:
    """A git remote as host/path, whatever its scheme, user or ending."""
    x = F.regexp_replace(F.trim(col(url)), r"^(git\+ssh|ssh|git|https|http|ftps|ftp)://", "")
    x = F.regexp_replace(F.regexp_replace(x, "^[^@]*@", ""), "^([^:]*):", "$1/")
    x = F.regexp_replace(F.regexp_replace(x, "^/+|/+$", ""), r"\.git$", "")
    return F.lower(F.regexp_replace(x, "^/+|/+$", ""))


def package_of(path: str | Column) -> Column:
    return F.when(F.contains(col(path), F.lit("/")), F.regexp_replace(col(path), "/[^/]*$", "")).otherwise(F.lit("."))


def module_stem(path: str | Column) -> Column:
    """File name without its ending; mod, lib and main stand for their folder."""
    stem = F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")
    parent = F.regexp_extract(col(path), "([^/]+)/[^/]*$", 1)
    return F.when(stem.isin("mod", "lib", "main") & (parent != ""), parent).otherwise(stem)


def verdict(x: str | Column) -> Column:
    low = ascii_lower(x)
    return F.when(has_any(low, ("no_longer_true", "no longer true")), "no_longer_true").when(has_any(low, ("still_current", "still current")), "still_current").otherwise("unknown")


def significant_terms(query: str) -> list[str]:
    """Query terms on the driver: trimmed of outer punctuation, without stop words."""
    out = []
    for term in query.split():
        term = re.sub(r"^[\W_]+|[\W_]+$", "", term)
        if term and term.lower() not in QUERY_STOP_WORDS:
            out.append(term)
    return out


def significant(x: str | Column) -> Column:
    """The same of a column of queries: an array of terms."""
    edges = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"
    terms = F.transform(F.split(F.coalesce(col(x), F.lit("")), r"(?U)\s+"), lambda t: F.regexp_replace(t, edges, ""))
    return F.filter(terms, lambda t: (t != "") & ~ascii_lower(t).isin(*QUERY_STOP_WORDS))


#: White space as Unicode lists it, for patterns.
SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Comments, strings, characters and brackets of Rust, each a token, and what lies between.
RUST_TOKENS = (
    r"(?s)//[^\n]*"
    r"|/\*.*?\*/"
    r"|r(#*)\".*?\"\1"
    r"|\".*?(?<!\\)(?:\\\\)*\""
    r"|'\\.[^']*'|'[^'\\]'"
    r"|[{}()\[\]]"
    r"|[^\"'/{}()\[\]r]+|."
)


def generic_skeleton(x: str | Column, n: int = 200) -> Column:
    """The first line with text, without space around it and braces at its end, cut to n characters; null for null."""
    line = F.regexp_extract(col(x), rf"^{SPACES}*([^\n]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(line, rf"{SPACES}+$", ""), r"\{+$", "")
    return F.substring(F.regexp_replace(bare, rf"{SPACES}+$", ""), 1, n)


def rust_skeleton(x: str | Column) -> Column:
    """A Rust definition with its body told by a mark: what stands before the body, or all of it but the closing ``;``.

    The body begins at the first brace outside comments, strings and other brackets;
    that of a tuple struct at its bracket.  Braces inside the angle brackets of a type
    and comments within comments aren't told apart from others; constants, statics, type
    names and uses have no body.  A null has none, an empty text is its own.
    """
    source = col(x)
    opening = r"^\s*(?:pub\s*(?:\([^)]*\))?\s*)?"
    past = F.char_length(F.regexp_extract(source, opening + r"struct\b", 0))
    tokens = F.regexp_extract_all(source, F.lit(RUST_TOKENS), F.lit(0))

    def step(s: Column, token: Column) -> Column:
        level = s["level"]
        opens = ((token == "{") | ((token == "(") & (past > 0) & (s["at"] >= past))) & (level == 0)
        change = F.when(token.isin("(", "["), 1).when(token.isin(")", "]"), -1).otherwise(0)
        found = s["body"].isNotNull()
        return F.struct(
            (s["at"] + F.char_length(token)).alias("at"),
            F.when(found, level).otherwise(F.greatest(level + change, F.lit(0))).alias("level"),
            F.when(found, s["body"]).when(opens, s["at"]).alias("body"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("body"))
    body = F.aggregate(tokens, begin, step, lambda s: s["body"])
    bodiless = F.rlike(source, F.lit(opening + r"(?:const\s+(?!fn\b|unsafe\b|async\b|extern\b)|static\b|type\b|use\b)"))
    end = rf"{SPACES}+$"
    head = F.regexp_replace(F.substring(source, F.lit(1), body), end, "")
    whole = F.regexp_replace(F.regexp_replace(source, ";+$", ""), end, "")
    return F.when(body.isNull() | bodiless, whole).otherwise(F.concat(head, F.lit(" { … }")))
