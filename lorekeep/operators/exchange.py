"""Interchange of memories: concept files, agent notes, bundles, distilled insights, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T

# Fixed values of the concept format.
OKF_VERSION = "0.1"
TITLE_CHARS, DESCRIPTION_CHARS = 120, 200
FOREIGN_CONFIDENCE = 0.4
ENTROPY_TOKEN, ENTROPY_BITS = r"[A-Za-z0-9+/=_-]{24,}", 4.6


def entropy_bits(token: Column) -> Column:
    """Shannon entropy of an ASCII token's bytes."""
    letters = F.slice(F.split(token, ""), 1, F.char_length(token))
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters)
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def redact_entropy(text: str | Column) -> Column:
    """Long tokens of high entropy replaced; the pieces between them stay."""
    x = T.col(text)
    tokens = F.regexp_extract_all(x, F.lit(f"({ENTROPY_TOKEN})"), F.lit(1))
    clean = F.transform(tokens, lambda t: F.when(entropy_bits(t) >= ENTROPY_BITS, F.lit("[REDACTED:high_entropy]")).otherwise(t))
    pieces = F.split(x, ENTROPY_TOKEN, -1)
    whole = F.array_join(F.zip_with(pieces, clean, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    return F.when(F.size(tokens) > 0, whole).otherwise(x)


def redact(text: str | Column) -> Column:
    """The rules in order, then the entropy backstop."""
    return redact_entropy(T.redact(text))


def _content(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, "^# ", ""))


def title(body: Column, category: Column) -> Column:
    """The first line that isn't empty, without its heading mark; else the category."""
    first = F.coalesce(_plain(F.get(_content(body), 0)), F.lit(""))
    return F.substring(F.when(first == "", category).otherwise(first), 1, TITLE_CHARS)


def description(body: Column) -> Column:
    """The second line that isn't empty; null without one."""
    second = _plain(F.get(_content(body), 1))
    return F.when(second != "", F.substring(second, 1, DESCRIPTION_CHARS))


def scalar(x: Column) -> Column:
    """A value in quotes where it holds a character that front matter would read."""
    return F.when(F.rlike(x, F.lit(r"[:#\n'\"\[\]]")), F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(x)


def to_okf(memory: DataFrame, markdown: str = "markdown") -> DataFrame:
    """``memory`` with ``okf``: the concept's keys spliced into its Markdown form."""
    line = lambda key, x: F.concat(F.lit(f"{key}: "), scalar(x), F.lit("\n"))
    about = F.coalesce(line("description", description(F.col("body"))), F.lit(""))
    head = F.concat(F.lit(f'---\nokf_version: "{OKF_VERSION}"\n'), line("type", F.col("category")), line("title", title(F.col("body"), F.col("category"))), about)
    return memory.withColumn("okf", F.concat(head, F.regexp_replace(markdown, "^---\n", "")))


def _unquoted(x: Column) -> Column:
    inner = F.regexp_extract(x, "^(['\"])(.*)\\1$", 2)
    return F.when(F.rlike(x, F.lit("^(['\"]).*\\1$")), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(x)


def from_okf(rows: DataFrame, text: str = "okf") -> DataFrame:
    """Foreign concepts: id, type, title, body, tags, confidence and an error where front matter or type lacks."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n?---\n", 1)
    fenced = F.rlike(text, F.lit(r"(?s)^---\n.*?---\n"))
    value = lambda key: _unquoted(F.trim(F.regexp_extract(head, rf"(?m)^{key}:(.*)$", 1)))
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)^---\n.*?\n?---\n\n?", ""), r"\n\z", "")
    flow = F.regexp_extract(head, r"(?m)^tags:\s*\[(.*)\]\s*$", 1)
    tags = F.filter(F.transform(F.split(flow, ","), lambda x: _unquoted(F.trim(x))), lambda x: x != "")
    error = F.when(~fenced, "MissingFrontMatter").when(value("type") == "", "MissingType")
    out = rows.select(*rows.columns, value("type").alias("type"), value("title").alias("title"), body.alias("body"), tags.alias("tags"), error.alias("error"))
    named = F.concat(F.lit("okf-"), F.substring(F.sha2(F.concat("title", F.lit("\n"), "body").cast("binary"), 256), 1, 16))
    return out.withColumn("id", F.when(F.col("error").isNull(), named)).withColumn("confidence", F.lit(FOREIGN_CONFIDENCE))


def agent_notes(files: DataFrame) -> DataFrame:
    """path, summary, kind of an agent's notes; indexes and files without front matter or summary are dropped."""
    head = F.regexp_extract("text", r"(?s)^\x{FEFF}?---[ \t]*\n(.*?)\n---[ \t]*(\n|\z)", 1)
    value = lambda key: F.trim(F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^\s*{key}[ \t]*:[ \t]*(.*)$", 1)), '^"+|"+$', ""))
    first = lambda *xs: F.coalesce(*[F.when(x != "", x) for x in xs])
    own = files.where(F.regexp_replace("path", "^.*/", "") != "MEMORY.md")
    return own.select("path", first(value("description"), value("name")).alias("summary"), first(value("type")).alias("kind")).where("summary is not null")


def bundle(memory: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """Active memories of the scopes, with redacted bodies and the number of redactions."""
    own = memory.where("status = 'active'").where(F.col("store").isin(*scopes))
    own = own.select("memory_id", "store", "category", T.redaction("body").alias("_done"))
    return own.select("memory_id", "store", "category", F.col("_done.text").alias("body"), T.redaction_total(F.col("_done")).alias("redactions"))


def canonical_lines(entries: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, line: each entry as compact JSON; a writer sorts them by key, so that no task holds a whole bundle."""
    return entries.select(key, F.to_json(F.struct(*fields)).alias("line"))


def distilled(replies: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """Insights of model replies whose text is admissible and whose confidence lies in 0..1."""
    schema = "struct<insights: array<struct<summary: string, category: string, confidence: double>>>"
    rows = replies.select(key, F.posexplode(F.from_json(text, schema)["insights"]).alias("at", "x"))
    own = rows.select(key, F.concat(F.lit(f"{kind}-"), F.lpad(F.col("at").cast("string"), 4, "0")).alias("lesson_id"), F.trim("x.summary").alias("summary"), "x.category", "x.confidence")
    return own.where(T.admissible("summary") & F.col("confidence").between(0, 1))


def proposals(offered: DataFrame, receipts: DataFrame, longest: dict[str, int]) -> DataFrame:
    """source, key, state: invalid, replayed or in conflict with an earlier receipt, or new.

    The fingerprint is taken after redaction, each value led by its length.
    """
    clean = {c: redact(F.trim(c)) for c in ("title", "body")}
    led = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)
    own = offered.withColumn("fingerprint", F.sha2(F.concat(*[led(x) for x in (F.col("source"), clean["title"], clean["body"])]).cast("binary"), 256))
    bad = F.when(F.trim("title") == "", "EmptyProposal").when(~F.rlike("source", F.lit(r"^[A-Za-z0-9_.-]+$")), "InvalidProposalSource")
    for column, most in longest.items():
        bad = bad.when(F.char_length(F.trim(column)) > most, f"TooLong:{column}")
    held = receipts.select("source", "key", F.col("fingerprint").alias("held"))
    out = own.join(held, ["source", "key"], "left")
    state = F.when(bad.isNotNull(), bad).when(F.col("held").isNull(), "New").when(F.col("held") == F.col("fingerprint"), "Replayed").otherwise("Conflict")
    return out.select("source", "key", "fingerprint", state.alias("state"))


def memory_path(scope: Column, id_: Column) -> Column:
    """scope/id.md, or null where the id could leave the folder."""
    return F.when(F.rlike(id_, F.lit("^[A-Za-z0-9_-]+$")), F.concat(scope, F.lit("/"), id_, F.lit(".md")))


def lifecycle(skills: DataFrame, actions: DataFrame, key: str = "skill_id") -> DataFrame:
    """Skills with the state that their latest action gives them."""
    last = actions.groupBy(key).agg(F.max_by("action", "at").alias("action"))
    state = F.when(F.col("action") == "activate", "active").when(F.col("action") == "retire", "retired").otherwise(F.col("state"))
    return skills.join(last, key, "left").withColumn("state", state).select(*skills.columns)


def skill_drafts(items: DataFrame) -> DataFrame:
    """Disabled drafts of the accepted or edited items that ask for a skill."""
    wants = F.col("state").isin("accepted", "edited") & ((F.col("category") == "CandidateSkill") | F.col("action").isin("CreateSkillDraft", "UpdateSkillDraft"))
    about = F.concat(F.lit("Suggested disabled workflow draft from review item "), F.col("id").cast("string"), F.lit("."))
    return items.where(wants).select(F.concat(F.lit("skill-"), F.col("id").cast("string")).alias("draft_id"), T.slug("summary").alias("name"), about.alias("description"), F.concat(F.lit("When work resembles: "), "summary").alias("trigger"), F.lit(True).alias("disabled"))


def context_lines(hits: DataFrame, drafts: DataFrame, heading: str, query: str, most: int = 6) -> DataFrame:
    """at, line: the export of the best memories and the first drafts, as ordered lines."""
    one = lambda at, text: (at, text)
    spark = hits.sparkSession
    head = spark.createDataFrame([one("0", f"# {heading}"), one("1", f"Query: `{query}`"), one("2", "## Accepted Memory"), one("4", "## Suggested Skills")], "at string, line string")
    best = hits.orderBy(F.desc("rank_score"), "memory_id").limit(most)
    rows = best.select(F.concat(F.lit("3."), F.lpad(F.col("memory_id").cast("string"), 12, "0")).alias("at"), F.concat(F.lit("- `"), F.col("memory_id").cast("string"), F.lit("` score="), F.col("score").cast("string")).alias("line"))
    first = drafts.orderBy("draft_id").limit(most)
    skills = first.select(F.concat(F.lit("5."), "draft_id").alias("at"), F.concat(F.lit("- `"), "draft_id", F.lit("` `"), "name", F.lit("`: "), "description").alias("line"))
    none_memory = spark.createDataFrame([one("3", "- No accepted memory matched this query.")], head.schema).join(best.select(F.lit(1).alias("x")).limit(1), how="left_anti", on=F.lit(True))
    none_draft = spark.createDataFrame([one("5", "- No disabled skill drafts are available.")], head.schema).join(first.select(F.lit(1).alias("x")).limit(1), how="left_anti", on=F.lit(True))
    return head.unionAll(rows).unionAll(skills).unionAll(none_memory).unionAll(none_draft)
