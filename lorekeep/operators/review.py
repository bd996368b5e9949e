"""Review and promotion of candidates, provenance, anchors and imports as joins and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefixes as P
from .stages import settle

#: Confidences of an anchor by qualified name or path, and by plain name.
ANCHOR_QUALIFIED, ANCHOR_NAME = 0.9, 0.6
#: Confidences of an import resolved by stem and by prefix.
IMPORT_EXACT, IMPORT_PREFIX = 0.9, 0.6
#: Fixed value: weight of tool-use lessons.
TOOL_USE_WEIGHT = 0.7
#: File extensions by code language.
CODE_LANGUAGES = {
    "rust": ("rs",), "python": ("py", "pyi"), "go": ("go",), "javascript": ("js", "jsx", "mjs", "cjs"), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",),
    "csharp": ("cs",), "java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "ruby": ("rb",), "php": ("php",), "lua": ("lua",),
    "ocaml": ("ml",), "elixir": ("ex", "exs"), "powershell": ("ps1", "psm1", "psd1"),
}


def code_language(path: Column) -> Column:
    """Language by the extension of a path (any case); null without a known one."""
    extension = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for language, extensions in CODE_LANGUAGES.items():
        out = out.when(extension.isin(*extensions), F.lit(language))
    return out


def dominant_language(files: DataFrame) -> DataFrame:
    """The language of most files; ties go to the smaller name."""
    counts = files.where("language is not null").groupBy("language").agg(F.count("*").alias("n_files"))
    return counts.orderBy(F.desc("n_files"), "language").limit(1)


def anchor_memories(hints: DataFrame, nodes: DataFrame) -> DataFrame:
    """memory_id, hint, node, confidence: each hint's only node, or nulls.

    ``hints`` has memory_id and hint; ``nodes`` has node, qualified_name, path and
    name.  Qualified names and paths go before plain names; a hint that several
    nodes answer anchors nothing.
    """
    asked = hints.withColumn("hint", F.trim("hint")).where("hint <> ''").withColumn("wanted", F.replace("hint", F.lit("\\"), F.lit("/")))
    keys = nodes.select("node", F.explode(F.array_distinct(F.array("qualified_name", "path"))).alias("wanted")).where("wanted is not null")
    first = keys.groupBy("wanted").agg(F.count("*").alias("n1"), F.min("node").alias("node1"))
    second = nodes.groupBy(F.col("name").alias("wanted")).agg(F.count("*").alias("n2"), F.min("node").alias("node2"))
    by_name = F.col("n1").isNull() & (F.col("n2") == 1)
    out = asked.join(first, "wanted", "left").join(second, "wanted", "left")
    return out.select(
        "memory_id",
        "hint",
        F.when(F.col("n1") == 1, F.col("node1")).when(by_name, F.col("node2")).alias("node"),
        F.when(F.col("n1") == 1, F.lit(ANCHOR_QUALIFIED)).when(by_name, F.lit(ANCHOR_NAME)).alias("confidence"),
    )


def import_edges(uses: DataFrame, files: DataFrame) -> DataFrame:
    """file, line, target, heuristic, confidence: imports that one other file answers.

    ``uses`` has file, line and path; ``files`` has file and stem.  One file whose
    stem is a segment wins; where there is none, one file whose stem begins a segment or
    is begun by one.  Of each stem a few files are kept, which tell whether a file is the
    only one, so that a stem of many files costs no more than another.
    """
    parts = F.filter(F.transform(F.split("path", r"[:./\\]"), lambda s: F.regexp_replace(F.trim(s), ";+$", "")), lambda s: (s != "") & ~s.isin("crate", "super", "self"))
    segments = settle(uses.select("file", "line", "path", F.explode(F.array_distinct(parts)).alias("word")), "segments")
    few = settle(P.few_targets(files.select(F.col("stem").alias("word"), F.col("file").alias("target"))), "stems")
    met = few.withColumn("exact", F.lit(True)).unionByName(P.related(segments, few).withColumn("exact", F.lit(False)))
    pairs = segments.join(met, "word").select("file", "line", "path", "exact", F.explode("few").alias("target")).where("target <> file")
    only = lambda exact: F.when(F.col("exact") == exact, F.col("target"))
    found = pairs.groupBy("file", "line", "path").agg(
        F.min(only(True)).alias("exact"), F.max(only(True)).alias("other_exact"), F.min(only(False)).alias("prefix"), F.max(only(False)).alias("other_prefix"),
    )
    one = F.col("exact").isNotNull()
    return found.where("exact = other_exact or (exact is null and prefix = other_prefix)").select(
        "file", "line", F.coalesce("exact", "prefix").alias("target"), (~one).alias("heuristic"),
        F.when(one, F.lit(IMPORT_EXACT)).otherwise(F.lit(IMPORT_PREFIX)).alias("confidence"),
    )


def admit_file(targets: DataFrame, parsed: DataFrame) -> DataFrame:
    """Resolution targets with those of the freshly parsed files replaced."""
    return targets.join(parsed.select("file").distinct(), "file", "left_anti").unionByName(parsed)


def relevance(asked: Column, known: Column, rate: Column) -> Column:
    """Share of asked cues that contain or lie in a known cue, weighted; 0 without cues."""
    hit = F.filter(asked, lambda q: F.exists(known, lambda c: F.contains(F.lower(c), F.lower(q)) | F.contains(F.lower(q), F.lower(c))))
    share = F.size(hit) / F.size(asked)
    return F.when(F.coalesce(F.size(asked), F.lit(0)) <= 0, F.lit(0.0)).otherwise(share * TOOL_USE_WEIGHT * F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)))


def decide(items: DataFrame, mode: str, threshold: float = 0.82) -> DataFrame:
    """``items`` with ``decision``: manual, annotate, supersede or accept.

    Reads sourced, confidence, conflict, target, duplicate and general.  Sourced items stay
    with people in every mode; automatic mode asks for the threshold only before it
    supersedes.  All items are judged on the memory as it stood before the pass.
    """
    sure = F.col("confidence") >= threshold
    replaces = F.col("conflict") & F.col("target").isNotNull() & F.col("general") & sure
    accepts = ~F.col("conflict") & ~F.col("duplicate") & F.col("general")
    manual = F.lit("manual")
    if mode == "manual":
        decision = manual
    elif mode == "assisted":
        decision = F.when(F.col("sourced"), manual).otherwise("annotate")
    else:
        accepts = accepts & sure if mode == "trusted" else accepts
        decision = F.when(F.col("sourced"), manual).when(replaces, "supersede").when(accepts, "accept").otherwise(manual)
    return items.withColumn("decision", decision)


def promote(items: DataFrame, allows_global: bool) -> DataFrame:
    """item_id, error, body, scope, supersedes: what promoting each review item gives.

    An item that can't be promoted has an error and nulls.
    """
    error = F.when(~F.col("state").isin("accepted", "edited"), "not accepted").when(F.col("needs_edit") & F.col("replacement").isNull(), "needs edit")
    fine = error.isNull()
    scope = F.when(F.col("wants_global") & F.lit(allows_global), "global").otherwise("project")
    return items.select(
        "item_id", error.alias("error"), F.when(fine, F.coalesce("replacement", "summary")).alias("body"), F.when(fine, scope).alias("scope"),
        F.when(fine, F.col("target")).alias("supersedes"),
    )


def receipts(held: DataFrame, offered: DataFrame) -> DataFrame:
    """proposal_id, outcome (new, replayed, conflict), survivor: offers against held receipts."""
    old = held.select("proposal_id", F.col("fingerprint").alias("_print"), F.col("survivor").alias("_survivor"))
    outcome = F.when(F.col("_print").isNull(), "new").when(F.col("_print") == F.col("fingerprint"), "replayed").otherwise("conflict")
    joined = offered.join(old, "proposal_id", "left").withColumn("outcome", outcome)
    survivor = F.when(F.col("outcome") == "new", F.col("survivor")).when(F.col("outcome") == "replayed", F.col("_survivor"))
    return joined.select("proposal_id", "outcome", survivor.alias("survivor"))


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """item_id, state, error: the last decision of each item; unknown ids get an error."""
    last = decisions.groupBy("item_id").agg(F.max_by("state", "at").alias("_new"))
    known = items.select("item_id", F.col("state").alias("_old"))
    joined = known.join(last, "item_id", "full_outer")
    error = F.when(F.col("_old").isNull(), F.lit("missing item"))
    return joined.select("item_id", F.when(error.isNull(), F.coalesce("_new", "_old")).alias("state"), error.alias("error"))


def contained(candidates: DataFrame, shortest: int = 12) -> DataFrame:
    """session, id, duplicate_of: the first earlier candidate of a session that holds or lies in this one's words.

    Equal texts are joined by equality alone; of those that differ, only classes of
    one session meet.
    """
    text = F.lower(F.trim(F.regexp_replace("summary", r"\s+", " ")))
    c = candidates.select("session", "id", "place", text.alias("words")).where(F.octet_length("words") >= shortest)
    classes = c.groupBy("session", "words").agg(F.min(F.struct("place", "id")).alias("first"))
    a, b = classes.alias("a"), classes.alias("b")
    met = a.join(b, (F.col("a.session") == F.col("b.session")) & (F.col("a.words") != F.col("b.words")) & (F.contains("a.words", "b.words") | F.contains("b.words", "a.words")))
    other = met.groupBy(F.col("a.session").alias("session"), F.col("a.words").alias("words")).agg(F.min("b.first").alias("other"))
    joined = c.join(classes, ["session", "words"]).join(other, ["session", "words"], "left")
    best = F.when(F.col("other.place") < F.least("first.place", "place"), F.col("other")).otherwise(F.when(F.col("first.place") < F.col("place"), F.col("first")))
    best = F.when(best.isNull() & (F.col("other.place") < F.col("place")), F.col("other")).otherwise(best)
    return joined.select("session", "id", best["id"].alias("duplicate_of")).where("duplicate_of is not null")


def provenance(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """A record a memory, with the sorted targets that it contradicts, comma-joined."""
    against = relations.where("kind = 'contradicts'").groupBy("memory_id").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.col("target").cast("string")))).alias("contradicts"))
    return memories.join(against, "memory_id", "left").withColumn("contradicts", F.coalesce("contradicts", F.lit("")))


def skill_markdown(name: Column, description: Column, sections: dict[str, Column]) -> Column:
    """Front matter, title, description, and a bulleted section for each list with items."""
    head = F.concat(F.lit("---\ndisabled: true\nname: "), name, F.lit("\n---\n\n# "), name, F.lit("\n\n"), description, F.lit("\n\n"))
    parts = [F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n- "), F.array_join(items, "\n- "), F.lit("\n\n"))).otherwise(F.lit("")) for title, items in sections.items()]
    return F.concat(head, *parts)


def best_first(rows: DataFrame, group: str, score: str, tie: str, column: str) -> DataFrame:
    """``rows`` with their number within each group, from 1: by falling score, then by ``tie``."""
    return rows.withColumn(column, F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)))
