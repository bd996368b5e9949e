"""Closing a session: candidate lessons from its lines, judged, deduplicated and put to the queue.

Five families speak in turn: explicit lessons, proposals of a skill, failures with
their resolution, commands that repeat, and corrections by the user.  All but the
first give five candidates a session at most, and of equal summaries the first
counts, over all families of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import hashing as H
from lorekeep.functions import text as T

from . import queue as Q
from .extraction import failure_resolutions
from .stages import settle

# Candidates of a family, bytes of a command worth noting, bytes of a contained restatement.
MOST, MIN_COMMAND, MIN_RESTATEMENT = 5, 8, 12
CONFLICT_SIGNS = ("instead", "do not", "don't", "wrong")
# Category, confidence, action, destination of each family.
FAMILIES = {
    1: ("Process", 0.8, "PromoteToMemory", "ProjectMemory"),
    2: ("CandidateSkill", 0.55, "CreateSkillDraft", "SkillDraft"),
    3: ("DebuggingRecipe", 0.6, "PromoteToMemory", "ProjectMemory"),
    4: ("CandidateSkill", 0.55, "CreateSkillDraft", "SkillDraft"),
    5: ("UserPreference", 0.6, "PromoteToMemory", "ProjectMemory"),
}


def families(lines: DataFrame) -> DataFrame:
    """session, family, line_no, summary: all that the families find, before caps and repeats."""
    rows = lines.select("session", "line_no", F.trim("line").alias("line"))
    kind = lambda n, df: df.select("session", F.lit(n).alias("family"), "line_no", "summary")
    said = T.strip_speaker("line")
    explicit = rows.where(F.rlike(said, F.lit("^[Ll]esson:"))).withColumn("summary", F.trim(F.regexp_replace(said, "^[Ll]esson:", ""))).where(T.admissible("summary"))
    skills = rows.withColumn("summary", F.trim(F.regexp_replace("line", "^(- )+", ""))).where(T.has_any(T.ascii_lower("summary"), T.SKILL_INTENTS) & T.lesson_like("summary"))
    pairs = failure_resolutions(rows)
    part = lambda n: rows.select("session", F.col("line_no").alias(n), T.truncate(said).alias(f"{n}_said"))
    fixed = pairs.join(part("fail_line"), ["session", "fail_line"]).join(part("fix_line"), ["session", "fix_line"])
    fixed = fixed.withColumn("summary", F.concat(F.lit('When "'), "fail_line_said", F.lit('" occurred, the session resolved it with: "'), "fix_line_said", F.lit('"'))).withColumn("line_no", F.col("fail_line"))
    again = rows.withColumn("_c", T.command_text("line")).where(F.octet_length("_c") >= MIN_COMMAND)
    again = again.withColumn("_n", F.row_number().over(Window.partitionBy("session", "_c").orderBy("line_no"))).where("_n = 2")
    again = again.withColumn("summary", F.concat(F.lit("Command repeated during this session (candidate for a reusable workflow): "), T.truncate("_c")))
    rest = F.trim(F.substr(F.col("line"), F.lit(6)))
    told = rows.where(F.startswith(T.ascii_lower("line"), F.lit("user:"))).withColumn("_r", rest).where(T.starts_any(T.ascii_lower("_r"), T.CORRECTIONS) & T.lesson_like("_r"))
    told = told.withColumn("summary", F.concat(F.lit("User correction: "), T.truncate("_r")))
    out = kind(1, explicit)
    for n, df in ((2, skills), (3, fixed), (4, again), (5, told)):
        out = out.unionByName(kind(n, df))
    return out


def candidates(lines: DataFrame) -> DataFrame:
    """A row for each candidate of a session (session, line_no, line), in order.

    session, place, family, candidate_id, summary, category, confidence, action,
    destination, conflict, status, duplicate_of.  Families 3 to 5 are cut before repeats go,
    skill proposals after.  A restatement (one summary holds the other) is to be merged
    with the first that it restates.
    """
    found = settle(families(lines), "families")
    each = Window.partitionBy("session", "family").orderBy("line_no")
    own = found.withColumn("_n", F.row_number().over(each)).where(f"family < 3 or _n <= {MOST}")
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("session", T.ascii_lower("summary")).orderBy("family", "line_no"))).where("_n = 1")
    own = own.withColumn("_n", F.row_number().over(each)).where(f"family <> 2 or _n <= {MOST}")
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("family", "line_no"))).drop("_n", "line_no")
    of = lambda k: F.element_at(F.array(*[F.lit(FAMILIES[n][k]) for n in sorted(FAMILIES)]), F.col("family"))
    low = T.ascii_lower("summary")
    conflict = T.has_any(low, CONFLICT_SIGNS)
    own = own.select("*", of(0).alias("category"), of(1).alias("confidence"), of(2).alias("action"), of(3).alias("destination"), conflict.alias("conflict"))
    many = F.contains(low, F.lit("; ")) | (F.regexp_count(low, F.lit(" and ")) >= 2)
    keeps = F.col("action") == "PromoteToMemory"
    own = own.withColumn("action", F.when(keeps & F.col("conflict"), "SupersedeExisting").when(keeps & many, "Split").otherwise(F.col("action")))
    own = own.withColumn("status", F.when(F.col("confidence") < 0.6, "LowConfidence").otherwise("Pending"))
    own = own.withColumn("candidate_id", F.concat(F.lit("lesson-"), H.fnv_hex(F.concat(F.col("session").cast("string"), F.lit("\n"), F.col("summary")))))
    return _restated(settle(own, "candidates"))


def _restated(own: DataFrame) -> DataFrame:
    plain = T.ascii_lower(F.trim(F.regexp_replace("summary", r"\s+", " ")))
    a = own.select("session", F.col("place").alias("_p"), F.col("candidate_id").alias("_id"), plain.alias("_a"))
    b = own.select("session", "place", plain.alias("_b"))
    holds = lambda x, y: (F.octet_length(x) >= MIN_RESTATEMENT) & F.contains(F.col(y), F.col(x))
    met = a.join(b, "session").where((F.col("_p") < F.col("place")) & (holds("_a", "_b") | holds("_b", "_a")))  # within one session
    first = met.groupBy("session", "place").agg(F.min_by("_id", "_p").alias("duplicate_of"))
    out = own.join(first, ["session", "place"], "left")
    return out.withColumn("action", F.when(F.col("duplicate_of").isNotNull(), "MergeIntoExisting").otherwise(F.col("action")))


def closed_out(lines: DataFrame) -> DataFrame:
    """``candidates`` with ``at`` (their number in the order of sessions and places) and ``survivor``.

    ``survivor`` is the ``at`` of the row that stands for them in the queue.  Sessions are
    taken by number (below 2 to 31, with fewer than 2 to 31 candidates each).
    """
    own = settle(candidates(lines).withColumn("at", (F.col("session").cast("long") * F.lit(1 << 31) + F.col("place"))), "closed")
    return own.join(Q.enqueued(own, "at", "summary").select(F.col("id").alias("at"), "survivor"), "at")
