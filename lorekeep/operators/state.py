"""State changes as pure functions: old tables and a change give new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from .search import sharing
from .stages import settle


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old``; columns in ``keep`` hold their old values."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    fresh = F.col(f"b.{key}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in (key, *keep) else F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti").select(*table.columns)


def mark(table: DataFrame, ids: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """``column`` set to ``value`` on the rows whose key is listed."""
    listed = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    out = table.join(listed, key, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column)))
    return out.select(*table.columns)


def bump_usage(memory: DataFrame, used: DataFrame, key: str = "memory_id") -> DataFrame:
    """One more hit for each distinct id that is used and active."""
    hit = used.select(key).distinct().withColumn("_hit", F.lit(1))
    more = F.when(F.col("status") == "active", F.coalesce("_hit", F.lit(0))).otherwise(0)
    return memory.join(hit, key, "left").withColumn("hit_count", F.col("hit_count") + more).select(*memory.columns)


def polarities(memory: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """key, entity, no: whether each active memory of an entity prohibits; bodies are read once."""
    polar = memory.where("status = 'active'").select(key, T.prohibits("body").alias("no"))
    return settle(entities.join(polar, key).select(key, "entity", "no").distinct(), "polarities")


def contradicted_ids(memory: DataFrame, entities: DataFrame, said: DataFrame, key: str = "memory_id") -> DataFrame:
    """The ids in ``all_contradictions``, without its pairs: all of an entity with both polarities, and those stated."""
    own = polarities(memory, entities, key)
    mixed = own.groupBy("entity").agg(F.min("no").alias("all"), F.max("no").alias("any")).where("any and not all").select("entity")
    return own.join(mixed, "entity", "left_semi").select(key).unionAll(said.select(key)).unionAll(said.select(F.col("target").alias(key))).distinct()


def _opposed(own: DataFrame, key: str) -> DataFrame:
    """memory_id, target: pairs of ``polarities`` that share an entity and differ, both ways; an id has one polarity."""
    yes = own.where("not no").select(F.col(key).alias("x"), "entity")
    no = own.where("no").select(F.col(key).alias("y"), "entity")
    pairs = sharing(yes, no, "x", "y", "entity")
    return pairs.select(F.inline(F.array(F.struct(F.col("x").alias("memory_id"), F.col("y").alias("target")), F.struct(F.col("y").alias("memory_id"), F.col("x").alias("target")))))


def contradictions(memory: DataFrame, entities: DataFrame, key: str = "memory_id") -> DataFrame:
    """Pairs that share an entity and differ in polarity, both ways."""
    return _opposed(polarities(memory, entities, key), key)


def all_contradictions(memory: DataFrame, entities: DataFrame, said: DataFrame, key: str = "memory_id") -> DataFrame:
    """Pairs both ways: those stated (key, target) and those of opposite polarity that share an entity.

    Only the stated pairs are told apart from the others, so that the latter aren't shuffled.
    """
    own = polarities(memory, entities, key)
    both = said.select(F.col(key).alias("memory_id"), "target").unionAll(said.select(F.col("target").alias("memory_id"), F.col(key).alias("target"))).distinct()
    a, b = own.select(F.col(key).alias("memory_id"), "entity", "no"), own.select(F.col(key).alias("target"), "entity", F.col("no").alias("_no"))
    known = both.join(a, "memory_id").join(b, ["target", "entity"]).where("no <> _no").select("memory_id", "target")
    return _opposed(own, key).unionByName(both.join(known, ["memory_id", "target"], "left_anti"))


def freshness_pass(memory: DataFrame, today: Column, scopes: tuple[str, ...], max_flags: int = 25, dry_run: bool = False) -> DataFrame:
    """memory with its ``stale`` flag after a pass over the scopes; as it was in a dry run."""
    due = freshness(memory.where(F.col("store").isin(*scopes)), today, max_flags)
    return memory if dry_run else mark(memory, due, "memory_id", "stale", F.lit(True))


def relationships(memory: DataFrame, key: str = "memory_id") -> DataFrame:
    """memory_id, relation_kind, target: category, session, file and entity rows without repeats."""
    one = lambda kind, c: memory.where(F.col(c).isNotNull()).select(key, F.lit(kind).alias("relation_kind"), F.col(c).cast("string").alias("target"))
    many = lambda kind, c: memory.select(key, F.lit(kind).alias("relation_kind"), F.explode(c).alias("target"))
    return one("category", "category").unionAll(one("session", "source_session")).unionAll(many("file", "related_files")).unionAll(many("entity", "related_entities")).distinct()


def replace_by_path(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of files that were read again replace the old ones, shorter tails included."""
    return old.join(new.select("path").distinct(), "path", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def reindex_plan(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, action) from the hashes that are indexed and those that are there now."""
    a, b = indexed.withColumnRenamed("content_hash", "was"), current.withColumnRenamed("content_hash", "now")
    action = F.when(F.col("now").isNull(), "prune").when(F.col("was").isNull() | (F.col("was") != F.col("now")), "index").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def supersede_paths(rows: DataFrame, paths: DataFrame, at: Column) -> DataFrame:
    hit = paths.select("path").distinct().withColumn("_hit", F.lit(True))
    out = rows.join(hit, "path", "left").withColumn("superseded_at", F.when(F.col("_hit") & F.col("superseded_at").isNull(), at).otherwise(F.col("superseded_at")))
    return out.select(*rows.columns)


def revive_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Superseded edges become active again where both ends are active."""
    live = nodes.where("superseded_at is null").select("node").distinct()
    out = edges.join(live.select(F.col("node").alias("src"), F.lit(True).alias("_a")), "src", "left").join(live.select(F.col("node").alias("dst"), F.lit(True).alias("_b")), "dst", "left")
    back = F.col("_a") & F.col("_b")
    return out.withColumn("superseded_at", F.when(~F.coalesce(back, F.lit(False)), F.col("superseded_at"))).select(*edges.columns)


def cursor_diff(entries: DataFrame, cursor: DataFrame) -> DataFrame:
    """(memory_id, op): what a peer with this cursor lacks."""
    joined = entries.join(cursor.select("memory_id", F.col("version").alias("seen")), "memory_id", "left")
    op = F.when(F.col("status") != "active", F.when(F.col("seen").isNotNull(), "supersede")).when(F.col("seen").isNull(), "create").when(F.col("seen") != F.col("version"), "update")
    return joined.withColumn("op", op).where("op is not null").select("memory_id", "op")


def route_of(kind: Column, version: Column, own: Column) -> Column:
    """What becomes of an operation that wasn't seen before, by the own memory's version (null without one)."""
    flagged = F.when(own.isNotNull(), "flag").otherwise("skip")
    return F.when(kind == "supersede", flagged).when(own.isNull(), "candidate").when(own == version, "same").otherwise("conflict")


def route_ops(ops: DataFrame, memory: DataFrame, seen: DataFrame) -> DataFrame:
    """(op_id, route): skip, flag, same, conflict or candidate."""
    known = seen.select("op_id", F.lit(True).alias("_seen")).distinct()
    own = ops.join(known, "op_id", "left").join(memory.select("memory_id", F.col("version").alias("_own")), "memory_id", "left")
    route = F.when(F.col("_seen"), "skip").otherwise(route_of(F.col("kind"), F.col("version"), F.col("_own")))
    return own.select("op_id", route.alias("route"))


def decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """New states by decision; an edit without text is an error and changes nothing."""
    state = F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "edit", "edited").when(F.col("action") == "reject", "rejected").when(F.col("action") == "defer", "deferred").when(F.col("action") == "merge", "merged")
    bad = (F.col("action") == "edit") & (F.trim(F.coalesce("replacement", F.lit(""))) == "")
    out = items.join(decisions, "id", "left")
    return out.select("id", F.when(F.col("action").isNotNull() & ~bad, state).otherwise(F.col("state")).alias("state"), F.when(bad, "replacement text is required").alias("error"))


def freshness_reasons(memory: DataFrame, today: Column, age_limit: int = 365, unused: int = 90, versioned: int = 180) -> DataFrame:
    """memory_id, reason of all active memories that aren't flagged yet; a null reason where there is nothing to review."""
    age = F.datediff(today, F.to_date(F.substring(F.col("created_at").cast("string"), 1, 10)))
    reason = (
        F.when(T.quality_label(F.col("category"), F.concat(F.lit("\n"), F.col("body"))) != "General", "LowQuality")
        .when((age >= versioned) & T.version_sensitive("body"), "VersionSensitive")
        .when((F.col("hit_count") == 0) & (age >= unused), "Unused")
        .when(age >= age_limit, "Age")
    )
    return memory.where("status = 'active' and not stale").select("memory_id", reason.alias("reason"))


def freshness(memory: DataFrame, today: Column, max_flags: int = 25, age_limit: int = 365, unused: int = 90, versioned: int = 180) -> DataFrame:
    """memory_id, reason of the memories to review, the most actionable first."""
    rank = F.when(F.col("reason") == "LowQuality", 0).when(F.col("reason") == "VersionSensitive", 1).when(F.col("reason") == "Unused", 2).otherwise(3)
    out = freshness_reasons(memory, today, age_limit, unused, versioned).where("reason is not null")
    return out.orderBy(rank, "memory_id").limit(max_flags)


def freshness_report(memory: DataFrame, today: Column, scopes: tuple[str, ...], max_flags: int = 25) -> DataFrame:
    """What a pass over the scopes would do, in one row: scanned, matches by reason before the cap, flagged, capped."""
    found = freshness_reasons(memory.where(F.col("store").isin(*scopes)), today)
    named = (("low_quality", "LowQuality"), ("version_sensitive", "VersionSensitive"), ("unused", "Unused"), ("age", "Age"))
    matches = F.count("reason")
    return found.agg(
        F.count("*").alias("scanned"), *[F.count_if(F.col("reason") == r).alias(c) for c, r in named],
        F.least(matches, F.lit(max_flags)).alias("flagged"), (matches > max_flags).alias("capped"),
    )


def first_per(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def budgeted(rows: DataFrame, key: str, size: Column, order: list[str], budget: int) -> DataFrame:
    """key, run: the running sum of sizes in the order given, as far as the budget goes; the first row always.

    Ranges of the order are summed on their own, each from the total of those before it.
    """
    keys = [F.col(f"_o{i}").desc() if o.startswith("-") else F.col(f"_o{i}").asc() for i, o in enumerate(order)]
    own = rows.select(key, size.cast("long").alias("_size"), *[F.col(o.lstrip("-")).alias(f"_o{i}") for i, o in enumerate(order)])
    own = settle(own.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "budget")
    totals = own.groupBy("_part").agg(F.sum("_size").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.sum("_total").over(before).alias("_before"), (F.row_number().over(Window.orderBy("_part")) == 1).alias("_first"))
    within = Window.partitionBy("_part").orderBy(*keys)
    run = F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    near = own.join(F.broadcast(starts.where(F.col("_first") | (F.coalesce("_before", F.lit(0)) <= budget))), "_part")
    out = near.withColumn("run", F.coalesce(run + F.coalesce("_before", F.lit(0)), "_before")).withColumn("_n", F.row_number().over(within))
    return out.where((F.col("_first") & (F.col("_n") == 1)) | (F.col("run") <= budget)).select(key, "run")
