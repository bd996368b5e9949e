"""Code structure and memory behind one search, tests of functions, overviews and primers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import hashing as H
from lorekeep.functions import text as T

from .review import code_language
from .search import ranked, rerank_scored

SEARCHED_KINDS = ("file", "module", "type", "function", "test", "dependency")
SYMBOL_KINDS = ("function", "type", "module", "test")
EXACT, HEURISTIC = 1.0, 0.6


def term_share(terms: Sequence[str], *parts: str) -> Column:
    """The share of the terms that occur in the parts, whatever their case."""
    if not terms:
        return F.lit(0.0)
    text = F.concat_ws(" ", *[T.ascii_lower(F.coalesce(p, F.lit(""))) for p in parts])
    return sum((F.contains(text, F.lit(t.lower())).cast("int") for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def blend(structural: Column, temporal: Column, intent: Column, weights: H.Weights) -> Column:
    return weights.structural * structural + weights.temporal * temporal + weights.intent * intent


def search(
    nodes: DataFrame, hits: DataFrame, memory: DataFrame, anchors: DataFrame, terms: Sequence[str], today: Column,
    hops: DataFrame | None = None, weights: H.Weights | None = None, falloff: float = 0.5, half_life: float = 30.0,
) -> DataFrame:
    """kind, id, score, structural, temporal, intent of code nodes and memories.

    A node is in scope where the terms match it or, with a focus (``hops`` from
    it), where it lies near.  What is anchored to nodes in scope comes along: it
    raises keyword hits, and memories that no keyword found join by it alone.
    """
    weights = weights or H.Weights()
    own = nodes.where(F.col("kind").isin(*SEARCHED_KINDS))
    own = own.join(hops, "node", "left") if hops is not None else own.withColumn("hops", F.lit(None).cast("int"))
    near = H.proximity_score(F.col("hops"), falloff)
    own = own.withColumn("intent", term_share(terms, "name", "node")).withColumn("structural", near if hops is not None else F.col("confidence").cast("double"))
    own = own.where((F.col("intent") > 0) | ((F.col("structural") > 0) if hops is not None else F.lit(False)))
    own = own.withColumn("temporal", H.temporal_score(F.datediff(today, "created_at").cast("double"), half_life))
    code = own.select(F.lit("code").alias("kind"), F.col("node").alias("id"), "structural", "temporal", "intent")
    pull = own.select("node", (near if hops is not None else F.lit(1.0)).alias("_pull")).join(anchors.select("memory_id", "node", "strength"), "node")
    pull = pull.groupBy("memory_id").agg(F.max(F.col("strength") * F.col("_pull")).alias("anchored"))
    found = hits.join(pull, "memory_id", "left").select(
        F.lit("memory").alias("kind"), F.col("memory_id").cast("string").alias("id"), F.coalesce("anchored", F.lit(0.0)).alias("structural"),
        H.temporal_score(F.datediff(today, "created_at").cast("double"), half_life).alias("temporal"), (1 - 1 / (1 + F.col("score"))).alias("intent"),
    )
    alone = pull.where("anchored > 0").join(hits.select("memory_id"), "memory_id", "left_anti").join(memory.select("memory_id"), "memory_id", "left_semi")
    alone = alone.select(F.lit("memory").alias("kind"), F.col("memory_id").cast("string").alias("id"), F.col("anchored").alias("structural"), F.lit(0.0).alias("temporal"), F.lit(0.0).alias("intent"))
    out = code.unionByName(found).unionByName(alone)
    return out.withColumn("score", blend(F.col("structural"), F.col("temporal"), F.col("intent"), weights)).where("score > 0")


def reranked(found: DataFrame, scores: DataFrame, window: int = 20) -> DataFrame:
    """The first hits with a score of their own exchange places by it: column ``position``."""
    order = [F.desc("score"), "kind", "id"]
    return rerank_scored(ranked(found, order, "rank").join(scores, ["kind", "id"], "left"), window, score="cosine")


def tests_of_functions(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges function -> test (src, dst, derivation, confidence) from calls (file, test, callee).

    The only function of that name in the test's file is exact; else the only one
    anywhere is a heuristic; of several none.
    """
    same = functions.groupBy("file", F.col("name").alias("callee")).agg(F.count("*").alias("here"), F.min("node").alias("local"))
    anywhere = functions.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("total"), F.min("node").alias("only"))
    out = calls.join(same, ["file", "callee"], "left").join(anywhere, "callee", "left")
    local = F.coalesce(F.col("here") == 1, F.lit(False))
    target = F.when(local, F.col("local")).when(F.col("total") == 1, F.col("only"))
    out = out.select(target.alias("src"), F.col("test").alias("dst"), F.when(local, "parsed").otherwise("heuristic").alias("derivation"), F.when(local, EXACT).otherwise(HEURISTIC).alias("confidence"))
    return out.where("src is not null").distinct()


def architecture(files: DataFrame, symbols: DataFrame, calls: DataFrame, top: int = 10) -> DataFrame:
    """section, rank, name, n: counts, languages, packages, entry points and hotspots.

    Each section is cut to ``top`` before it is numbered; languages are few.
    """
    degree = lambda end, name: calls.select("src", "dst").distinct().groupBy(F.col(end).alias("node")).agg(F.count("*").alias(name))
    own = symbols.where(F.col("kind").isin("function", "type")).join(degree("dst", "into"), "node", "left").join(degree("src", "out"), "node", "left").fillna(0, ["into", "out"])
    languages = files.groupBy(F.coalesce(code_language(F.col("path")), F.lit("other")).alias("name")).agg(F.count("*").alias("n"))
    packages = files.groupBy(T.package_of("path").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    entries = own.where("kind = 'function' and into = 0 and out > 0").select(F.col("node").alias("name"), F.col("out").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    hot = own.where("into > 0").select(F.col("node").alias("name"), F.col("into").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "name"))
    sections = {"language": languages, "package": packages, "entry_point": entries, "hotspot": hot}
    rows = None
    for section, part in sections.items():
        part = part.select(F.lit(section).alias("section"), "name", "n")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("rank", rank)
    counts = files.agg(F.count("*").alias("n")).select(F.lit("count").alias("section"), F.lit("files").alias("name"), "n", F.lit(1).alias("rank"))
    n_symbols = symbols.where(F.col("kind").isin(*SYMBOL_KINDS)).agg(F.count("*").alias("n")).select(F.lit("count").alias("section"), F.lit("symbols").alias("name"), "n", F.lit(2).alias("rank"))
    return rows.unionByName(counts).unionByName(n_symbols).select("section", "rank", "name", "n")


def _joined(section: str, item: Column, glue: str) -> Column:
    """The items of a section in order, as one string."""
    rows = F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("rank", item.alias("item")))))
    return F.array_join(F.transform(rows, lambda x: x["item"]), glue)


def _count(name: str) -> Column:
    return F.max(F.when(F.col("name") == name, F.when(F.col("section") == "count", F.col("n"))))


def overview_digest(overview: DataFrame) -> DataFrame:
    """One row: the overview's shape as text, which changes only when the structure does."""
    parts = F.when(F.col("section") == "count", F.lit(None))
    item = {"language": F.concat(F.lit("|L"), "name", F.lit(":"), "n"), "package": F.concat(F.lit("|P"), "name", F.lit(":"), "n"), "entry_point": F.concat(F.lit("|E"), "name"), "hotspot": F.concat(F.lit("|H"), "name", F.lit(":"), "n")}
    for section, text in item.items():
        parts = parts.when(F.col("section") == section, text)
    return overview.agg(F.concat(F.lit("f"), _count("files"), F.lit("s"), _count("symbols"), *[_joined(s, parts, "") for s in item]).alias("digest"))


def primer_body(overview: DataFrame, repo: str, commit: str) -> DataFrame:
    """One row: the primer's text, empty sections left out."""
    counted = F.concat("name", F.lit(" ("), "n", F.lit(")"))
    callers = F.concat("name", F.lit(" ("), "n", F.lit(" callers)"))
    line = lambda head, section, item: F.when(_joined(section, item, "") != "", F.concat(F.lit(f"{head}: "), _joined(section, item, ", "), F.lit(".\n"))).otherwise("")
    return overview.agg(F.concat(
        F.lit(f"Repository primer for {repo}@{commit}.\n"), _count("files"), F.lit(" files, "), _count("symbols"), F.lit(" symbols.\n"), line("Languages", "language", counted),
        line("Top packages", "package", counted), line("Entry points", "entry_point", F.col("name")), line("Most-depended-on", "hotspot", callers),
    ).alias("body"))


def change_impact(reach: DataFrame, symbols: DataFrame, limit: int = 20) -> DataFrame:
    """node, hops, tier: all changed symbols (Direct), then the nearest that depend on them."""
    own = reach.join(symbols.where(F.col("kind").isin(*SYMBOL_KINDS)).select("node"), "node", "left_semi")
    tier = F.when(F.col("hops") == 0, "Direct").when(F.col("hops") == 1, "High").when(F.col("hops") == 2, "Medium").otherwise("Low")
    near = own.where("hops > 0").orderBy("hops", "node").limit(limit)
    return own.where("hops = 0").unionByName(near).select("node", "hops", tier.alias("tier"))


def resolved(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, node, state: the one node of that name outside the repository kind, else Unknown or Ambiguous."""
    found = nodes.where("kind <> 'repository'").groupBy("name").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    state = F.when(F.col("n") == 1, "Resolved").when(F.col("n") > 1, "Ambiguous").otherwise("Unknown")
    return asked.join(found, "name", "left").select("name", F.when(F.col("n") == 1, F.col("node")).alias("node"), state.alias("state"))


def file_degrees(edges: DataFrame, files: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """Files of the highest degree (file, degree), and the edges (a, b) among them."""
    own = edges.join(files.select(F.col("node").alias("src"), F.col("file").alias("a")), "src").join(files.select(F.col("node").alias("dst"), F.col("file").alias("b")), "dst")
    pairs = own.where("a <> b").select("a", "b").distinct()
    degrees = pairs.select(F.col("a").alias("file")).unionAll(pairs.select("b")).groupBy("file").agg(F.count("*").alias("degree"))
    first = degrees.orderBy(F.desc("degree"), "file").limit(top)
    among = pairs.join(first.select(F.col("file").alias("a")), "a", "left_semi").join(first.select(F.col("file").alias("b")), "b", "left_semi")
    return first, among.select("a", "b")
