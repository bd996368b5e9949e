"""The passage of a text that shows most of a query, and the accepted memory nearest to a candidate.

A passage has 32 tokens.  It may begin at a place of a term, moved so that the
terms of its window stand in the middle, or at the sentence that holds that place; the
window with most distinct terms wins, then the one with most places, the first of
equals.  Windows slide over the places of a text, in Spark's range frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T

from . import index as I
from .matches import FIRST_SENTENCE, SENTENCE, TOKENS, nearest
from .stages import settle

# Fixed value: a passage's mark of omission.
ELLIPSIS = "…"
# Overlaps from which a memory is a candidate's topic, and its duplicate.
TOPIC, DUPLICATE = 0.3, 0.6
_ALNUM = r"\p{IsAlphabetic}\p{N}"


def cut_words(body: str) -> Column:
    """The tokens of a text, each with what stands before it."""
    return F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(f"[^{_ALNUM}]*[{_ALNUM}]+"), F.lit(0))


def passages(index: I.Index, queries: DataFrame, hits: DataFrame, bodies: DataFrame, few: bool = False) -> DataFrame:
    """``hits`` (ask, key, store, ...) with ``snippet``; ``bodies``: key, store, body.

    A text without places of the query's terms has a null snippet.  ``few`` says that the
    hits are a small part of all that the queries match: only their texts' places are read.
    """
    names = [index.key, index.store]
    asked = settle(I.query_terms(queries), "asked")
    found = hits.select("ask", *names).join(asked, "ask").join(I.places(index, I._terms(asked), hits.select(*names).distinct() if few else None), ["term", *names])
    found = settle(found.select("ask", *names, "len", "pos", "m", "term", "times", "last"), "places")
    texts = settle(bodies.join(hits.select(*names).distinct(), names, "left_semi").select(*names, cut_words("body").alias("words"), F.regexp_extract("body", f"[^{_ALNUM}]*$", 0).alias("tail")), "texts")
    # sentences: a text's first token, and those with a full stop or a colon and white space before them
    begins = texts.select(*names, F.posexplode("words").alias("pos", "_w")).where((F.col("pos") == 0) | F.col("_w").rlike(f"[.:][ \\t\\r\\n]+[{_ALNUM}]")).select(*names, "pos", F.lit(0).alias("_k"))
    marks = found.where(f"len > {TOKENS}").select(*names, "pos", F.lit(1).alias("_k")).distinct()
    before = Window.partitionBy(*names).orderBy("pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    inside = begins.unionByName(marks).withColumn("begin", F.last(F.when(F.col("_k") == 0, F.col("pos")), ignorenulls=True).over(before)).where("_k = 1 and begin < pos").select(*names, "pos", "begin")
    sentences = found.join(inside, [*names, "pos"]).groupBy("ask", *names, "len", "begin").agg(F.min("pos").alias("at"))
    rows = found.select("ask", *names, "len", "pos", F.col("pos").alias("at"), F.lit(0).alias("kind"), F.struct("term", "times").alias("_seen"), "times", F.struct("pos", "last", "m").alias("_place"))
    rows = rows.unionByName(sentences.select("ask", *names, "len", F.col("begin").alias("pos"), "at", F.lit(1).alias("kind")), allowMissingColumns=True)
    ahead = Window.partitionBy("ask", *names).orderBy("pos").rangeBetween(0, TOKENS - 1)
    rows = rows.withColumn("_terms", F.collect_set("_seen").over(ahead)).withColumn("_all", F.sum("times").over(ahead)).withColumn("_last", F.max("_place").over(ahead))
    distinct = F.aggregate("_terms", F.lit(0).cast("long"), lambda s, x: s + x["times"])
    bonus = F.when(F.col("kind") == 0, 0).when(F.col("pos") == 0, FIRST_SENTENCE).otherwise(SENTENCE)
    span = F.col("_last.pos") + F.col("_last.m") - F.col("pos")
    middle = F.greatest(F.lit(0), F.least(F.col("pos") - ((TOKENS - span) / 2).cast("int"), F.col("len") - TOKENS))
    start = F.when(F.col("kind") == 0, middle).otherwise(F.col("pos"))
    best = rows.groupBy("ask", *names, "len").agg(F.max(F.struct((1000 * distinct + F.col("_all") - distinct + bonus).alias("score"), (-F.col("at")).alias("a"), (-F.col("kind")).alias("k"), start.alias("start"))).alias("b"))
    best = best.select("ask", *names, "len", F.col("b.start").alias("start"))
    part = F.concat_ws("", F.slice("words", F.col("start") + 1, F.lit(TOKENS)))
    part = F.when(F.col("start") > 0, F.concat(F.lit(ELLIPSIS), F.regexp_replace(part, f"^[^{_ALNUM}]+", ""))).otherwise(part)
    part = F.concat(part, F.when(F.col("start") + TOKENS >= F.col("len"), F.col("tail")).otherwise(F.lit(ELLIPSIS)))
    cut = best.join(texts, names).select("ask", *names, part.alias("snippet"))
    return hits.join(cut, ["ask", *names], "left")


def _leading(hits: DataFrame, names: list[str], most: int) -> DataFrame:
    """The first ``most`` project hits of each query, and all others of those queries that have fewer."""
    own = settle(hits, "found")
    _, store = names
    order = Window.partitionBy("ask").orderBy(F.desc("rank_score"), *names)
    first = settle(own.where(F.col(store) == "project").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most), "leading")
    full = first.where(F.col("_n") == most).select("ask")
    return first.drop("_n").unionByName(own.where(F.col(store) != "project").join(full, "ask", "left_anti"))


def in_order(hits: DataFrame, rows: DataFrame, names: list[str], most: int | None = None) -> DataFrame:
    """``hits`` of all stores as one list: ``rank`` puts project hits first; other stores' copies of them are gone.

    A copy has the id or the whole text of a project hit of the same query.  With ``most``
    only so many hits of each query are put in order, and only their texts are compared.
    """
    if most is not None:
        return in_order(_leading(hits, names, most), rows, names).where(F.col("rank") <= most)
    own = settle(hits.join(rows.select(*names, F.sha2(F.coalesce("body", F.lit("")), 256).alias("_text")), names), "hits")
    key, store = names
    project, other = own.where(F.col(store) == "project"), own.where(F.col(store) != "project")
    other = other.join(project.select("ask", key), ["ask", key], "left_anti").join(project.select("ask", "_text"), ["ask", "_text"], "left_anti")
    order = Window.partitionBy("ask").orderBy(F.col(store) != "project", F.desc("rank_score"), *names)
    return project.unionByName(other).withColumn("rank", F.row_number().over(order)).drop("_text")


def first_hits(index: I.Index, queries: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """``in_order`` of the hits of ``queries`` among ``rows`` (key, store, body), the first ``most`` of each.

    Only of queries with fewer project hits are all hits asked for.
    """
    names = [index.key, index.store]
    own = settle(I.leading(index, queries, rows.where(F.col(index.store) == "project"), most), "leading")
    full = own.groupBy("ask").agg(F.count("*").alias("_n")).where(F.col("_n") >= most).select("ask")
    rest = settle(queries.select("ask", "query").join(full, "ask", "left_anti"), "lacking")
    hits = own.join(full, "ask", "left_semi")
    if rest.head(1):
        hits = hits.unionByName(I.search(index, rest, rows).join(rows.select(*names), names, "left_semi"))
    return in_order(hits, rows, names, most)


def related(index: I.Index, queries: DataFrame, rows: DataFrame, most: int = 5) -> DataFrame:
    """ask, related: the ids of the first hits of each query, in their order; queries without any have no row."""
    first = first_hits(index, queries, rows, most)
    return first.groupBy("ask").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", index.key))), lambda x: x[index.key]).alias("related"))  # ``most`` rows


def accepted_matches(index: I.Index, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """ask, key, store, overlap, topic, duplicate: the memory whose passage overlaps most with each query.

    ``rows``: the memories that may be found, with body; of equal overlaps the first hit
    counts.  Queries without a hit have no row.
    """
    names = [index.key, index.store]
    asked = settle(I.query_terms(queries), "asked")
    near = settle(nearest(asked, queries, rows.select(*names, "body"), names), "near")
    top = near.groupBy("ask").agg(F.max("overlap").alias("overlap"))
    home = F.when(F.col(names[1]) == "project", 0).otherwise(1)
    tied = near.join(top, ["ask", "overlap"]).withColumn("_home", home)
    first = tied.groupBy("ask").agg(F.min("_home").alias("_home"), F.count("*").alias("_n"))
    tied = settle(tied.join(first, ["ask", "_home"]), "tied")
    # only of queries with several such texts the ranks are asked for
    terms = asked.join(tied.where("_n > 1").select("ask").distinct(), "ask", "left_semi")
    scores = terms.join(I.weighed(index, settle(I._terms(terms), "terms")), "term")
    scores = tied.where("_n > 1").select("ask", *names).join(scores, ["ask", *names]).groupBy("ask", *names).agg(F.round(F.sum(F.col("score") * F.col("times")), 6).alias("rank_score"))
    best = tied.join(scores, ["ask", *names], "left").groupBy("ask").agg(F.min(F.struct((-F.col("rank_score")).alias("_r"), *names, "overlap")).alias("b"))
    best = best.select("ask", *[F.col(f"b.{c}").alias(c) for c in (*names, "overlap")])
    return best.withColumn("topic", F.col("overlap") >= TOPIC).withColumn("duplicate", F.col("overlap") >= DUPLICATE)
