"""An inverted index over texts, and ranked keyword search for one query or for many.

``build`` writes three tables to the shared folder:

* ``postings``: a row for each token of a store in some texts, with its places there
  (keys, positions and lengths of the texts, as arrays), so that a place costs some bytes of the
  shuffle; in folders by the term's first characters (``head``) and sorted by term inside, so
  that a search opens only the folders of its terms and skips row groups by range.  The empty
  token stands once for each text;
* ``words``: the sorted dictionary of distinct tokens, from which prefixes and
  substrings are resolved;
* ``stats``: number and mean length of the texts of each store.

``search`` takes a table of queries.  Each distinct term of all queries is resolved
and scored once, in every store by that store's own statistics; queries then meet the
scores of their terms, and only these rows are summed.  Terms of several parts
(``config.toml``) are phrases: their parts must stand next to each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from lorekeep.functions import text as T

from .stages import new_folder, settle

K1, B = 1.2, 0.75
#: Accented letters folded as the tokenizer of the index does.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"
BETWEEN = r"[^\p{IsAlphabetic}\p{N}]+"
#: From so many characters on a term matches as a prefix; from so many terms on two must occur.
MIN_PREFIX, MIN_TERMS_FOR_COVERAGE = 4, 3
#: Letters of the pieces by which many terms meet the dictionary; so few terms are told to its scan.
GRAM, FEW = 3, 64
#: Folders for terms that don't begin with an ASCII letter or digit.
OTHER_HEADS = 64
#: Bytes of texts whose places stand together in a row.
BLOCK_BYTES = 8_000_000
#: Up to so many terms are told to the scan by name, so that it can skip row groups.
NAMED_TERMS = 500
#: Rows (a term in a text) of the texts that meet the queries in one task, and such tasks at least.
GROUP_ROWS, LEAST_GROUPS = 2_000_000, 16


def folded(x: str | Column) -> Column:
    return F.lower(F.translate(T.col(x), ACCENTED, PLAIN))


def tokens(x: str | Column) -> Column:
    return F.filter(F.split(F.coalesce(T.col(x), F.lit("")), BETWEEN), lambda w: w != "")


def head(term: Column) -> Column:
    """The folder of a term: its first two characters where they are ASCII letters or digits."""
    first = F.concat(F.lit("_"), F.pmod(F.crc32(F.substring(term, 1, 1).cast("binary")), F.lit(OTHER_HEADS)).cast("string"))
    return F.when(term.rlike("^[a-z0-9]{2}"), F.substring(term, 1, 2)).when(term.rlike("^[a-z0-9]"), F.substring(term, 1, 1)).otherwise(first)


def pieces(term: Column) -> Column:
    """The distinct pieces of one to three characters of a token."""
    size = F.char_length(term)
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(term, i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*[cut(n) for n in range(1, GRAM + 1)])))


@dataclass(frozen=True)
class Index:
    """A built index: ``key`` and ``store`` together name a text."""

    spark: SparkSession
    path: str
    key: str
    store: str
    schemas: dict[str, StructType] = field(default_factory=dict, compare=False)

    def write(self, name: str, df: DataFrame, by: list[str]) -> None:
        self.schemas[name] = df.schema
        df.write.partitionBy(*by).parquet(f"{self.path}/{name}")

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        """A table; of postings each place as a row, which Spark makes of the rows that its filters leave."""
        own = self.stored(name)
        if name != "postings":
            return own
        places = F.inline(F.arrays_zip(F.col("keys").alias(self.key), F.col("lens").alias("len"), F.col("poss").alias("pos")))
        return own.select(self.store, "term", "raw", "head", places).toDF(self.store, "term", "raw", "head", self.key, "len", "pos")


def build(rows: DataFrame, path: str | None = None, key: str = "memory_id", body: str = "body", store: str = "store") -> Index:
    """Index the texts of ``rows``; null and empty texts count as texts of length 0.

    Tokens are dealt to the folders by size (a folder that holds a third of all
    tokens is written by many tasks) and each text is cut into tokens once.
    """
    path = path or new_folder(rows.sparkSession, "index")
    text = F.coalesce(F.col(body), F.lit(""))
    ascii_ = F.octet_length(text) == F.char_length(text)
    lowered = lambda words: F.transform(words, lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(folded(w)))
    terms = F.when(ascii_, tokens(F.lower(text))).otherwise(lowered(tokens(text)))
    raw = F.when(~ascii_, F.array_join(tokens(T.ascii_lower(text)), "\n"))
    own = rows.select(F.col(key), F.col(store), F.array_join(terms, "\n").alias("terms"), raw.alias("raw"))
    kept = own.schema[key].dataType
    schema = StructType([own.schema[store], StructField("term", StringType()), StructField("raw", StringType()), StructField("keys", ArrayType(kept)), *[StructField(c, ArrayType(IntegerType())) for c in ("lens", "poss")]])
    blocks = own.mapInArrow(lambda batches: _blocks(batches, to_arrow_schema(schema)), schema).withColumn("head", head(F.col("term")))
    index = Index(rows.sparkSession, path, key, store)
    index.write("postings", blocks.hint("rebalance", "head").sortWithinPartitions("head", "term"), ["head"])
    words = index.stored("postings").where("term <> ''").select("term", "raw").distinct()
    index.write("words", words.repartitionByRange("term").sortWithinPartitions("term"), [])
    stats = index.table("postings").where((F.col("head") == head(F.lit(""))) & (F.col("term") == "")).groupBy(store).agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    index.write("stats", stats.coalesce(1), [])
    return index


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of some texts at a time the places of each token in each store as one row; the empty token has a place in every text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False))
        cuts = np.searchsorted(sizes, np.arange(BLOCK_BYTES, int(sizes[-1]) if len(sizes) else 0, BLOCK_BYTES))
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
            if high > low:
                yield _block(batch.slice(low, high - low), schema)


def _block(texts: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    key, store, terms, raw = texts.columns
    n = len(texts)
    cut = pc.split_pattern(terms, "\n")
    some = pc.not_equal(terms, "").to_numpy(zero_copy_only=False)
    lens = np.where(some, pc.list_value_length(cut).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    of = np.repeat(np.arange(n), lens)
    pos = np.arange(len(of)) - np.repeat(np.cumsum(lens) - lens, lens)
    words = cut.filter(pa.array(some)).flatten()
    # what a token was before it was folded, where that differs
    was = pc.if_else(pc.is_null(raw), terms, raw)
    was = pc.split_pattern(was, "\n").filter(pa.array(some)).flatten()
    was = pc.if_else(pc.equal(was, words), pa.scalar(None, pa.string()), was)
    words, was = pa.concat_arrays([words.cast(pa.string()), pa.array([""] * n, pa.string())]), pa.concat_arrays([was.cast(pa.string()), pa.nulls(n, pa.string())])
    of, pos = np.concatenate([of, np.arange(n)]), np.concatenate([pos, np.full(n, -1)])
    codes, kinds = [], []
    for column in (store.take(pa.array(of)), words, was):
        d = column.dictionary_encode()
        codes.append(pc.fill_null(d.indices, len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64))
        kinds.append((d.dictionary, len(d.dictionary) + 1))
    code = (codes[0] * kinds[1][1] + codes[1]) * kinds[2][1] + codes[2]
    by = np.argsort(code, kind="stable")
    firsts = np.flatnonzero(np.concatenate([[True], code[by][1:] != code[by][:-1]]))
    offsets = pa.array(np.concatenate([firsts, [len(by)]]), pa.int32())
    named = [kinds[i][0].take(pa.array([c if c < len(kinds[i][0]) else None for c in codes[i][by[firsts]].tolist()], pa.int64())) for i in range(3)]
    at = of[by]
    lists = [key.take(pa.array(at)), pa.array(lens[at], pa.int32()), pa.array(pos[by], pa.int32())]
    lists = [pa.ListArray.from_arrays(offsets, x) for x in lists]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*named, *lists], schema)], schema=schema)


def opened(spark: SparkSession, path: str, key: str = "memory_id", store: str = "store") -> Index:
    """An index that another session built at ``path``."""
    return Index(spark, path, key, store, {name: spark.read.parquet(f"{path}/{name}").schema for name in ("postings", "words", "stats")})


def query_terms(queries: DataFrame, ask: str = "ask", text: str = "query") -> DataFrame:
    """ask, n, term, times, last: the significant terms of each query, in lower case, how often and where last each occurs."""
    found = queries.select(F.col(ask).alias("ask"), F.transform(T.significant(text), T.ascii_lower).alias("_t"))
    found = found.select("ask", F.size("_t").alias("n"), F.posexplode("_t").alias("_i", "term"))
    return found.groupBy("ask", "n", "term").agg(F.count("*").alias("times"), F.max("_i").alias("last"))


def _terms(asked: DataFrame) -> DataFrame:
    """Each distinct term of the queries: its parts, whether it is open at its end, whether its occurrence is asked for."""
    own = asked.groupBy("term").agg(F.max(F.col("n") >= MIN_TERMS_FOR_COVERAGE).alias("cover"))
    own = own.withColumn("parts", F.transform(tokens("term"), folded)).where(F.size("parts") > 0)
    simple = (F.size("parts") == 1) & ~F.col("term").rlike(BETWEEN)
    return own.select("term", "parts", (F.char_length("term") >= MIN_PREFIX).alias("open"), simple.alias("simple"), (F.col("cover") & simple).alias("cover"))


def resolved(index: Index, terms: DataFrame, hits_only: bool = False) -> DataFrame:
    """term, at, word, raw, hit, covers: the tokens of the index that serve each part of each term.

    With ``hits_only`` tokens that only hold a term inside are left out.
    A few terms are tested in one scan of the dictionary; many meet it by the first
    piece of each, of which a token has up to three times its length.
    """
    parts = terms.select("term", F.posexplode("parts").alias("at", "part"), "open", "cover", F.size("parts").alias("m"))
    parts = parts.withColumn("open", F.col("open") & (F.col("at") + 1 == F.col("m")))
    asks = parts.select("term", "at", "open", F.lit(False).alias("sub"), F.col("part").alias("needle"))
    if hits_only:
        parts = parts.withColumn("cover", F.lit(False))
    asks = asks.unionByName(parts.where("cover").select("term", "at", "open", F.lit(True).alias("sub"), F.col("term").alias("needle")))
    words = index.table("words").withColumnRenamed("term", "word")
    few = asks.limit(FEW + 1).collect()
    if len(few) <= FEW:
        named = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in few]) if few else F.array().cast("array<struct<term:string,at:int,open:boolean,sub:boolean,needle:string>>")
        met = words.select("word", "raw", F.inline(F.filter(named, lambda n: _serves(n["open"], n["sub"], n["needle"]))))
    else:
        grams = words.select("word", "raw", F.explode(F.array_union(pieces(F.col("word")), F.coalesce(pieces(F.col("raw")), F.array().cast("array<string>")))).alias("gram"))
        met = asks.withColumn("gram", F.substring("needle", 1, GRAM)).join(grams, "gram").where(_serves(F.col("open"), F.col("sub"), F.col("needle")))
    if hits_only:
        inside = F.contains(F.coalesce("raw", "word"), F.col("term"))
        return met.join(terms.select("term", "cover"), "term").groupBy("term", "at", "word", "raw").agg(F.lit(True).alias("hit"), F.max(F.col("cover") & inside).alias("covers"))
    return met.groupBy("term", "at", "word", "raw").agg(F.max(~F.col("sub")).alias("hit"), F.max("sub").alias("covers"))


def _serves(open_: Column, sub: Column, needle: Column) -> Column:
    """Whether a token holds the needle (``sub``), begins with it (``open_``) or is equal to it."""
    word = F.col("word")
    return F.when(sub, F.contains(F.coalesce("raw", "word"), needle)).when(open_, F.startswith(word, needle)).otherwise(word == needle)


def _met(index: Index, terms: DataFrame, texts: DataFrame | None = None, hits_only: bool = False) -> DataFrame:
    """term, key, store, len, pos, at, m, hit, covers: each place of each token that serves a part of a term.

    Only the folders of the resolved tokens are opened; with ``texts`` only their places are kept.
    """
    words = settle(resolved(index, terms, hits_only), "resolved")
    named = words.select("word", head(F.col("word")).alias("head")).distinct().limit(NAMED_TERMS + 1).collect()
    some = len(named) <= NAMED_TERMS
    heads = {r["head"] for r in (named if some else words.select(head(F.col("word")).alias("head")).distinct().collect())}  # 36 * 37 + 64 at most
    postings = index.table("postings").where(F.col("head").isin(*heads))
    if some:
        postings = postings.where(F.col("term").isin(*{r["word"] for r in named}))
    if texts is not None:
        postings = postings.join(texts, [index.key, index.store], "left_semi")
    postings = postings.withColumnRenamed("term", "word")
    same_raw = F.col("p.raw").eqNullSafe(F.col("w.raw"))
    met = postings.alias("p").join(words.alias("w"), (F.col("p.word") == F.col("w.word")) & same_raw)
    met = met.select("w.term", "w.at", "hit", "covers", *[F.col(f"p.{c}") for c in (index.key, index.store, "len", "pos")])
    return met.join(terms.select("term", F.size("parts").alias("m")), "term")


def _phrases(index: Index, met: DataFrame) -> DataFrame:
    """term, key, store, len, m, pos: where the m parts of a term stand at places that follow one another."""
    starts = met.where("m > 1 and hit").groupBy("term", index.key, index.store, "len", "m", (F.col("pos") - F.col("at")).alias("pos")).agg(F.count("*").alias("_c"))
    return starts.where("_c = m").drop("_c")


def term_rows(index: Index, terms: DataFrame, hits_only: bool = False) -> DataFrame:
    """term, key, store, len, tf, covered: the texts in which each term matches or (not with ``hits_only``) occurs."""
    met, names = _met(index, terms, None, hits_only), ["term", index.key, index.store, "len"]
    phrases = _phrases(index, met).groupBy(*names).agg(F.count("*").alias("tf"), F.lit(False).alias("covered"))
    single = met.where("m = 1").groupBy(*names).agg(F.count_if("hit").alias("tf"), F.max("covers").alias("covered"))
    return single.unionByName(phrases)


def places(index: Index, terms: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """term, key, store, len, m, pos: every place at which a term matches, in all texts or in those of ``texts`` (key, store)."""
    met = _met(index, terms.withColumn("cover", F.lit(False)), texts)
    single = met.where("m = 1 and hit").select("term", index.key, index.store, "len", "m", "pos")
    return single.unionByName(_phrases(index, met))


def weighed(index: Index, terms: DataFrame, hits_only: bool = False) -> DataFrame:
    """``term_rows`` with ``score``: what the term adds in that text, by the statistics of its store."""
    rows = settle(term_rows(index, terms, hits_only), "term-rows")
    found = rows.where("tf > 0").groupBy("term", index.store).agg(F.count("*").alias("df")).join(index.table("stats"), index.store)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = found.select("term", index.store, F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf"), "mean")
    tf = F.col("tf")
    score = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return rows.join(found, ["term", index.store], "left").withColumn("score", F.when(tf > 0, score).otherwise(0.0)).select("term", index.key, index.store, "tf", "covered", "score")


def search(index: Index, queries: DataFrame, bodies: DataFrame | None = None, most: int | None = None, ask: str = "ask", text: str = "query", few: bool = False) -> DataFrame:
    """ask, key, store, score, rank_score: the ranked matches of each query.

    Of queries with three terms or more at least two must occur as substrings of the
    text.  For terms of letters and digits the dictionary tells; for others in such
    queries ``bodies`` (key, store, body) are read for the texts that match.  With
    ``most`` only that many matches of each query remain, ties by key and store.
    ``few`` says that the queries are a handful: their terms aren't written out.
    """
    asked = query_terms(queries, ask, text)
    asked = _local(asked) if few else settle(asked, "asked")
    terms = _local(_terms(asked)) if few else settle(_terms(asked), "terms")
    rows = weighed(index, terms)
    names = [index.key, index.store]
    both = asked.join(rows, "term").where((F.col("tf") > 0) | (F.col("n") >= MIN_TERMS_FOR_COVERAGE))
    summed = both.groupBy("ask", "n", *names).agg(
        F.sum(F.col("score") * F.col("times")).alias("_score"), F.max(F.col("tf") > 0).alias("_hit"), F.sum(F.when(F.col("covered"), F.col("times")).otherwise(0)).alias("_covered")
    ).where("_hit")
    compound = asked.where(f"n >= {MIN_TERMS_FOR_COVERAGE}").join(terms.where("not simple").select("term"), "term")
    if bodies is not None and compound.head(1):
        own = summed.where("_covered < 2").join(compound.select("ask", "term", "times"), "ask").join(bodies.select(*names, F.col("body").alias("_body")), names)
        more = own.where(F.contains(T.ascii_lower("_body"), F.col("term"))).groupBy("ask", *names).agg(F.sum("times").alias("_more"))
        summed = summed.join(more, ["ask", *names], "left").withColumn("_covered", F.col("_covered") + F.coalesce("_more", F.lit(0)))
    out = summed.where((F.col("n") < MIN_TERMS_FOR_COVERAGE) | (F.col("_covered") >= 2))
    out = out.select(F.col("ask").alias(ask), *names, F.greatest(F.lit(1), F.round(F.col("_score") * 100)).cast("long").alias("score"), F.round("_score", 6).alias("rank_score"))
    if most is None:
        return out
    order = Window.partitionBy(ask).orderBy(F.desc("rank_score"), *names)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def leading(index: Index, queries: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """ask, key, store, score, rank_score: of ``search`` among ``rows`` (key, store, body; one store) the first ``most`` of each query.

    Texts are dealt to groups with what each term adds to them, and all queries go to each group; there
    scores are summed in arrays, and only a group's first texts of a query leave it.  Tokens that hold a
    term inside aren't looked for: where the tokens that match don't tell that enough terms occur, a
    text before the last of these leaves the group as well, and its body tells.
    """
    names = [index.key, index.store]
    asked = settle(query_terms(queries), "asked")
    terms = settle(_terms(asked), "terms")
    own = settle(weighed(index, terms, True).join(rows.select(*names), names, "left_semi").withColumn("covered", F.coalesce("covered", F.lit(False))), "weighed")
    groups = max(LEAST_GROUPS, -(-own.count() // GROUP_ROWS))
    left = own.select(*names, "term", "tf", "covered", "score", F.pmod(F.xxhash64(index.key), F.lit(groups)).alias("_g"))
    right = asked.select("ask", "n", "term", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("_g"))
    schema = StructType([asked.schema["ask"], *[own.schema[c] for c in names], StructField("_score", DoubleType()), StructField("_sure", BooleanType())])
    arrow = to_arrow_schema(schema)

    def first(texts: pa.Table, said: pa.Table) -> pa.Table:
        return _first(texts, said, names, most, arrow)

    both = left.repartition(groups, "_g").groupBy("_g").cogroup(right.repartition(groups, "_g").groupBy("_g"))
    found = settle(both.applyInArrow(first, schema), "first")
    more = found.where("not _sure").join(asked, "ask").join(rows.select(*names, F.col("body").alias("_body")), names).where(F.contains(T.ascii_lower("_body"), F.col("term")))
    more = more.groupBy("ask", *names, "_score", "_sure").agg(F.sum("times").alias("_covered")).where("_covered >= 2")
    fine = found.where("_sure").unionByName(more.drop("_covered"))
    out = fine.select("ask", *names, F.greatest(F.lit(1), F.round(F.col("_score") * 100)).cast("long").alias("score"), F.round("_score", 6).alias("rank_score"))
    order = Window.partitionBy("ask").orderBy(F.desc("rank_score"), *names)  # a query's first of each group
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def _first(texts: pa.Table, said: pa.Table, names: list[str], most: int, schema: pa.Schema) -> pa.Table:
    """The first texts of a group for each query."""
    if not len(texts) or not len(said):
        return schema.empty_table()
    numpy = lambda t, c: t[c].to_numpy()
    keys, text = np.unique(numpy(texts, names[0]), return_inverse=True)
    words, term = np.unique(numpy(texts, "term").astype(str), return_inverse=True)
    by = np.argsort(term, kind="stable")
    text, tf, covered, score = text[by], numpy(texts, "tf")[by] > 0, numpy(texts, "covered")[by].astype(bool), numpy(texts, "score")[by]
    begins = np.searchsorted(term[by], np.arange(len(words) + 1))
    asks, of = np.unique(numpy(said, "ask"), return_inverse=True)
    wanted = numpy(said, "term").astype(str)
    at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
    some = words[at] == wanted
    line = np.flatnonzero(some)[np.argsort(of[some], kind="stable")]
    ends = np.searchsorted(of[line], np.arange(len(asks) + 1))
    n, times = numpy(said, "n"), numpy(said, "times")
    out = []
    for a in range(len(asks)):
        own = line[ends[a] : ends[a + 1]]
        if not len(own):
            continue
        rows = np.concatenate([np.arange(begins[t], begins[t + 1]) for t in at[own]])
        weight = np.repeat(times[own], begins[at[own] + 1] - begins[at[own]])
        of_text = text[rows]
        sums = np.bincount(of_text, score[rows] * weight, len(keys))
        hit = np.bincount(of_text, tf[rows], len(keys)) > 0
        fine = hit & (np.bincount(of_text, covered[rows] * weight, len(keys)) >= 2) if n[own[0]] >= MIN_TERMS_FOR_COVERAGE else hit
        rank = np.floor(sums * 1e6 + 0.5)
        # keys are in order, so that of equal scores the smaller one comes first
        best = np.flatnonzero(fine)
        if len(best) > most:
            best = best[rank[best] >= np.partition(rank[best], len(best) - most)[len(best) - most]]
            best = best[np.argsort(-rank[best], kind="stable")[:most]]
        rest = hit & ~fine
        best = np.concatenate([best, np.flatnonzero(rest & (rank >= rank[best].min()) if len(best) == most else rest)])
        out.append((np.full(len(best), a), best, sums[best], fine[best]))
    if not out:
        return schema.empty_table()
    a, best, sums, fine = (np.concatenate(c) for c in zip(*out))
    store = pa.array([texts[names[1]][0].as_py()] * len(a), schema.field(names[1]).type)
    columns = [pa.array(asks[a], schema.field("ask").type), pa.array(keys[best], schema.field(names[0]).type), store, pa.array(sums), pa.array(fine)]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _local(df: DataFrame) -> DataFrame:
    """The few rows of a handful of queries, by way of the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def search_one(index: Index, query: str, bodies: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """key, store, score, rank_score of the matches of one query."""
    asked = index.spark.createDataFrame([(0, query)], "ask int, query string")
    plain = all(re.fullmatch(r"[^\W_]+", t) for t in T.significant_terms(query))
    bodies = None if plain else bodies
    return search(index, asked, bodies, most, few=True).drop("ask")
