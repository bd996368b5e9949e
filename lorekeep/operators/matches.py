"""For each of many queries the texts whose passage overlaps most with it, told without a row a pair or a place.

Texts are dealt to groups of a bounded size and queries to blocks; each group meets each block
in one task.  There a text's places of all terms are laid out in numpy arrays, and its passage
(see ``passages``) is only looked for where a bound on the overlap, the query's words that the text
holds over the fewest words of a passage, reaches the best overlap found so far.  Only the
best texts of a query leave the task.
"""

from __future__ import annotations

import json
import json
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lorekeep.functions import text as T

from . import index as I

# Fixed values of a passage: its tokens, and what a sentence's beginning adds.
TOKENS, FIRST_SENTENCE, SENTENCE = 32, 120, 100
#: Characters of texts in a group, and queries in a block.
GROUP_CHARS, BLOCK = 8_000_000, 8192
_ALNUM = r"\p{IsAlphabetic}\p{N}"


def _texts(rows: DataFrame, key: str, store: str) -> DataFrame:
    """key, store, low, terms, words, begins: the text in lower case, its tokens as the index and as overlaps have them (null: the same), where sentences begin."""
    body, own = F.coalesce("body", F.lit("")), F.col("_words")
    ascii_ = F.octet_length(body) == F.char_length(body)
    terms = F.when(ascii_, I.tokens(F.lower(body))).otherwise(F.transform(I.tokens(body), I.folded))
    begins = F.filter(F.transform(own, lambda w, i: F.when((i == 0) | w.rlike(f"[.:][ \\t\\r\\n]+[{_ALNUM}]"), i)), lambda i: i.isNotNull())
    cut = F.regexp_extract_all(body, F.lit(f"[^{_ALNUM}]*[{_ALNUM}]+"), F.lit(0))
    out = rows.where(F.col(key).isNotNull() & F.col(store).isNotNull()).withColumn("_words", cut)
    return out.select(
        key, store, T.ascii_lower(body).alias("low"), F.array_join(terms, "\n").alias("terms"),
        F.when(~ascii_, F.array_join(I.tokens(T.ascii_lower(body)), "\n")).alias("words"), F.array_join(begins.cast("array<string>"), ",").alias("begins"),
    )


def _asks(asked: DataFrame, queries: DataFrame) -> DataFrame:
    """ask, said: a query's words and terms as JSON."""
    parts = F.transform(I.tokens("term"), I.folded)
    term = F.struct("term", "times", "last", parts.alias("parts"), (F.char_length("term") >= I.MIN_PREFIX).alias("open"))
    own = asked.where(F.size(I.tokens("term")) > 0).groupBy("ask", "n").agg(F.collect_list(term).alias("terms"))  # the terms of one query
    words = queries.select("ask", T.token_set("query").alias("words"))
    return own.join(words, "ask").select("ask", F.to_json(F.struct("n", "words", "terms")).alias("said"))


class _Block:
    """The queries of a block, laid out by the words that serve them."""

    def __init__(self, said: list[str]) -> None:
        self.said = [json.loads(s) for s in said]
        self.n_words = np.array([len(q["words"]) for q in self.said], dtype=np.int64)
        self.words = [frozenset(q["words"]) for q in self.said]
        holders, terms = defaultdict(list), {}
        rows = []  # ask, term, times, order by (last, parts), last, parts
        for a, q in enumerate(self.said):
            for w in q["words"]:
                holders[w].append(a)
            for o, t in enumerate(sorted(q["terms"], key=lambda t: (t["last"], len(t["parts"])))):
                at = terms.setdefault(t["term"], len(terms))
                rows.append((at, a, t["times"], o, len(t["parts"])))
        self.holders = {w: np.array(x, dtype=np.int64) for w, x in holders.items()}
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.term, self.ask, self.times, self.order, self.size = table.T
        self.n_terms, self.orders = len(terms), int(self.order.max(initial=0)) + 1
        self.first = np.searchsorted(self.term, np.arange(self.n_terms + 1))
        self.parts = np.ones(self.n_terms, dtype=np.int64)
        self.exact, self.prefix = defaultdict(list), defaultdict(list)
        seen = set()
        for q in self.said:
            for t in q["terms"]:
                if t["term"] not in seen:
                    seen.add(t["term"])
                    at, m = terms[t["term"]], len(t["parts"])
                    self.parts[at] = m
                    for k, part in enumerate(t["parts"]):
                        (self.prefix if t["open"] and k == m - 1 else self.exact)[part].append((at, k))

    def serves(self, word: str) -> np.ndarray:
        """(term, part) that a token serves."""
        found = list(self.exact.get(word, ()))
        for n in range(1, len(word) + 1):
            found += self.prefix.get(word[:n], ())
        return np.array(found, dtype=np.int64).reshape(-1, 2)

    def covered(self, a: int, low: str) -> bool:
        """Whether enough of a query's terms occur as substrings."""
        q, n = self.said[a], 0
        if q["n"] < I.MIN_TERMS_FOR_COVERAGE:
            return True
        for t in q["terms"]:
            n += t["times"] * (t["term"] in low)
            if n >= 2:
                return True
        return False


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first..last: the number of the range of each member, and the members."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def _before(keys: np.ndarray) -> np.ndarray:
    """The place of each key's last occurrence before it, -1 where there is none."""
    by = np.argsort(keys, kind="stable")
    same = keys[by][1:] == keys[by][:-1]
    out = np.full(len(keys), -1, dtype=np.int64)
    out[by[1:][same]] = by[:-1][same]
    return out


def _starts(block: _Block, term: np.ndarray, pos: np.ndarray, keep: np.ndarray, length: int, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asks, starts): where the passage of each kept query begins."""
    of, at = _spread(block.first[term], block.first[term + 1])
    kept = keep[block.ask[at]]
    of, at = of[kept], at[kept]
    if not len(at) or length <= TOKENS:
        asks = np.unique(block.ask[at])
        return asks, np.zeros(len(asks), dtype=np.int64)
    wide = length + TOKENS + 1
    line = block.ask[at] * wide + pos[of]
    by = np.argsort(line * block.orders + block.order[at], kind="stable")
    at, line, p = at[by], line[by], pos[of][by]
    times, ask, before = block.times[at], block.ask[at], _before(at)
    sums = np.concatenate([[0], np.cumsum(times)])
    new = np.concatenate([[True], line[1:] != line[:-1]])
    a0, p0 = ask[new], p[new]
    # a sentence that begins before a place, once for each query, at its first place
    begin = begins[np.searchsorted(begins, p0, "right") - 1]
    inside = begin < p0
    a1, b1, p1 = a0[inside], begin[inside], p0[inside]
    once = np.concatenate([[True], (a1[1:] != a1[:-1]) | (b1[1:] != b1[:-1])])[: len(a1)]
    a1, b1, p1 = a1[once], b1[once], p1[once]
    asks, begun, first = np.concatenate([a0, a1]), np.concatenate([p0, b1]), np.concatenate([p0, p1])
    kind = np.repeat([0, 1], [len(a0), len(a1)])
    low, high = (np.searchsorted(line, asks * wide + begun + d, side) for d, side in ((0, "left"), (TOKENS - 1, "right")))
    distinct = np.zeros(len(asks), dtype=np.int64)
    live, d = np.arange(len(asks)), 0
    while len(live := live[low[live] + d < high[live]]):
        j = low[live] + d
        distinct[live] += times[j] * (before[j] < low[live])
        d += 1
    bonus = np.where(kind == 0, 0, np.where(begun == 0, FIRST_SENTENCE, SENTENCE))
    score = 1000 * distinct + (sums[high] - sums[low]) - distinct + bonus
    span = p[high - 1] + block.size[at[high - 1]] - begun
    middle = np.maximum(0, np.minimum(begun - np.trunc((TOKENS - span) / 2).astype(np.int64), length - TOKENS))
    start = np.where(kind == 0, middle, begun)
    by = np.lexsort((kind, first, -score, asks))
    best = by[np.concatenate([[True], asks[by][1:] != asks[by][:-1]])]
    return asks[best], start[best]


def _match(block: _Block, texts: pd.DataFrame) -> list[tuple[int, int, float]]:
    """(query, text, overlap): the texts of a group with the largest overlap of each query."""
    n_asks = len(block.said)
    best, kept = np.full(n_asks, -1.0), defaultdict(list)
    stops, served, held = set(T.STOP_WORDS), {}, {}
    none = np.zeros(0, dtype=np.int64)
    own = texts.iloc[:, :2].itertuples(index=False, name=None)
    keys = [(k, s == "project") for k, s in own]
    twice = {k for k, p in keys if p} & {k for k, p in keys if not p}
    hit_at_home: dict = defaultdict(set)
    # own hits come first, since another store's copy by the id is none; short texts are cheap and raise the bound
    order = sorted(range(len(texts)), key=lambda i: (not keys[i][1] or keys[i][0] not in twice, len(texts["low"].iat[i]), i))
    for i in order:
        low, terms, words, begins = (texts[c].iat[i] for c in ("low", "terms", "words", "begins"))
        if not terms:
            continue
        terms = terms.split("\n")
        words, length = terms if words is None else words.split("\n"), len(terms)
        if len(served) > 200_000:
            served.clear()
        found, where = [], []
        for p, w in enumerate(terms):
            if (s := served.get(w)) is None:
                s = served[w] = block.serves(w)
            if len(s):
                found.append(s)
                where.append(p)
        if not found:
            continue
        n = np.array([len(s) for s in found])
        served_rows, pos = np.concatenate(found), np.repeat(np.array(where, dtype=np.int64), n)
        term, part = served_rows.T
        many = block.parts[term] > 1
        if many.any():
            spot, count = np.unique(term[many] * (length + 1) * 2 + (pos[many] - part[many] + length), return_counts=True)
            whole = spot[count == block.parts[spot // ((length + 1) * 2)]]
            term, pos = np.concatenate([term[~many], whole // ((length + 1) * 2)]), np.concatenate([pos[~many], whole % ((length + 1) * 2) - length])
        begun = np.array(begins.split(","), dtype=np.int64)
        # the words of the passage that may begin at each token, and the fewest of a passage that may be shown
        ids = {}
        code = np.array([-1 if w in stops or len(w.encode()) <= 2 else ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
        at = np.flatnonzero(code >= 0)
        back = _before(code[at])
        since = np.where(back >= 0, at[back] + 1, 0)
        change = np.zeros(length + 1, dtype=np.int64)
        np.add.at(change, np.maximum(since, at - TOKENS + 1).clip(0), 1)
        np.add.at(change, at + 1, -1)
        sizes = np.cumsum(change)[:length]
        fewest = min(sizes[: max(1, length - TOKENS + 1)].min(), sizes[begun].min())
        for w in ids:
            if w not in held:
                held[w] = block.holders.get(w, none)
        shared = np.bincount(np.concatenate([held[w] for w in ids]), minlength=n_asks) if ids else np.zeros(n_asks, dtype=np.int64)
        if len(held) > 200_000:
            held.clear()
        bound = np.minimum(1.0, shared / np.maximum(1, np.minimum(block.n_words, fewest)))
        at_home = keys[i][1] and keys[i][0] in twice
        keep = np.ones(n_asks, dtype=bool) if at_home else bound >= best
        taken = hit_at_home.get(keys[i][0], ()) if not keys[i][1] else ()
        sets: dict[int, set] = {}
        for a, start in zip(*(x.tolist() for x in _starts(block, term, pos, keep, length, begun))):
            if (s := sets.get(start)) is None:
                s = sets[start] = {w for w in words[start : start + TOKENS] if w in ids}
            least = min(len(block.words[a]), len(s))
            overlap = len(block.words[a] & s) / least if least else 0.0
            if (overlap < best[a] and not at_home) or a in taken or not block.covered(a, low):
                continue
            if at_home:
                hit_at_home[keys[i][0]].add(a)
            if overlap > best[a]:
                best[a] = overlap
                kept[a].clear()
            if overlap == best[a]:
                kept[a].append(i)
    return [(a, i, float(best[a])) for a, x in kept.items() for i in x]


def nearest(asked: DataFrame, queries: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """ask, key, store, overlap: of each query all texts whose passage has the largest overlap with it.

    ``asked``: the terms of ``queries`` (ask, query), ``rows``: key, store and body of the texts
    that may be found.  Of two stores' texts with one key, the project's takes the place of the other where both are hits.
    """
    key, store = names
    size = rows.agg(F.sum(F.char_length(F.coalesce("body", F.lit(""))) + 100).alias("c")).first()["c"] or 0
    groups = max(1, -(-size // GROUP_CHARS))
    asks = _asks(asked, queries.where("ask is not null"))
    blocks = max(1, -(-queries.count() // BLOCK))
    slots = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = _texts(rows, key, store).withColumn("_g", F.pmod(F.xxhash64(key), F.lit(groups))).withColumn("_b", slots(blocks))
    right = asks.withColumn("_b", F.pmod(F.xxhash64("ask"), F.lit(blocks))).withColumn("_g", slots(groups))
    schema = StructType([StructField("ask", asks.schema["ask"].dataType), *[rows.schema[c] for c in names], StructField("overlap", DoubleType())])

    def met(texts: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        found = _match(_Block(said["said"].tolist()), texts) if len(texts) and len(said) else []
        a, i = [x[0] for x in found], [x[1] for x in found]
        return pd.DataFrame({"ask": said["ask"].iloc[a].to_numpy(), key: texts[key].iloc[i].to_numpy(), store: texts[store].iloc[i].to_numpy(), "overlap": [x[2] for x in found]})

    both = left.groupBy("_g", "_b").cogroup(right.groupBy("_g", "_b"))
    return both.applyInPandas(met, schema)
