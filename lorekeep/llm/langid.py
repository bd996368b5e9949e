"""Language identification by unigram pieces, summed over all segmentations.

The pieces come from a fixed public vocabulary.  Each language has a probability
for each piece, learned by expectation-maximisation: the forward-backward sums
over all segmentations of a word give the expected counts.  A text's score in a
language is the sum of its words' forward log-probabilities.

The fit reads at most ``MAX_TEXTS`` texts of each language and hash shard
(``SHARDS`` shards), in the order of a hash of the id, while a language's stay
within ``MAX_BYTES`` bytes: the documented bound of the sample, for each language.
All rows are scored, whole.

Edge cases: ``und`` with score 0 where a text is null or has no letter (\\p{L}), or
where no language could be learned; ties go to the first language by name; of rows
that repeat an id and language the smallest text is learned; repeated rows score
alike; an empty table gives no rows; a word of any length is summed step by step;
columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, released, sampled
from .spelling import Rows, slices

MAX_TEXTS, SHARDS, MAX_BYTES = 16, 16, 2 << 20
ROUNDS = 3
UNKNOWN = 1e-7
#: Distinct chunks (between white space), and characters of them, that a task remembers between batches.
CACHE_CHUNKS, CACHE_CHARS = 400_000, 8_000_000
#: Characters of text that are cut into chunks together, and of words that are summed together.
BATCH_CHARS, SHORT = 4_000_000, 24
SPAN = 20
_LETTERS, _LINES = regex.compile(r"\p{L}+"), regex.compile(r"\p{L}+|\n")


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    priors: tuple[float, ...]
    pieces: dict[str, tuple[float, ...]]


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that are text, folded to lower case."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = {own.id_to_piece(i).lower() for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))}
    return sorted(p for p in keep if _LETTERS.fullmatch(p.removeprefix("▁") or "a"))


def words_of(text: str) -> list[str]:
    """Words as scored: runs of letters in lower case, with the mark of a word's start."""
    return ["▁" + w for w in _LETTERS.findall(text.lower())]


def expected(words: Counter, prob: dict[str, float]) -> dict[str, float]:
    """Expected counts of the pieces over all segmentations of the words.

    Sums are kept in steps: a position's is relative to the scale of its block of
    16, so that words of any length neither overflow nor vanish.
    """
    out: dict[str, float] = defaultdict(float)
    get, longest = prob.get, max(map(len, prob), default=1)
    for word, times in words.items():
        n = len(word)
        arcs: list[list[tuple[int, float]]] = [[]]
        ahead, scale = [1.0], [0.0]  # ahead[i] * exp(scale[i]) is the sum up to i
        now = 0.0
        for i in range(1, n + 1):
            total, here = 0.0, []
            for j in range(max(0, i - longest), i):
                p = get(word[j:i])
                if p is None:
                    if i - j > 1:
                        continue
                    p = UNKNOWN
                here.append((j, p))
                total += ahead[j] * p * (math.exp(scale[j] - now) if scale[j] != now else 1.0)
            if i % 16 == 0 and total > 0.0:
                now, total = now + math.log(total), 1.0
            arcs.append(here)
            ahead.append(total)
            scale.append(now)
        # back[i]: what follows i, times the sum up to i, over the whole: each piece's share is ahead * p * what follows
        back = [0.0] * n + [1.0 / ahead[n]]
        for i in range(n, 0, -1):
            for j, p in arcs[i]:
                share = p * back[i] * (math.exp(scale[j] - scale[i]) if scale[j] != scale[i] else 1.0)
                back[j] += share
                out[word[j:i]] += times * ahead[j] * share
    return out


def piece_counts(texts: list[str], pieces: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Expected counts of the pieces in a language's texts, after some rounds of expectation and maximisation."""
    words = Counter(w for text in texts for w in words_of(text))
    prob, got = {p: 1.0 / len(pieces) for p in pieces}, {}
    for _ in range(rounds if words else 0):
        got = expected(words, prob)
        total = sum(got.values()) + 1.0
        prob = {p: (got.get(p, 0.0) + 1.0 / len(pieces)) / total for p in pieces if p in got or len(p) == 1}
    return dict(got)


def counted(rows: DataFrame, path: str, rounds: int = ROUNDS) -> dict[str, dict[str, float]]:
    """Per language the counts of its pieces: a task for each language, whose texts have a bound."""

    def run(texts: pd.DataFrame) -> pd.DataFrame:
        got = piece_counts(sorted(texts["text"]), vocabulary(path), rounds)
        return pd.DataFrame({"lang": texts["lang"].iloc[0], "piece": list(got), "n": list(got.values())})

    out: dict[str, dict[str, float]] = defaultdict(dict)
    for r in rows.select("lang", "text").groupBy("lang").applyInPandas(run, "lang string, piece string, n double").collect():
        out[r["lang"]][r["piece"]] = r["n"]
    return dict(out)


def fit(counts: dict[str, dict[str, float]], share: dict[str, int], pieces: list[str], prior_count: float = 500.0) -> Model:
    """The model of the languages' piece counts; ``share``: how many documents of all have each language."""
    counts = {k: dict(sorted(counts[k].items())) for k in sorted(counts) if counts[k]}
    langs = list(counts)
    if not langs:
        return Model((), (), {})
    pooled: dict[str, float] = defaultdict(float)
    for got in counts.values():
        total = sum(got.values()) or 1.0
        for p, c in got.items():
            pooled[p] += c / total / len(langs)
    table = {}
    sums = {lang: sum(counts[lang].values()) + prior_count for lang in langs}
    for p in pieces:
        shared = prior_count * (0.9 * pooled.get(p, 0.0) + 0.1 / len(pieces))
        if p in pooled or len(p) == 1:
            table[p] = tuple((counts[lang].get(p, 0.0) + shared) / sums[lang] for lang in langs)
    total = sum(share.get(k, 0) for k in langs)
    return Model(tuple(langs), tuple(math.log((share.get(k, 0) + 1.0) / (total + len(langs))) for k in langs), table)


class Scorer:
    """Log-probabilities of distinct words and chunks, remembered; texts are sums of chunks.

    Pieces of two letters or more form a trie, as a table of states by letter.
    """

    def __init__(self, model: Model, cache_chunks: int = CACHE_CHUNKS, cache_chars: int = CACHE_CHARS):
        self.model, self.n = model, len(model.langs)
        self.number = {p: k for k, p in enumerate(model.pieces)}
        self.longest = max(map(len, model.pieces), default=1)
        self.prob = np.array([*model.pieces.values(), (UNKNOWN,) * self.n]).reshape(-1, max(1, self.n))
        unknown = len(self.prob) - 1
        long = [p for p in model.pieces if len(p) > 1]
        letters = sorted({c for p in long for c in p})
        self.code = np.zeros(0x110000, dtype=np.int32)  # letters of long pieces from 1, then other single pieces
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        others = [p for p in model.pieces if len(p) == 1 and not self.code[ord(p)]]
        self.code[[ord(c) for c in others]] = np.arange(len(letters) + 1, len(letters) + len(others) + 1)
        self.single = np.array([unknown, *(self.number.get(c, unknown) for c in (*letters, *others))])
        states = {p: k for k, p in enumerate(sorted({p[:k] for p in long for k in range(1, len(p) + 1)}), 1)}
        self.step = np.zeros((len(states) + 1, len(letters) + 1), dtype=np.int32)
        self.piece = np.full(len(states) + 1, -1, dtype=np.int64)
        for prefix, k in states.items():
            self.step[states.get(prefix[:-1], 0), self.code[ord(prefix[-1])]] = k
            if len(prefix) > 1:
                self.piece[k] = self.number.get(prefix, -1)
        self.words = Rows(self.forward, cache_chunks, cache_chars, self.n)
        self.chunks = Rows(self.learn, cache_chunks, cache_chars, self.n + 1)

    def word(self, word: str) -> np.ndarray:
        """One long word: the forward sum, rescaled as it goes."""
        window = [np.ones(self.n)]
        logs = np.zeros(self.n)
        for i in range(1, len(word) + 1):
            row = np.zeros(self.n)
            for j in range(max(0, i - self.longest), i):
                k = self.number.get(word[j:i])
                if k is None and i - j > 1:
                    continue
                row = row + window[j - i] * self.prob[-1 if k is None else k]
            window.append(row)
            if len(window) > self.longest:
                window.pop(0)
            if i % 16 == 0:
                scale = row.copy()
                logs += np.log(scale)
                window = [x / scale for x in window]
        return logs + np.log(window[-1])

    def forward(self, words: list[str]) -> np.ndarray:
        """Rows of log-probabilities: the sums over all segmentations, for all words step by step."""
        out = np.zeros((len(words), self.n))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for k in np.flatnonzero(sizes > SHORT).tolist():
            out[k] = self.word(words[k])
        short = np.flatnonzero(sizes <= SHORT)
        short = short[np.argsort(-sizes[short], kind="stable")]
        for s in range(0, len(short), 20_000):
            part = short[s : s + 20_000]
            out[part] = self._together([words[k] for k in part.tolist()], sizes[part])
        return out

    def _together(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Words of falling length: from each start the pieces are followed through the trie for all of them."""
        most = int(sizes[0])
        flat = self.code[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        grid = np.zeros((len(words), most), dtype=np.int32)
        grid[np.arange(most) < sizes[:, None]] = flat
        sums = np.zeros((most + 1, len(words), self.n))
        sums[0] = 1.0
        width = self.step.shape[1]
        for start in range(most):
            rows = np.arange(int((sizes > start).sum()))
            base, codes = sums[start], grid[rows, start]
            sums[start + 1, rows] += base[rows] * self.prob[self.single[codes]]
            state = self.step[0, np.where(codes < width, codes, 0)]
            rows, state = rows[state > 0], state[state > 0]
            at = start + 1
            while len(rows) and at < most:
                more = sizes[rows] > at
                rows, state = rows[more], state[more]
                codes = grid[rows, at]
                state = self.step[state, np.where(codes < width, codes, 0)]
                rows, state = rows[state > 0], state[state > 0]
                piece = self.piece[state]
                hit = piece >= 0
                sums[at + 1, rows[hit]] += base[rows[hit]] * self.prob[piece[hit]]
                at += 1
        return np.log(sums[sizes, np.arange(len(words))])

    def learn(self, chunks: list[str]) -> np.ndarray:
        """Rows of chunks: the sums of their words' logs, and how many words they have."""
        # all chunks in one pass, one to a line
        parts = _LINES.findall("\n".join(chunks).lower() + "\n")
        ends = np.fromiter((p == "\n" for p in parts), dtype=bool, count=len(parts))
        own = self.words.numbered([["▁" + p for p in parts if p != "\n"]])[0]
        sizes = np.diff(np.flatnonzero(ends), prepend=-1) - 1
        rows = np.zeros((len(chunks), self.n + 1))
        sums = np.concatenate([np.zeros((1, self.n)), np.cumsum(self.words.table[own], axis=0)])
        last = np.cumsum(sizes)
        rows[:, : self.n] = sums[last] - sums[last - sizes]
        rows[:, self.n] = sizes
        return rows

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.n:
            return [("und", 0.0)] * len(texts)
        priors, out = np.array(self.model.priors), []
        for chunks in self.chunks.numbered((t or "").split() for t in texts):
            sums = self.chunks.table[chunks].sum(axis=0)
            count = sums[-1]
            if count == 0:
                out.append(("und", 0.0))
                continue
            x = sums[:-1] * (SPAN / max(SPAN, count)) + priors
            best = int(x.argmax())
            out.append((self.model.langs[best], float(1.0 / np.exp(x - x[best]).sum())))
        return out


def sample(docs: DataFrame, held_out: int = 0, folds: int = 5, max_texts: int = MAX_TEXTS, shards: int = SHARDS, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, dict[str, int]]:
    """(lang, text) rows to learn from, never of the held-out fold, and each language's documents among all others.

    The first rows by hash of each language and shard; shards keep a common
    language from meeting in one task.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.where("lang is not null and text is not null and text <> ''").where(crc_mod("doc_id", folds) != held_out)
    named = own.withColumn("_h", F.xxhash64("doc_id")).withColumn("_shard", F.pmod("_h", F.lit(shards))).select("doc_id", "lang", "_h", "_shard").distinct()
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_shard").orderBy("_h", "doc_id"))).where(f"_n <= {max_texts}")
    share = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # at most max_texts * shards ids a language: the number of languages bounds the broadcast
    rows = sampled(own, first.select("doc_id", "lang", "_h"), ["lang"], max_bytes)
    return rows.select("lang", "text"), share


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = []
            texts = [x or "" for x in batch["text"]]
            for part in slices(texts, BATCH_CHARS):
                got += scorer.predict(texts[part])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    own = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return own.mapInPandas(run, "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def identify(docs: DataFrame, vocabulary_path: str, held_out: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    rows, share = sample(docs, held_out, folds)
    model = fit(counted(rows, vocabulary_path), share, vocabulary(vocabulary_path))
    out = predict(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")
