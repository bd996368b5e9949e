"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

The distinct words (matches of the pattern) that a task hasn't met yet are laid
out as one chain of symbols.  An inverted index leads from each token pair's rank
to the positions where it stands; the ranks are replayed in order over all words
at once, and a merge touches only the positions of its pair and their two
neighbours.  Texts are then spelled by the numbers of their words.

Edge cases: null and empty texts have no tokens; repeated rows give repeated
results, and columns other than doc_id and text are not read; an empty table gives
no rows; texts and words of any length take the same path, in memory that grows
with the longest text; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .spelling import Spellings, gathered, slices

#: Distinct words, and characters of them, that a task remembers between batches.
CACHE_WORDS, CACHE_CHARS = 300_000, 6_000_000
#: Characters of text that are split into words before their new words are replayed together.
BATCH_CHARS = 8_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The vocabulary as tables: ranks of byte pairs, and of all pairs of tokens whose union is a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=0) + 1
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        found = [(ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.keys, self.ranks = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
        left, right = np.divmod(self.keys, self.size)
        # tokens with a pair of a lower rank than their own: their merges can't be made all at once
        self.early = {int(t) for side in (left, right) for t in side[self.ranks < side]}
        pieces = [b""] * self.size
        for t, r in ranks.items():
            pieces[r] = t
        self.lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=self.size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's union, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1, dtype=np.int64)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def _apart(places: np.ndarray, after: np.ndarray, word: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted places of one pair those that can merge at once, and those that wait.

    Of overlapping pairs the left one merges and the right one is gone; with
    ``single`` only the first place of each word merges now.
    """
    if single:
        first = np.ones(len(places), dtype=bool)
        first[1:] = word[places[1:]] != word[places[:-1]]
        return places[first], places[~first]
    touch = after[places[:-1]] == places[1:]
    if touch.any():
        keep, on = np.ones(len(places), dtype=bool), True
        for k in np.flatnonzero(touch).tolist():  # k + 1 overlaps k
            on = keep[k]
            keep[k + 1] = not on
        places = places[keep]
    return places, places[:0]


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words, one after the other, and how many each has.

    Ranks come from a heap in rising order; words see their merges in the order
    of a word-by-word encoder, as a rank's places merge at once only where no pair
    of a lower rank can arise from it.
    """
    chain = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = len(chain)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    if not n:
        return np.zeros(0, dtype=np.uint32), lengths
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    token = merges.byte[chain]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = np.flatnonzero(np.r_[word[1:] != word[:-1], True])
    after[last] = -1
    before[last[:-1] + 1] = -1
    pair = np.full(n, -1, dtype=np.int64)  # rank of the pair that begins at each position
    begin = np.flatnonzero(after >= 0)
    table = merges.rank(np.repeat(merges.byte, 256), np.tile(merges.byte, 256))
    pair[begin] = table[chain[begin].astype(np.int64) * 256 + chain[begin + 1]]
    begin = begin[pair[begin] >= 0]
    begin = begin[np.argsort(pair[begin], kind="stable")]
    index: dict[int, list[int]] = {}
    if len(begin):
        ranks, cuts = np.unique(pair[begin], return_index=True)
        index = {int(r): p.tolist() for r, p in zip(ranks, np.split(begin, cuts[1:]), strict=True)}
    queue = list(index)
    heapify(queue)
    mark = np.zeros(n, dtype=bool)
    while queue:
        rank = heappop(queue)
        at = np.array(index.pop(rank), dtype=np.int64)
        at = at[pair[at] == rank]
        if not len(at):
            continue
        at.sort()
        if len(at) > 1:
            at, wait = _apart(at, after, word, rank in merges.early)
            if len(wait):
                index[rank] = wait.tolist()
                heappush(queue, rank)
        gone = after[at]
        follow = after[gone]
        token[at], token[gone], pair[gone], pair[at] = rank, -1, -1, -1
        after[at] = follow
        more = follow >= 0
        right = at[more]
        before[follow[more]] = right
        left = before[at]
        mark[at] = True
        left = left[left >= 0]
        left = left[~mark[left]]  # such a pair is a right side already
        mark[at] = False
        new = np.concatenate([left, right])
        if not len(new):
            continue
        found = merges.rank(token[new], token[after[new]])
        pair[new] = found
        some = found >= 0
        for p, r in zip(new[some].tolist(), found[some].tolist(), strict=True):
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heappush(queue, r)
    alive = token >= 0
    return token[alive].astype(np.uint32), np.bincount(word[alive], minlength=len(words))


class Codec:
    """Encoder and decoder over one vocabulary, with a bounded memory of words."""

    def __init__(self, path: str, pattern: str, cache_words: int = CACHE_WORDS, cache_chars: int = CACHE_CHARS):
        import regex

        self.merges = merges_of(path)
        self.split = regex.compile(pattern).findall
        self.words = Spellings(lambda fresh: replay([w.encode("utf-8") for w in fresh], self.merges), cache_words, cache_chars)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Per text its ids."""
        return self.words.spell(map(self.split, texts))

    def decode(self, ids: np.ndarray) -> bytes:
        own = self.merges
        return gathered(own.letters, own.starts[ids], own.lengths[ids]).tobytes()


@lru_cache(maxsize=1)
def merges_of(path: str) -> Merges:
    return Merges(load_ranks(path))


def encode_documents(docs: DataFrame, path: str, pattern: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """``doc_id``, ``ids`` (packed little-endian 32-bit) and ``decoded`` bytes of each text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path, pattern)
        for batch in batches:
            names, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for part in slices(texts, batch_chars):
                ids = own.encode(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [names[part], pa.array([x.astype("<u4", copy=False).tobytes() for x in ids], pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    out = encode_documents(docs, path, pattern)
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
