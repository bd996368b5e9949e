"""BPE encoding by batched merge rounds over flat arrays, and decoding.

The symbols of all words that a batch of texts brings anew stand in one flat array.
In each round the ranks of adjacent pairs are found by binary search over the sorted
pair keys, every word takes its own lowest rank, and all places of that pair are
merged at once; of overlapping places every second one, counted from the left.  Words
without a pair of the vocabulary leave the array.  Where a merge's product stands
in a pair of a lower rank than the merge itself, only the word's first place merges
in a round, so that the order of a word-by-word encoder is kept for any vocabulary.

Added tokens that stand in a text are told apart first, at the leftmost place and
the longest there, and have their own ids, as in the public library.  Code points
that are letters or numbers for the pattern's engine only, as its tables are newer,
send a text through the library's own splitting.

Edge cases: null and empty texts have no tokens; repeated rows give repeated results,
and columns other than doc_id and text are not read; an empty table gives no rows;
texts and words of any length take the same path, in memory that grows with the
longest text; a word takes at most as many rounds as it has distinct ranks to merge.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain as joined

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .spelling import Spellings, gathered, slices

#: Distinct words, and characters of them, that a task remembers between batches.
CACHE_WORDS, CACHE_CHARS = 300_000, 6_000_000
#: Characters of text whose new words are merged together.
BATCH_CHARS = 8_000_000
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """A tokenizer file as arrays: sorted pair keys with rank and product, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, before = data["model"], data["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if data["normalizer"] or odd or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("not a plain byte-level BPE file")
        ids: dict[str, int] = model["vocab"]
        added = data["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.size = max([*ids.values(), *self.added.values()], default=0) + 1
        letters = byte_letters()
        if missing := [b for b in range(256) if letters[b] not in ids]:
            raise ValueError(f"no token for the bytes {missing}")
        self.byte = np.array([ids[x] for x in letters], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        lowest = np.full(self.size, NONE)  # the lowest rank of a pair in which each token stands
        for side in np.divmod(keys, self.size) if len(keys) else ():
            np.minimum.at(lowest, side, np.arange(len(keys)))
        self.early = lowest[made] < np.arange(len(keys))
        own = dict(zip(letters, range(256), strict=True))
        pieces = [b""] * self.size
        for text, n in ids.items():
            pieces[n] = bytes(own[x] for x in text)
        for text, n in self.added.items():
            pieces[n] = bytes(own[x] for x in text) if all(x in own for x in text) else text.encode()
        self.lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=self.size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_rounds(words: list[bytes], own: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words, one after the other, and how many each has."""
    flat = own.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    home = np.cumsum(counts) - counts  # where each word's ids are put down
    out = np.zeros(len(flat), dtype=np.uint32)
    word = np.repeat(np.arange(len(words)), counts)
    rank = np.full(len(flat), NONE)
    if len(flat) > 1:
        rank[:-1] = np.where(word[1:] == word[:-1], own.rank(flat[:-1], flat[1:]), NONE)
    while len(flat):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[first, len(flat)])
        lowest = np.minimum.reduceat(rank, first)
        if (lowest == NONE).any():  # these words are done
            done = np.repeat(lowest == NONE, sizes)
            which = word[first][lowest == NONE]
            counts[which] = sizes[lowest == NONE]
            out[np.repeat(home[which], counts[which]) + _within(counts[which])] = flat[done]
            flat, word, rank = flat[~done], word[~done], rank[~done]
            first, lowest = _firsts(sizes[lowest != NONE]), lowest[lowest != NONE]
            if not len(flat):
                break
            sizes = np.diff(np.r_[first, len(flat)])
        low = np.repeat(lowest, sizes)
        at = np.flatnonzero(rank == low)
        at = _apart(at, word, own.early[low[at]])
        flat[at] = own.made[low[at]]
        keep = np.ones(len(flat), dtype=bool)
        keep[at + 1] = False
        seat = np.cumsum(keep) - 1
        flat, word, rank = flat[keep], word[keep], rank[keep]
        at = seat[at]
        new = np.unique(np.concatenate([at, at[at > 0] - 1]))  # the pairs that begin at a product or end there
        rank[new] = NONE
        new = new[new + 1 < len(flat)]
        new = new[word[new] == word[new + 1]]
        rank[new] = own.rank(flat[new], flat[new + 1])
    own_places = np.repeat(home, counts) + _within(counts)
    return out[own_places], counts


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of so many."""
    return np.arange(int(sizes.sum())) - np.repeat(_firsts(sizes), sizes)


def _apart(at: np.ndarray, word: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Of sorted places of pairs those that merge now: no two that overlap, and one a word where ``single``."""
    chain = np.r_[False, at[1:] == at[:-1] + 1]
    chain[1:] &= word[at[1:]] == word[at[:-1]]
    begin = np.maximum.accumulate(np.where(chain, 0, np.arange(len(at))))
    good = (np.arange(len(at)) - begin) % 2 == 0
    opening = np.r_[True, word[at[1:]] != word[at[:-1]]]
    return at[good & (opening | ~single)]


class Codec:
    """Encoder and decoder over one tokenizer file, with a bounded memory of words."""

    def __init__(self, path: str, pattern: str, cache_words: int = CACHE_WORDS, cache_chars: int = CACHE_CHARS):
        import regex

        self.path, self.own = path, vocabulary(path)
        self.find = regex.compile(pattern).findall
        self.newer = _newer()
        added = sorted(self.own.added, key=len, reverse=True)
        self.parts = regex.compile(f"({'|'.join(map(regex.escape, added))})").split if added else None
        self.words = Spellings(self._learn, cache_words, cache_chars)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = [self.own.added.get(w) for w in words]
        ids, counts = merge_rounds([b"" if s is not None else w.encode("utf-8") for w, s in zip(words, special, strict=True)], self.own)
        where = np.array([k for k, s in enumerate(special) if s is not None], dtype=np.int64)
        if len(where):
            ids = np.insert(ids, (np.cumsum(counts) - counts)[where], np.array([s for s in special if s is not None], dtype=np.uint32))
            counts[where] = 1
        return ids, counts

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not self.newer(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in _library(self.path).pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """The words of a text, and its added tokens as words of their own."""
        if self.parts is None or not any(t in text for t in self.own.added):
            return self._words(text)
        return list(joined.from_iterable([x] if k % 2 else self._words(x) for k, x in enumerate(self.parts(text)) if x))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Per text its ids."""
        return self.words.spell(map(self.split, texts))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8; what isn't UTF-8 is replaced."""
        own = self.own
        out = gathered(own.bytes, own.starts[ids], own.lengths[ids]).tobytes()
        return out.decode("utf-8", "replace").encode("utf-8")


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer


@lru_cache(maxsize=1)
def _newer():
    """A search for code points that the pattern's engine takes for letters or numbers, unknown to older tables."""
    import regex

    unknown = "".join(c for c in map(chr, joined(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn")
    points = [ord(c) for c in regex.sub(r"[^\p{L}\p{N}]+", "", unknown)]
    ranges, k = [], 0
    while k < len(points):
        end = k
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        ranges.append(f"\\U{points[k]:08x}-\\U{points[end]:08x}")
        k = end + 1
    return regex.compile(f"[{''.join(ranges)}]").search if ranges else lambda text: None


def encode_documents(docs: DataFrame, path: str, pattern: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """``doc_id``, ``ids`` (packed little-endian 32-bit) and ``decoded`` bytes of each text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path, pattern)
        for batch in batches:
            names, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for part in slices(texts, batch_chars):
                ids = own.encode(texts[part])
                packed = pa.array([x.astype("<u4", copy=False).tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([names[part], packed, pa.array([own.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    out = encode_documents(docs, path, pattern)
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
