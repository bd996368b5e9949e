"""Packing along a space-filling curve.

A document's tokens are hashed to signs in a few dimensions and summed; the
scaled sums are quantised and numbered by a Hilbert curve.  Documents are
range-sorted by that number, and neighbours along the curve are packed into
sequences.  A partition's last, open sequence is cut into sequences of powers of
two, which need no padding.

Edge cases: a null text counts as empty (its document is the end id alone); equal
texts share a curve number and are ordered by id, and so are rows that repeat one;
texts of any length are encoded whole and cut freely; an empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, settle
from .spelling import Spellings, slices

SEQUENCE = 2048
END_ID = 1
DIMS, BITS = 3, 10
#: Distinct chunks (between white space), and characters of them, that a task remembers between batches.
CACHE_CHUNKS, CACHE_CHARS = 400_000, 8_000_000
#: Characters of text that are cut into chunks before their new chunks are encoded together.
BATCH_CHARS = 4_000_000
# What str.split() parts and the tokenizer's white space doesn't.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


# Fixed value: how the tokenizer of the vocabulary parts its normalised text.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this character lower-casing and composition are the same in Python and the tokenizer.
_LATIN_END = "\u0250"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of whole texts by a tokenizers file that drops white space.

    Tokens never span white space, so texts are cut there and each distinct chunk
    is encoded once; a text with one of the separators on which Python and the
    tokenizer differ, or with the beginning of an added token, is encoded in one piece.  Chunks of Latin letters are parted
    here and their distinct parts go to the tokenizer's model; others go through
    the whole tokenizer.  What is remembered is bounded in chunks and in characters.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS, cache_chars: int = CACHE_CHARS):
        import regex

        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        #: What all added tokens begin with; they are told from other text by the whole tokenizer.
        self.added = commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])[:2] or "\0"
        self.letters = byte_letters()
        self.split = regex.compile(_PARTS + r"|\n").findall
        self.chunks = Spellings(self._chunks, cache_chunks, cache_chars)
        self.parts = Spellings(self._parts, cache_chunks, cache_chars)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        counts = []
        tokenize, table, add = self.model.tokenize, self.letters, ids.extend
        for part in parts:
            if part == "\n":
                got = ()
            elif part.isascii() and part.isprintable():  # such letters stand for themselves
                got = tokenize(part)
            else:
                got = tokenize(part.encode("utf-8").decode("latin-1").translate(table))
            add([t.id for t in got])
            counts.append(len(got))
        return np.array(ids, dtype=np.uint32), np.array(counts, dtype=np.int64)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((c.isascii() or max(c) < _LATIN_END for c in chunks), dtype=bool, count=len(chunks))
        out = np.zeros(len(chunks), dtype=np.int64)
        # all chunks of Latin letters are parted in one pass, one to a line
        lines = "\n".join([c for c, p in zip(chunks, plain.tolist(), strict=True) if p])
        parts = self.split(lines.lower() + "\n") if plain.any() else []
        ids, sizes = self.parts.flat(parts)
        ends = np.fromiter((p == "\n" for p in parts), dtype=bool, count=len(parts))
        sums = np.cumsum(sizes)[ends]
        out[plain] = np.diff(sums, prepend=0)
        other = np.flatnonzero(~plain)
        if not len(other):
            return ids, out
        whole = self._whole([chunks[k] for k in other.tolist()])
        out[other] = [len(x) // 4 for x in whole]
        flat, starts = np.zeros(int(out.sum()), dtype=np.uint32), np.cumsum(out) - out
        latin = np.repeat(plain, out)
        flat[latin] = ids
        flat[~latin] = np.frombuffer(b"".join(whole), dtype="<u4")
        return flat, out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [self.added in t or any(c in t for c in _ODD_SPACE) for t in texts]
        out = self.chunks.spell(() if o else t.split() for t, o in zip(texts, odd, strict=True))
        return [np.frombuffer(self._whole([t])[0], dtype="<u4") if o else ids for t, o, ids in zip(texts, odd, out, strict=True)]


def signs(ids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """For each id and dimension a sign, by hashing."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return np.stack([((x >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.int64) * 2 - 1 for d in range(dims)], axis=1)


@lru_cache(maxsize=2)
def _sign_table(size: int, dims: int) -> np.ndarray:
    return signs(np.arange(size, dtype=np.uint32), dims).astype(np.int8)


def position(ids: np.ndarray, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Grid cell of a document: hashed vector of its distinct ids, projected, squashed."""
    distinct = np.unique(ids)
    if not len(distinct):
        return np.full(dims, 1 << (bits - 1), dtype=np.int64)
    table = _sign_table(1 << max(16, int(distinct[-1]).bit_length()), dims)
    flat = table[distinct].sum(axis=0, dtype=np.int64) / np.sqrt(len(distinct))
    share = 0.5 * (1 + np.tanh(0.8 * flat))  # close to the normal distribution function
    return np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers of grid cells (n x dims) along the Hilbert curve.

    Gray-code rotations from the highest bit down, then the axes' bits interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit = 1 << level
        low = bit - 1
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    fold = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fold = np.where(x[dims - 1] & (1 << level), fold ^ ((1 << level) - 1), fold)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | (((x[d] ^ fold) >> level) & 1)
    return key


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """doc_id, curve (Hilbert number), packed (compressed ids, the end id last)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, press = Encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            names, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for part in slices(texts, batch_chars):
                ids = own.encode(texts[part])
                curve = hilbert(np.stack([position(x) for x in ids]))
                packed = [press.compress(_halve(np.append(x, np.uint32(end_id)))) for x in ids]
                yield pa.RecordBatch.from_arrays([names[part], pa.array(curve), pa.array(packed, pa.binary())], names=["doc_id", "curve", "packed"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, curve long, packed binary")


def _halve(ids: np.ndarray) -> bytes:
    """Little-endian 32-bit ids as their low halves followed by their high halves, which pack better."""
    return ids.astype("<u4", copy=False).view("<u2").reshape(-1, 2).T.tobytes()


def _whole(halves: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(halves, dtype="<u2").reshape(2, -1).T.tobytes(), dtype="<u4")


def cut(lengths: list[int], sequence: int = SEQUENCE) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence number, offset) of pieces of documents in order.

    Sequences fill up one after the other; what is left at the end is cut into
    sequences of falling powers of two.
    """
    total = sum(lengths)
    full, rest = divmod(total, sequence)
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    number, offset = 0, 0
    room = sequence if full else (sizes[0] if sizes else 0)
    for d, n in enumerate(lengths):
        start = 0
        while start < n:
            take = min(n - start, room - offset)
            yield d, start, take, number, offset
            start, offset = start + take, offset + take
            if offset == room:
                number, offset = number + 1, 0
                room = sequence if number < full else (sizes[number - full] if number - full < len(sizes) else 0)


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row a piece: where it stands in its document and in its sequence, and its ids' CRC."""
    tokens = settle(tokenize(docs, path), "tokens")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        unpack = zstandard.ZstdDecompressor().decompress
        open_: list[tuple] = []  # documents, or their rests, that are not packed yet: id, start, ids, all ids
        used = held = 0

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal open_, used
            whole, lengths = open_, [len(x[2]) for x in open_]
            open_ = []
            surplus = 0 if last else sum(lengths) % sequence  # only whole sequences now
            k = len(whole)
            while surplus:
                k -= 1
                doc, start, ids, n = whole[k]
                keep = max(0, len(ids) - surplus)
                open_.append((doc, start + keep, ids[keep:], n))
                surplus -= len(ids) - keep
                lengths[k] = keep
            open_.reverse()
            pieces = list(cut(lengths, sequence))
            names, starts, sizes, sums, totals = [], [], [], [], []
            for d, start, take, _, _ in pieces:
                doc, at, ids, n = whole[d]
                names.append(doc)
                starts.append(at + start)
                sizes.append(take)
                sums.append(zlib.crc32(ids[start : start + take]))
                totals.append(n)
            numbers = [base + used + x[3] for x in pieces]
            used += pieces[-1][3] + 1 if pieces else 0
            columns = [names, starts, sizes, sums, totals, numbers, [x[4] for x in pieces]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_PIECE)

        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = _whole(unpack(packed.as_buffer()))
                open_.append((doc, 0, ids, len(ids)))
                held += len(ids)
                if held > 4_000_000:
                    held = 0
                    yield emit(False)
        if open_:
            yield emit(True)

    n = partitions(tokens.sparkSession)
    ordered = tokens.repartitionByRange(n, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return ordered.select("doc_id", "packed").mapInArrow(run, ", ".join(f"{c} long" for c in _PIECE))
