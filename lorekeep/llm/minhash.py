"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. Each text becomes its set of word shingles; texts with equal sets form a class
   and only the class's first document goes on (copies never meet pair by pair).
2. Several sorted signature orders (trees): range-sorted rows of a tree, its next
   signature values, a packed sketch and the id.  Rows of one region (the same
   first values) are candidates; crowded regions go deeper, one value at a time,
   and keep their prefix neighbours and links to their most typical member.
3. Candidates whose sketches agree enough are confirmed on the full shingle sets.
   Within a region, pairs that the sketches make certain are only emitted where
   they join parts not yet joined, so a group of near copies gives about as many
   pairs as members, not all pairs.
4. Confirmed links are contracted to components.
5. The remainder: in each region of several components, crowded or not, rows
   outside the largest are compared with all rows of other components, block by
   block, and what the signatures don't exclude is confirmed as well: first each
   row's most similar partner; then, over the new components, every pair that is
   left, by the full sets, which go to the tasks of the rows concerned, so that no
   rows are made for pairs that aren't links.  Components come from confirmed links
   alone: no pair stays untested because of one that only seemed certain.
6. All confirmed links together give the components.

Range sorting splits hot regions over tasks; a pair that a boundary separates in
one tree meets in the others.

Edge cases: a null, empty or blank text has an empty set and is linked with
nothing; a null id is linked with nothing and kept; rows repeated with the same id
give a result each, by their own texts; an empty table gives an empty result; a
very long text is one row's work, and its set goes whole into the confirmation;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, settle
from .components import components

TREES, DEPTH, MIN_DEPTH = 16, 8, 4
SLOTS = TREES * DEPTH
CROWD, BLOCK = 64, 512
#: How far the sketch's estimate may lie below the threshold, and how far above it a pair is certain.
SLACK, SURE = 0.15, 0.06
#: Distinct words that a task remembers, and the bytes of the longest.
CACHE_WORDS, CACHE_LONGEST = 300_000, 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_LONGEST:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: str | None, size: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased, words are split on \\x20 and \\x09-\\x0D; a text of fewer
    words than ``size`` is one shingle of all of them.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    size = min(size, len(parts))
    out = np.full(len(h) - size + 1, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _seeds() -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The 16 high bits of each slot's minimum."""
    low = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(low, (shingles[i : i + 512, None] * seeds[None, :]).min(axis=0), out=low)
    # mixed again: the minima themselves crowd near zero
    x = low * _MIX
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(16)).astype(np.uint16)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key, sig: one row a document."""

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seeds = Words(), _seeds()
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch["text"]:
                s = shingle_set(text, size, words)
                n.append(len(s))
                keys.append(set_key(s))
                sigs.append(signature(s, seeds).astype(">u2").tobytes() if len(s) else b"")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": n, "set_key": keys, "sig": sigs})

    own = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    out = own.mapInPandas(run, "doc_id string, n_shingles long, set_key binary, sig binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def forest(first: DataFrame) -> DataFrame:
    """tree, prefix, sketch, node: a row for each class and tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sigs = np.stack([np.frombuffer(x, dtype=">u2") for x in batch["sig"]])
            two = (sigs & 3).astype(np.uint8).reshape(len(sigs), SLOTS // 4, 4)
            sketch = two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6
            packed = [x.tobytes() for x in sketch]
            for t in range(TREES):
                part = np.ascontiguousarray(sigs[:, t * DEPTH : (t + 1) * DEPTH])
                yield pd.DataFrame({"tree": np.int32(t), "prefix": [x.tobytes() for x in part], "sketch": packed, "node": batch["node"]})

    return first.select("node", "sig").mapInPandas(run, "tree int, prefix binary, sketch binary, node long")


def region_pairs(ids: np.ndarray, prefix: np.ndarray, lanes: np.ndarray, low: float, sure: float) -> list[tuple[int, int]]:
    """Candidate pairs of one region: rows with the same tree and first values, in sorted order."""
    n = len(ids)
    if n < 2:
        return []
    close: list[tuple[np.ndarray, np.ndarray, bool]] = []  # left rows, right rows, whether unsure pairs count

    def split(a: int, b: int, depth: int) -> None:
        if b - a < 2:
            return
        if b - a <= CROWD:
            i, j = np.triu_indices(b - a, 1)
            close.append((i + a, j + a, True))
            return
        if depth >= DEPTH:
            for s in range(a, b, CROWD // 2):
                i, j = np.triu_indices(min(CROWD, b - s), 1)
                close.append((i + s, j + s, False))
            return
        edges = np.flatnonzero(prefix[a + 1 : b, depth] != prefix[a : b - 1, depth]) + a + 1
        bounds = [a, *edges.tolist(), b]
        for x, y in zip(bounds, bounds[1:], strict=False):
            split(x, y, depth + 1)

    if n <= CROWD:
        split(0, n, MIN_DEPTH)
    else:
        split(0, n, MIN_DEPTH)
        for step in (1, 2):
            close.append((np.arange(n - step), np.arange(step, n), True))
        # the most typical member: the one that agrees most with each slot's commonest value
        counts = np.stack([(lanes == v).sum(axis=0) for v in range(4)])
        hub = int((lanes == counts.argmax(axis=0)[None, :]).sum(axis=1).argmax())
        others = np.delete(np.arange(n), hub)
        close.append((np.full(n - 1, hub), others, True))
    found_i, found_j, found_e, found_u = [], [], [], []
    for i, j, unsure in close:
        for s in range(0, len(i), 4096):
            a, b = i[s : s + 4096], j[s : s + 4096]
            same = (lanes[a] == lanes[b]).mean(axis=1)
            est = (same - 0.25) / 0.75
            ok = est >= (low if unsure else sure)
            if ok.any():
                found_i.append(a[ok])
                found_j.append(b[ok])
                found_e.append(est[ok])
    if not found_i:
        return []
    i, j, e = np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_e)
    order = np.lexsort((ids[j], ids[i], -e))
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k in order.tolist():
        a, b = int(i[k]), int(j[k])
        ra, rb = root(a), root(b)
        if ra != rb:
            out.append((int(ids[a]), int(ids[b])))
            if e[k] >= sure:
                up[ra] = rb
    return out


def candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """Distinct candidate pairs (a < b) from the sorted orders."""
    low, sure = threshold - SLACK, min(0.97, threshold + SURE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                now = (
                    batch["tree"].to_numpy(dtype=np.int32),
                    np.frombuffer(b"".join(batch["prefix"]), dtype=">u2").reshape(-1, DEPTH),
                    np.frombuffer(b"".join(batch["sketch"]), dtype=np.uint8).reshape(-1, SLOTS // 4),
                    batch["node"].to_numpy(dtype=np.int64),
                )
                rest = now if rest is None else tuple(np.concatenate([a, b]) for a, b in zip(rest, now, strict=True))
            if rest is None or not len(rest[0]):
                continue
            tree, prefix, sketch, ids = rest
            change = (tree[1:] != tree[:-1]) | (prefix[1:, :MIN_DEPTH] != prefix[:-1, :MIN_DEPTH]).any(axis=1)
            bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [len(tree)]])
            last = len(bounds) - 1 if batch is None else len(bounds) - 2  # the last region may go on
            pairs = []
            sizes = np.diff(bounds)
            for r in np.flatnonzero(sizes[:last] > 1):
                a, b = int(bounds[r]), int(bounds[r + 1])
                packed = sketch[a:b]
                lanes = np.stack([packed & 3, packed >> 2 & 3, packed >> 4 & 3, packed >> 6], axis=2).reshape(b - a, SLOTS)
                pairs += region_pairs(ids[a:b], prefix[a:b], lanes, low, sure)
            cut = int(bounds[last])
            rest = tuple(x[cut:] for x in rest)
            if pairs:
                p = np.array(pairs, dtype=np.int64)
                p = np.unique(np.sort(p, axis=1), axis=0)
                yield pd.DataFrame({"a": p[:, 0], "b": p[:, 1]})

    n = partitions(rows.sparkSession)
    ordered = rows.repartitionByRange(n, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    return ordered.mapInPandas(run, "a long, b long").where("a <> b").distinct()


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def heads(first: DataFrame, groups: DataFrame) -> DataFrame:
    """tree, head, node, comp: the region and the component of each class in each tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sigs = np.stack([np.frombuffer(x, dtype=">u2") for x in batch["sig"]])
            for t in range(TREES):
                head = np.ascontiguousarray(sigs[:, t * DEPTH : t * DEPTH + MIN_DEPTH]).view(np.int64).ravel()
                yield pd.DataFrame({"tree": np.int32(t), "head": head, "node": batch["node"], "comp": batch["comp"]})

    own = first.select("node", "sig").join(groups, "node", "left")
    own = own.select("node", "sig", F.coalesce("component", "node").alias("comp"))
    return own.mapInPandas(run, "tree int, head long, node long, comp long")


def _split(batches: Iterator[pd.DataFrame], parse: Callable[[pd.DataFrame], tuple]) -> Iterator[tuple]:
    """The parsed columns of each task's rows; rows come sorted by task, whose mark is the first column."""
    rest = None
    for batch in _with_end(batches):
        if batch is not None:
            now = parse(batch)
            rest = now if rest is None else tuple(np.concatenate([a, b]) for a, b in zip(rest, now, strict=True))
        if rest is None or not len(rest[0]):
            continue
        mark = rest[0]
        bounds = np.concatenate([[0], np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1, [len(mark)]])
        last = len(bounds) - 1 if batch is None else len(bounds) - 2  # the last task may go on
        for a, b in zip(bounds[:last].tolist(), bounds[1 : last + 1].tolist(), strict=True):
            yield tuple(x[a:b] for x in rest)
        rest = tuple(x[int(bounds[last]) :] for x in rest)


def open_pairs(tree: int, nodes: np.ndarray, comp: np.ndarray, minor: np.ndarray, left: np.ndarray, sigs: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left row, right row and estimate of the pairs of two components that their signatures don't exclude.

    A pair belongs to the first tree where both are of one region.
    """
    i, j = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(i) or not len(j):
        return i[:0], j[:0], np.zeros(0)
    est = np.stack([(sigs[j] == sigs[x]).mean(axis=1) for x in i])
    # two rows outside the largest component meet on both sides: one of them counts
    ok = (est >= low) & (comp[i][:, None] != comp[j][None, :]) & (~minor[j][None, :] | (nodes[i][:, None] < nodes[j][None, :]))
    a, b = np.nonzero(ok)
    head = np.ascontiguousarray(sigs.reshape(len(sigs), TREES, DEPTH)[:, :tree, :MIN_DEPTH]).view(np.int64)[:, :, 0]
    mine = np.ones(len(a), dtype=bool)
    for s in range(0, len(a), 50_000):
        mine[s : s + 50_000] = ~(head[i[a[s : s + 50_000]]] == head[j[b[s : s + 50_000]]]).any(axis=1)
    a, b = a[mine], b[mine]
    return i[a], j[b], est[a, b]


def _columns_of(batch: pd.DataFrame) -> tuple:
    return (
        batch[["tree", "head", "i", "j"]].to_numpy(dtype=np.int64),
        np.frombuffer(b"".join(batch["sig"]), dtype=np.uint16).reshape(-1, SLOTS),
        *(batch[c].to_numpy(dtype=t) for c, t in (("node", np.int64), ("comp", np.int64), ("minor", bool), ("left", bool))),
    )


_TASK = ["tree", "head", "i", "j"]


def seats(first: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of the regions of several components, at their block tasks.

    Rows outside the largest component (``minor``) are the left side, all rows the
    right side: pairs within the largest need no test.
    """
    region = ["tree", "head"]
    rows = heads(first, groups)
    mixed = rows.groupBy(*region).agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    members = settle(rows.join(mixed.select(*region), region), "members")
    parts = members.groupBy(*region, "comp").agg(F.count("*").alias("c"))
    regions = parts.groupBy(*region).agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("top"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    regions = regions.select(*region, F.col("top.comp").alias("top"), blocks(F.col("n") - F.col("top.c")).alias("lefts"), blocks(F.col("n")).alias("rights"))
    placed = members.join(regions, region).withColumn("minor", F.col("comp") != F.col("top"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = [*region, "node", "comp", "minor"]
    lefts = placed.where("minor").select(*fields, F.lit(True).alias("left"), own("lefts").alias("i"), every("rights").alias("j"))
    rights = placed.select(*fields, F.lit(False).alias("left"), every("lefts").alias("i"), own("rights").alias("j"))
    return lefts.unionAll(rights)


def _by_task(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), *_TASK).sortWithinPartitions(*_TASK)


def best_partners(first: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a < b) of nodes: each left row of a task and its most similar partner there."""
    low = threshold - SLACK

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for mark, sigs, nodes, comp, minor, left in _split(batches, _columns_of):
            i, j, est = open_pairs(int(mark[0, 0]), nodes, comp, minor, left, sigs, low)
            if len(i):
                order = np.lexsort((nodes[j], -est, i))
                i, j = i[order], j[order]
                one = np.r_[True, i[1:] != i[:-1]]
                p = np.sort(np.stack([nodes[i[one]], nodes[j[one]]], axis=1), axis=1)
                yield pd.DataFrame({"a": p[:, 0], "b": p[:, 1]})

    rows = seats(first, groups).join(first.select("node", "sig"), "node")
    return _by_task(rows).mapInPandas(compare, "a long, b long").distinct()


def remainder(docs: DataFrame, first: DataFrame, groups: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components, from all pairs that the signatures don't exclude.

    A first pass names the rows of each task that have such a pair; their full sets
    go to the task, which compares them there.  Of the links that join the same two
    components in a task one is returned.
    """
    low = percent / 100 - SLACK

    @released
    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for mark, sigs, nodes, comp, minor, left in _split(batches, _columns_of):
            i, j, _ = open_pairs(int(mark[0, 0]), nodes, comp, minor, left, sigs, low)
            if len(i):
                r = np.unique(np.concatenate([i, j]))
                yield pd.DataFrame({c: mark[r, k] for k, c in enumerate(_TASK)} | {"node": nodes[r], "comp": comp[r], "minor": minor[r], "left": left[r]})

    task = "tree int, head long, i int, j int, node long, comp long, minor boolean, left boolean"
    rows = seats(first, groups).join(first.select("node", "sig"), "node")
    named = settle(_by_task(rows).mapInPandas(name, task), "named")
    if named.isEmpty():
        return named.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    sets = full_sets(docs, first, named.select("node").distinct(), size)

    def parse(batch: pd.DataFrame) -> tuple:
        own = np.empty(len(batch), dtype=object)
        own[:] = [np.sort(_wide(np.frombuffer(x, dtype="V6"))) for x in batch["shingles"]]
        return (*_columns_of(batch), own)

    @released
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for mark, sigs, nodes, comp, minor, left, own in _split(batches, parse):
            i, j, est = open_pairs(int(mark[0, 0]), nodes, comp, minor, left, sigs, low)
            order = np.argsort(i, kind="stable")
            i, j, est = i[order], j[order], est[order]
            joined: set[tuple[int, int]] = set()
            out = []
            for x in np.unique(i).tolist():
                a, b = np.searchsorted(i, [x, x + 1])
                partners = j[a:b][np.argsort(-est[a:b], kind="stable")]
                for s in range(0, len(partners), 64):
                    now = np.array([y for y in partners[s : s + 64].tolist() if (comp[x], comp[y]) not in joined], dtype=np.int64)
                    if not len(now):
                        continue
                    sizes = np.array([len(own[y]) for y in now.tolist()])
                    flat = np.concatenate([own[y] for y in now.tolist()])
                    at = np.minimum(np.searchsorted(own[x], flat), len(own[x]) - 1)
                    both = np.add.reduceat((own[x][at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                    for y in now[100 * both >= percent * (len(own[x]) + sizes - both)].tolist():
                        if (comp[x], comp[y]) not in joined:
                            joined.add((comp[x], comp[y]))
                            out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    seated = named.join(first.select("node", "sig"), "node").join(sets, "node")
    return _by_task(seated).mapInPandas(verify, "a long, b long").distinct()


def full_sets(docs: DataFrame, first: DataFrame, need: DataFrame, size: int, merge: bool = False) -> DataFrame:
    """node, shingles (six bytes each, packed) of the nodes asked for.

    A node's text is the one of its document whose set has the node's key, as ids
    may repeat with other texts.
    """
    need = first.select("node", "low", F.col("set_key").alias("want")).join(need, "node", "left_semi")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("low"), F.col("text").cast("string").alias("text"))

    @released
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            nodes, out = [], []
            for node, want, text in zip(batch["node"], batch["want"], batch["text"], strict=True):
                s = shingle_set(text, size, words)
                if set_key(s) == bytes(want):
                    nodes.append(node)
                    out.append(np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes())  # six bytes tell two sets' members apart
            yield pd.DataFrame({"node": np.array(nodes, dtype=np.int64), "shingles": out})

    # a merge join at every size: what the stage shuffles then follows the input; a remainder is small as a rule
    wanted = texts.join(need.hint("merge") if merge else need, "low").select("node", "want", "text")
    return settle(wanted.mapInPandas(sets, "node long, shingles binary").dropDuplicates(["node"]), "sets")


def confirmed(docs: DataFrame, first: DataFrame, pairs: DataFrame, size: int, percent: int, merge: bool = True) -> DataFrame:
    """The pairs of nodes whose full sets have 100 * intersection >= percent * union."""
    need = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    full = full_sets(docs, first, need, size, merge)

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = (np.frombuffer(z, dtype="V6") for z in (p, q))
            both = len(np.intersect1d(_wide(p), _wide(q), assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype="bool")

    left = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(full.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.where(linked("x", "y")).select("a", "b")


def _wide(six: np.ndarray) -> np.ndarray:
    out = np.zeros((len(six), 8), dtype=np.uint8)
    out[:, :6] = six.view(np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _nodes(some: DataFrame) -> DataFrame:
    """set_key, low (its smallest id), node: a number for each class of equal sets.

    It is ``low``, unless a repeated id is the lowest of several classes: then the
    smallest key's class has it, and the others' numbers are hashes.
    """
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("low"))
    lead = classes.groupBy("low").agg(F.min("set_key").alias("lead"))
    node = F.when(F.col("set_key") == F.col("lead"), F.col("low")).otherwise(F.xxhash64("set_key"))
    return classes.join(lead, "low").select("set_key", "low", node.alias("node"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    docs = docs.select("doc_id", "text")
    sigs = settle(signatures(docs, size), "signatures")
    some = sigs.where("n_shingles > 0 and doc_id is not null")
    nodes = settle(_nodes(some), "nodes")
    first = some.join(nodes, "set_key").where("doc_id = low").select("node", "low", "set_key", "sig").dropDuplicates(["node"])
    first = settle(first, "first")
    pairs = settle(candidates(settle(forest(first), "forest"), percent / 100), "pairs")
    links = settle(confirmed(docs, first, pairs, size, percent), "links")
    groups = components(links)
    again = lambda found: components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(found))
    likely = settle(best_partners(first, groups, percent / 100).join(pairs, ["a", "b"], "left_anti"), "likely")
    if not likely.isEmpty():
        found = settle(confirmed(docs, first, likely, size, percent, merge=False), "links")
        groups = groups if found.isEmpty() else again(found)
    rest = settle(remainder(docs, first, groups, size, percent), "remainder")
    groups = groups if rest.isEmpty() else again(rest)
    linked = nodes.join(groups, "node").select("set_key", "low", "component")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = linked.join(lowest, "component").select("set_key", "component_id")
    named = nodes.join(linked, "set_key", "left").select("set_key", F.coalesce("component_id", "low").alias("component_id"))
    whole = sigs.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    whole = whole.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = whole.unionAll(sigs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
