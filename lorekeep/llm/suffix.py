"""Removal of repeated passages by suffix arrays in a logarithmic index family.

A byte is removed where a string of ``LENGTH`` bytes that covers it also starts
anywhere else, in the same document or another.

1. Anchors.  In each window of LENGTH bytes the place with the smallest hash of
   CORE bytes is an anchor; equal windows choose equal anchors, so suffixes need
   indexing at anchors only, about one byte in eighty.
2. Anchors travel packed, by core, and those whose core occurs once are dropped.
   Of anchors with equal contexts (a form) two go on, whose bytes are compared;
   what is found for them holds for the whole form.
3. The contexts are dealt by core to index families.  Each new batch gets a sorted
   suffix array and is merge-scanned against the levels of its family: in the
   joint order, common prefixes of neighbours bound the matches to the right of
   the anchor, and the bytes before it tell how far they reach to the left.  Levels
   of equal size merge, so that sizes grow geometrically.
4. A core with a crowd of contexts is split: either half of its windows has a
   longer core of its own, down to single windows if need be, so that no group
   outgrows a task and every window is judged.

What is collected into one row (anchors wanted, ranges found) belongs to one text
and is bounded by its length.

Edge cases: a null text counts as empty; documents shorter than LENGTH keep all
bytes; repeated rows are copies of one another and lose all their bytes when long
enough; an empty table gives no rows; ids may be null or repeat, as documents are
told apart by their text's digest; columns other than those asked for are not
read; a very long text is one task's work, in memory that grows with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, settle, text_or_empty

LENGTH = 200
CORE = 48
SPAN = LENGTH - CORE  # a window starts at most so far before its anchor
WIDTH = SPAN + LENGTH  # a context: all windows around an anchor
CROWD = 20_000  # contexts of one core that a family takes
HOT = 16  # forms of one core among FLUSH anchors
FLUSH = 500_000
FAMILY = 40_000  # contexts of a family, about
SMALL = 6  # cores of so many contexts are compared pair by pair
BATCH = 5_000  # contexts that get a suffix array at a time
BUCKET = 16 << 20  # bytes of text to a bucket of anchors
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)


class Powers:
    """Powers of the hash base modulo 2**64, and their inverses."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            back = pow(_BASE, -1, 1 << 64)
            for name, step in (("up", _BASE), ("down", back)):
                x = np.full(n, np.uint64(step), dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


def _slide(x: np.ndarray, w: int, best, fill) -> np.ndarray:
    """The best of each w neighbours: block-wise running bests from both sides."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, fill, dtype=x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    ahead = best.accumulate(grid, axis=1).ravel()
    back = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Positions and core hashes of the anchors of a text of at least LENGTH bytes."""
    n = len(data)
    powers.reach(n)
    t = _TABLE[np.frombuffer(data, dtype=np.uint8)]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(t * powers.up[:n], out=sums[1:])
    h = (sums[CORE:] - sums[:-CORE]) * powers.down[: n - CORE + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    least = _slide(h, SPAN + 1, np.minimum, np.uint64(2**64 - 1))
    padded = np.zeros(len(least) + 2 * SPAN, dtype=np.uint64)
    padded[SPAN : SPAN + len(least)] = least
    at = np.flatnonzero(_slide(padded, SPAN + 1, np.maximum, np.uint64(0)) == h)
    return at, h[at]


def _hash(data: bytes, salt: int = 0) -> int:
    import xxhash

    x = xxhash.xxh3_64_intdigest(data, seed=salt)
    return x - (1 << 64) if x >> 63 else x


class Family:
    """Suffix arrays over anchor contexts, in levels of geometrically growing size.

    A context is WIDTH bytes with the anchor at SPAN; ``left`` and ``right`` say
    how many of them exist.  ``first`` and ``last`` bound the windows (by their
    distance before the anchor) that a context asks about.  ``cover`` tells for
    each context (by ``tag``) which of its windows occur elsewhere.
    """

    def __init__(self, small: int = SMALL):
        self.small = small
        self.levels: list[dict[str, np.ndarray]] = []
        self.cover = np.zeros((0, SPAN + 1), dtype=bool)

    @staticmethod
    def _sorted(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        suffix = np.ascontiguousarray(rows["context"][:, SPAN:]).view(f"S{LENGTH}").ravel()
        order = np.lexsort((suffix, rows["core"]))
        return {k: v[order] for k, v in rows.items()}

    def add(self, batch: dict[str, np.ndarray]) -> None:
        batch = batch | {"tag": np.arange(len(batch["core"])) + len(self.cover)}
        self.cover = np.concatenate([self.cover, np.zeros((len(batch["core"]), SPAN + 1), dtype=bool)])
        new = self._sorted(batch)
        self._scan(new)
        for level in self.levels:  # merge-scan of the cores that both have
            i, j = np.isin(new["core"], level["core"]), np.isin(level["core"], new["core"])
            if i.any():
                self._scan(self._sorted({k: np.concatenate([new[k][i], level[k][j]]) for k in new}))
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]["core"]) <= len(self.levels[-1]["core"]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._sorted({k: np.concatenate([a[k], b[k]]) for k in a}))

    def _scan(self, rows: dict[str, np.ndarray]) -> None:
        """Mark the windows that rows, sorted by core and suffix, have in common."""
        fresh = np.r_[True, rows["core"][1:] != rows["core"][:-1]]
        sizes = np.bincount(np.cumsum(fresh) - 1)
        sizes = np.repeat(sizes, sizes)
        for part, scan in (((sizes > 1) & (sizes <= self.small), self._pairs), (sizes > max(1, self.small), self._runs)):
            if part.any():
                own = {k: v[part] for k, v in rows.items()}
                suffix = own["context"][:, SPAN:]
                prefix = np.zeros(len(suffix), dtype=np.int64)  # common with the row before
                for s in range(1, len(suffix), 8192):
                    same = suffix[s : s + 8192] == suffix[s - 1 : s - 1 + len(suffix[s : s + 8192])]
                    prefix[s : s + 8192] = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
                prefix[fresh[part]] = 0
                scan(own, prefix)

    def _pairs(self, rows: dict[str, np.ndarray], prefix: np.ndarray) -> None:
        """Each row against the next few: the common prefix of two is the least of those between."""
        core, left, right, first, last = (rows[k] for k in ("core", "left", "right", "first", "last"))
        marks = np.zeros((len(core), SPAN + 2), dtype=np.int16)
        common = np.full(len(core), LENGTH, dtype=np.int64)
        for step in range(1, self.small):
            common = np.minimum(common[:-1], prefix[step:])
            at = np.flatnonzero(core[step:] == core[:-step])
            if not len(at):
                break
            for s in range(0, len(at), 8192):
                a = at[s : s + 8192]
                b = a + step
                same = rows["context"][a, SPAN - 1 :: -1] == rows["context"][b, SPAN - 1 :: -1]
                reach = np.where(same.all(axis=1), SPAN, same.argmin(axis=1))
                hi = np.minimum(reach, np.minimum(left[a], left[b]))
                lo = LENGTH - np.minimum(common[a], np.minimum(right[a], right[b]))
                for x in (a, b):
                    from_, to = np.maximum(lo, first[x]), np.minimum(hi, last[x])
                    ok = from_ <= to
                    np.add.at(marks, (x[ok], from_[ok]), 1)
                    np.add.at(marks, (x[ok], to[ok] + 1), -1)
        some = np.flatnonzero(marks.any(axis=1))
        self.cover[rows["tag"][some]] |= np.cumsum(marks[some, :-1], axis=1) > 0

    def _runs(self, rows: dict[str, np.ndarray], prefix: np.ndarray) -> None:
        """For each distance of a window before the anchor: rows of one run of common prefixes that also agree to the left."""
        left, right, first, last = (rows[k] for k in ("left", "right", "first", "last"))
        before = np.zeros(len(left), dtype=np.uint64)  # hash of the bytes between the window's start and the anchor
        hit = np.zeros((len(left), SPAN + 1), dtype=bool)
        for d in range(SPAN + 1):
            if d:
                before = (before ^ (rows["context"][:, SPAN - d] + np.uint64(1))) * _MIX
                before ^= before >> np.uint64(29)
            ok = np.flatnonzero((left >= d) & (right >= LENGTH - d) & (first <= d) & (d <= last))
            if len(ok) < 2:
                continue
            run = np.cumsum(prefix < LENGTH - d).astype(np.uint64)[ok]
            key = before[ok] ^ run * np.uint64(_BASE)
            order = np.argsort(key)
            equal = key[order[1:]] == key[order[:-1]]
            hit[ok[order[1:][equal]], d] = hit[ok[order[:-1][equal]], d] = True
        self.cover[rows["tag"]] |= hit

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """tag, first byte, end byte of the covered ranges, relative to the anchor."""
        on = np.zeros((len(self.cover), SPAN + 3), dtype=np.int8)
        on[:, 1:-1] = self.cover
        edge = np.diff(on, axis=1)
        row, start = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        # windows start..end-1 before the anchor
        return row, 1 - end, LENGTH - start


def _contexts(batch: pd.DataFrame) -> dict[str, np.ndarray]:
    context = [bytes(x) for x in batch["context"]]
    left = batch["left"].to_numpy(np.int64)
    grid = np.zeros((len(context), WIDTH), dtype=np.uint8)
    for k, (c, n) in enumerate(zip(context, left.tolist(), strict=True)):
        grid[k, SPAN - n : SPAN - n + len(c)] = np.frombuffer(c, dtype=np.uint8)
    right = np.fromiter(map(len, context), dtype=np.int64, count=len(context)) - left
    names = {"core": "core", "first": "low", "last": "high"}
    return {"context": grid, "left": left, "right": right} | {k: batch[v].to_numpy(np.int64) for k, v in names.items()}


#: A context: its form (the core and hash of the whole), the core that it is dealt by, windows low..high.
_ROW = "fcore long, fwhole long, core long, left int, low int, high int, context binary"
_FIELDS = [c.split()[0] for c in _ROW.split(", ")]
_FOUND = "fcore long, fwhole long, start int, end int"
_KEY = 12  # bytes of a text's digest
_HOT, _MARK = 2, 4


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_text", text_or_empty().cast("binary")).withColumn("key", F.unhex(F.substring(F.md5("_text"), 1, 2 * _KEY)))


def _forms(core: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of arrays sorted by core and whole: where forms begin, each row's form, and its core's number of forms."""
    fresh = np.ones(len(core), dtype=bool)
    fresh[1:] = core[1:] != core[:-1]
    begins = fresh.copy()
    begins[1:] |= whole[1:] != whole[:-1]
    group = np.cumsum(fresh) - 1
    return begins, np.cumsum(begins) - 1, np.bincount(group[begins])[group]


def _packed(held: list[tuple], buckets: int, most: int) -> pd.DataFrame:
    """A row a bucket: the forms (core and context) of the texts held, and their places.

    The forms of a core that has more than ``most`` of them here are spread over all
    buckets; a mark, a form without a place, goes to the core's own.
    """
    lengths = [len(at) for _, at, _, _ in held]
    key = np.repeat(np.frombuffer(b"".join(k for k, *_ in held), dtype=f"V{_KEY}"), lengths)
    pos, core, whole = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
    order = np.lexsort((whole, core))
    key, pos, core, whole = key[order], pos[order].astype(np.int32), core[order], whole[order]
    begins, form, many = _forms(core, whole)
    hot = many > most
    own = ((core.view(np.uint64) * _MIX >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    spread = ((core ^ whole).view(np.uint64) * _MIX >> np.uint64(20)) % np.uint64(buckets)
    bucket = np.where(hot, spread, own).astype(np.int32)
    marks = np.flatnonzero(hot & np.r_[True, core[1:] != core[:-1]])
    first = np.r_[np.flatnonzero(begins), marks]
    where = np.r_[bucket[begins], own[marks]]
    kind = np.r_[hot[begins] * _HOT, np.full(len(marks), _MARK)].astype(np.uint8)
    by = np.argsort(where, kind="stable")
    first, where, kind = first[by], where[by], kind[by]
    seat = np.empty(len(by), dtype=np.int64)  # where each form went
    seat[by] = np.arange(len(by))
    place = np.argsort(bucket, kind="stable")
    numbers = np.unique(where)
    cut, cut_place = (np.searchsorted(x, np.r_[numbers, buckets]) for x in (where, bucket[place]))
    rows = []
    for k in range(len(numbers)):
        a, m = first[cut[k] : cut[k + 1]], place[cut_place[k] : cut_place[k + 1]]
        sizes = np.array([len(a), len(m)], dtype=np.int32)
        of = (seat[form[m]] - cut[k]).astype(np.int32)
        rows.append(b"".join(x.tobytes() for x in (sizes, core[a], whole[a], pos[m], of, key[m], kind[cut[k] : cut[k + 1]])))
    return pd.DataFrame({"bucket": numbers, "packed": rows})


def _unpacked(packed: bytes) -> list[np.ndarray]:
    n, m = np.frombuffer(packed, dtype=np.int32, count=2)
    out, at = [], 8
    for kind, count in (("i8", n), ("i8", n), ("i4", m), ("i4", m), (f"V{_KEY}", m), ("u1", n)):
        x = np.frombuffer(packed, dtype=kind, count=count, offset=at)
        out.append(x)
        at += x.nbytes
    return out


def _judged(rows: list[bytes], most: int) -> Iterator[pd.DataFrame]:
    """Of a bucket: the places of cores that occur again, two of each form marked to go on.

    A core of more than ``most`` forms, or one that was spread, is a crowd.
    """
    parts = [_unpacked(r) for r in rows]
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    core, whole, kind = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 5))
    pos, key = (np.concatenate([p[i] for p in parts]) for i in (2, 4))
    of = np.concatenate([p[3] + b for p, b in zip(parts, base, strict=False)])
    marked = core[kind == _MARK]
    order = np.lexsort((whole, core))
    order = order[kind[order] != _MARK]
    begins, form, many = _forms(core[order], whole[order])
    number = np.full(len(core), -1, dtype=np.int64)
    number[order] = form  # of each form sent, joined with its equals from other texts
    heads = order[begins]
    number = number[of]
    by = np.argsort(number, kind="stable")
    number, pos, key = number[by], pos[by], key[by]
    times = np.bincount(number, minlength=len(heads))
    hot = np.zeros(len(heads), dtype=bool)
    np.logical_or.at(hot, form, kind[order] & _HOT > 0)
    hot |= np.isin(core[heads], marked)
    crowd = hot | (many[begins] > most)
    keep = hot | (many[begins] > 1) | (times > 1)
    nth = np.arange(len(number)) - (np.cumsum(times) - times)[number]
    rows = np.flatnonzero(keep[number])
    for s in range(0, len(rows), 100_000):
        r = rows[s : s + 100_000]
        f = number[r]
        yield pd.DataFrame({"key": [x.tobytes() for x in key[r]], "pos": pos[r], "fcore": core[heads[f]], "fwhole": whole[heads[f]], "goes": nth[r] < 2, "crowd": crowd[f]})


def _places(keyed: DataFrame) -> DataFrame:
    """key, pos, fcore, fwhole, goes, crowd: see ``_judged``.  Anchors travel once, packed by bucket."""
    n = partitions(keyed.sparkSession)
    size = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(4 * n, size // BUCKET)

    @released
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, held, size = Powers(), [], 0
        for batch in batches:
            known: dict[bytes, tuple] = {}
            for key, data in zip(batch["key"], batch["_text"], strict=True):
                if key not in known:
                    at, core = anchors(data, powers)
                    n = len(data)
                    whole = [_hash(data[max(0, a - SPAN) : a + LENGTH], min(a, SPAN) * 1000 + min(n - a, LENGTH)) for a in at.tolist()]
                    known[key] = (key, at, core.view(np.int64), np.array(whole, dtype=np.int64))
                held.append(known[key])
                size += len(known[key][1])
                if size >= FLUSH:
                    yield _packed(held, buckets, HOT)
                    held, size = [], 0
        if size:
            yield _packed(held, buckets, HOT)

    @released
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = [], None
        for batch in batches:
            for bucket, packed in zip(batch["bucket"], batch["packed"], strict=True):
                if bucket != now and held:
                    yield from _judged(held, CROWD)
                    held = []
                now = bucket
                held.append(packed)
        if held:
            yield from _judged(held, CROWD)

    sent = keyed.select("key", "_text").where(F.octet_length("_text") >= LENGTH).mapInPandas(send, "bucket int, packed binary")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(judge, "key binary, pos int, fcore long, fwhole long, goes boolean, crowd boolean")


def _half(rows: DataFrame) -> DataFrame:
    """Either half of the windows of each row, with its longer core and the bytes that it needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                context, left = bytes(r.context), r.left
                right = len(context) - left
                mid = (r.low + r.high) // 2
                for low, high in ((r.low, mid), (mid + 1, r.high)):
                    if low > high or left < low or right < LENGTH - high:
                        continue  # no window of this half lies in the document
                    a, b = min(left, high), min(right, LENGTH - low)
                    core = _hash(context[left - low : left + LENGTH - high], low * 1000 + high + 1)
                    part = context[left - a : left + b]
                    out.append((r.fcore, r.fwhole, core, a, low, high, part, _hash(part, (low * 1000 + a) * 1000 + b)))
            yield pd.DataFrame(out, columns=[*_FIELDS, "whole"])

    return rows.select(*_FIELDS).mapInPandas(run, _ROW + ", whole long")


def _scan(rows: DataFrame) -> DataFrame:
    """fcore, fwhole, start, end: what the index families find, relative to the anchors.

    Cores are dealt to partitions, and in each to shelves of about FAMILY contexts:
    a shelf is a family, whose batches come in no order.
    """
    n = partitions(rows.sparkSession)
    shelves = rows.count() // (n * FAMILY) + 1

    def found(family: Family, names: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag, start, end = family.matches()
        if len(tag):
            name = pd.concat(names, ignore_index=True).iloc[tag]
            yield pd.DataFrame({"fcore": name["fcore"].to_numpy(), "fwhole": name["fwhole"].to_numpy(), "start": start, "end": end}).drop_duplicates()

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, names, shelf = Family(SMALL), [], None
        for batch in batches:
            at = np.flatnonzero(np.diff(batch["shelf"].to_numpy())) + 1
            for s, e in zip([0, *at.tolist()], [*at.tolist(), len(batch)], strict=True):
                part = batch.iloc[s:e]
                if not len(part):
                    continue
                if part["shelf"].iloc[0] != shelf and names:
                    yield from found(family, names)
                    family, names = Family(SMALL), []
                shelf = part["shelf"].iloc[0]
                for i in range(0, len(part), BATCH):
                    now = part.iloc[i : i + BATCH]
                    names.append(now[["fcore", "fwhole"]])
                    family.add(_contexts(now))
        if names:
            yield from found(family, names)

    dealt = rows.select(*_FIELDS, F.pmod(F.xxhash64("core", F.lit(5)), F.lit(shelves)).cast("int").alias("shelf"))
    return dealt.repartition(n, "core").sortWithinPartitions("shelf").mapInPandas(run, _FOUND)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """key, start, end: byte ranges of distinct texts that are covered by repeated windows.

    ``key`` is the head of the text's MD5.  Ranges may overlap.
    """
    keyed = _keyed(docs)
    places = settle(_places(keyed), "places")
    # the bytes of the contexts that go on are cut from the texts, copies counting once
    wanted = places.where("goes").groupBy("key").agg(F.collect_list(F.struct("pos", "fcore", "fwhole", "crowd")).alias("places"))
    texts = keyed.where(F.octet_length("_text") >= LENGTH).groupBy("key").agg(F.first("_text").alias("_text"))

    def row(x):
        left = F.least(x["pos"], F.lit(SPAN))
        context = F.substring(F.col("_text"), x["pos"] - left + 1, left + LENGTH)
        form = [x[c].alias(c) for c in ("fcore", "fwhole")]
        return F.struct(*form, x["fcore"].alias("core"), left.alias("left"), F.lit(0).alias("low"), F.lit(SPAN).alias("high"), context.alias("context"), x["crowd"].alias("crowd"))

    rows = texts.join(wanted, "key").select(F.explode(F.transform("places", row)).alias("x")).select("x.*")
    rows, found = settle(rows, "contexts"), []
    # spread cores are counted here, where all their forms are known
    big = settle(rows.where("crowd").groupBy("core").count().where(F.col("count") > CROWD).select("core"), "crowds")
    rows = rows.drop("crowd").join(big.withColumn("crowd", F.lit(True)), "core", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False))) if not big.isEmpty() else rows.withColumn("crowd", F.lit(False))
    while True:
        found.append(settle(_scan(rows.where("not crowd")), "found"))
        crowds = rows.where("crowd")
        if crowds.isEmpty():
            break
        halves = settle(_half(crowds), "halves")
        # equal unions repeat as a whole; cores that are left alone hold no repeat
        same = halves.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("fcore", "fwhole")).alias("one"))
        same = settle(same.select("core", "whole", "n", "one.*"), "unions")
        full = halves.withColumn("right", F.octet_length("context") - F.col("left")).join(same.where("n > 1").select("core", "whole"), ["core", "whole"], "left_semi")
        found.append(full.select("fcore", "fwhole", (-F.col("left")).alias("start"), F.col("right").alias("end")))
        sizes = same.groupBy("core").count().where("count > 1").select("core", (F.col("count") > CROWD).alias("crowd"))
        left = same.join(sizes, "core").select("core", "whole", "fcore", "fwhole", "crowd")
        rows = settle(halves.join(left, ["core", "whole", "fcore", "fwhole"]).dropDuplicates(["core", "whole"]).select(*_FIELDS, "crowd"), "contexts")
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    ranges = places.select("key", "pos", "fcore", "fwhole").join(out.distinct(), ["fcore", "fwhole"])
    return ranges.select("key", (F.col("pos") + F.col("start")).cast("long").alias("start"), (F.col("pos") + F.col("end")).cast("long").alias("end"))


def merged(ranges: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Sorted maximal ranges within [0, n)."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, a), min(n, b)) for a, b in ranges):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def within_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges shrunk to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, keep_columns: tuple[str, ...] = ("doc_id",), whole_characters: bool = False) -> DataFrame:
    """``keep_columns``, ``kept`` (the remaining bytes), n_bytes, n_removed, n_spans.

    With ``whole_characters`` a range gives way at either end to characters that
    it covers in part.
    """
    keyed = _keyed(docs)
    ranges = repeated_ranges(docs).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    names = [c for c in keep_columns]
    joined = keyed.select(*names, "_text", "key").join(ranges, "key", "left")

    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def cut(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for data, found in zip(text, ranges, strict=True):
            spans = [] if found is None else merged([(int(x["start"]), int(x["end"])) for x in found], len(data))
            if whole_characters:
                spans = within_characters(data, spans)
            at, parts = 0, []
            for a, b in spans:
                parts.append(data[at:a])
                at = b
            parts.append(data[at:])
            out.append((b"".join(parts), sum(b - a for a, b in spans), len(spans)))
        return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    out = joined.select(*names, F.octet_length("_text").cast("long").alias("n_bytes"), cut("_text", "ranges").alias("x"))
    return out.select(*names, "n_bytes", "x.n_removed", "x.n_spans", "x.kept")


def report(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
