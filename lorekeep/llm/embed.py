"""Near-duplicate vectors by cross-polytope hashing.

Vectors are turned by sign flips and fast Hadamard transforms; the coordinate of
the largest size, with its sign, is a hash.  A few hashes joined name a bucket of
a table; multiprobe adds the buckets of the runner-up coordinates.  Candidates of
a bucket are compared exactly, by cosine in double precision.

Tables, hashes and probes are the same at every size, and so is recall.  Equal
vectors form one class with a weight and are never expanded into pairs.
A pair that meets in several tables or buckets counts in the first one only, so each
task returns counts and a spanning forest of its links instead of pairs.  Buckets
beyond BLOCK rows are cut into blocks, and each pair of blocks is a task of its
own.

Edge cases: vectors that are null, zero or hold null or non-finite components link
with nothing; vectors of different lengths never link; a null id counts as a
vector but gets no component; rows that repeat an id and vector count as two
vectors; an empty table gives no rows; columns other than vec_id and embedding are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, settle
from .components import components

#: Tables, hashes joined in a bucket's name, buckets of a vector in each table (its own and runners-up), rows of a block.
TABLES, HASHES, PROBES, BLOCK = 16, 3, 4, 512
#: Buckets of so many rows are compared together, to tell which hold a link.
FEW = 12


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two)."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows times powers of two that bring their largest component near 1: no norm overflows or vanishes."""
    largest = np.abs(x).max(axis=1, initial=0.0)
    return np.ldexp(x, -np.frexp(largest)[1][:, None])


def codes(vectors: np.ndarray, hashes: int = HASHES, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Bucket codes, rows x tables x probes; the first is the vector's own bucket."""
    vectors = scaled(np.asarray(vectors, dtype=np.float64))
    n, dim = vectors.shape
    width = 1 << max(1, (dim - 1).bit_length())
    unit = np.zeros((n, width))
    unit[:, :dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng(dim * 7919 + 11)
    out = np.zeros((n, tables, probes), dtype=np.int64)
    for t in range(tables):
        best, second, loss = [], [], []
        for _ in range(hashes):
            y = unit
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            one = np.take_along_axis(size, top, 1)
            top = np.where((one[:, :1] >= one[:, 1:]), top, top[:, ::-1])
            signed = top * 2 + (np.take_along_axis(y, top, 1) < 0)
            best.append(signed[:, 0])
            second.append(signed[:, 1])
            got = np.take_along_axis(size, top, 1)
            loss.append(got[:, 0] - got[:, 1])
        best, second, loss = np.stack(best, 1), np.stack(second, 1), np.stack(loss, 1)
        radix = (2 * width) ** np.arange(hashes, dtype=np.int64)
        out[:, t, 0] = (best * radix).sum(axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        for p in range(1, probes):
            which = order[:, (p - 1) % hashes]
            code = best.copy()
            code[np.arange(n), which] = second[np.arange(n), which]
            out[:, t, p] = (code * radix).sum(axis=1)
    return out


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def valid(column: str = "embedding"):
    """Whether a vector can link: not null, all components finite, not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0)


def _groups(links: np.ndarray) -> np.ndarray:
    """Number of the component of each row, by breadth-first search over the link matrix."""
    n = len(links)
    group = np.full(n, -1)
    for s in range(n):
        if group[s] < 0:
            front = np.zeros(n, dtype=bool)
            front[s] = True
            seen = front.copy()
            while front.any():
                front = links[front].any(axis=0) & ~seen
                seen |= front
            group[seen] = s
    return group


def links(classes: DataFrame, threshold: float, hashes: int = HASHES, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """From (class_id, weight, embedding): rows (class_id, n, other).

    ``n`` sums the weights of linked classes found in one task; ``other`` is a row
    of the same component there, or null.
    """

    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len)
            for dim in sorted(sizes.unique()):
                part = batch[sizes == dim]
                x = np.stack(part["embedding"].to_list()).astype(np.float64)
                own = codes(x, hashes, tables, probes).reshape(len(part), -1)
                # what travels: 32-bit components and codes where they say the same
                slim = x.astype("<f4")
                with np.errstate(over="ignore", invalid="ignore"):
                    x = slim if (slim == x).all() else x.astype("<f8")
                small = own.astype("<i4") if own.max() < 2**31 else own.astype("<i8")
                yield pd.DataFrame({"class_id": part["class_id"], "weight": part["weight"], "dim": np.int32(dim), "vector": [r.tobytes() for r in x], "codes": list(own), "packed": [r.tobytes() for r in small]})

    hashed = settle(classes.mapInPandas(hash_rows, "class_id long, weight long, dim int, vector binary, codes array<long>, packed binary"), "codes")
    seats = hashed.select("class_id", "dim", F.posexplode("codes").alias("at", "code")).select("class_id", "dim", (F.col("at") / probes).cast("int").alias("tab"), "code").distinct()
    key = ["tab", "dim", "code"]
    crowds = seats.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    placed = seats.join(crowds, key)
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("class_id", *key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    heavy = placed.join(hashed.select("class_id", "weight", "vector", "packed"), "class_id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(rows: pd.DataFrame) -> pd.DataFrame | None:
            dim = int(rows["dim"].iloc[0])
            x = np.stack([np.frombuffer(v, dtype=f"<f{len(v) // dim}").astype(np.float64) for v in rows["vector"]])
            x = scaled(x)
            norm = np.linalg.norm(x, axis=1)
            close = x @ x.T >= threshold * norm[:, None] * norm[None, :]
            np.fill_diagonal(close, False)
            i, j, own = int(rows["i"].iloc[0]), int(rows["j"].iloc[0]), rows["own"].to_numpy()
            if i != j:  # pairs within a block belong to the task of that block alone
                close &= own[:, None] != own[None, :]
            a, b = np.nonzero(np.triu(close))
            if not len(a):
                return None
            t, code = int(rows["tab"].iloc[0]), int(rows["code"].iloc[0])
            all_codes = np.stack([np.frombuffer(c, dtype=f"<i{len(c) // (tables * probes)}") for c in rows["packed"]]).reshape(len(rows), tables, probes).astype(np.int64)
            keep = np.zeros(len(a), dtype=bool)
            for s in range(0, len(a), 20_000):
                p, q = all_codes[a[s : s + 20_000], : t + 1], all_codes[b[s : s + 20_000], : t + 1]
                # the owner of a pair: the smallest of the buckets where both have a seat, own or probed
                both = (p[:, :, :, None] == q[:, :, None, :]).any(axis=3)
                before = both[:, :t].any(axis=(1, 2))
                here = np.where(both[:, t], p[:, t], np.iinfo(np.int64).max).min(axis=1)
                keep[s : s + 20_000] = ~before & (here == code)
            a, b = a[keep], b[keep]
            if not len(a):
                return None
            n = len(rows)
            weight = rows["weight"].to_numpy()
            count = np.bincount(a, weights=weight[b], minlength=n) + np.bincount(b, weights=weight[a], minlength=n)
            net = np.zeros((n, n), dtype=bool)
            net[a, b] = net[b, a] = True
            some = np.flatnonzero(count > 0)
            ids = rows["class_id"].to_numpy()
            group = _groups(net[np.ix_(some, some)])
            return pd.DataFrame({"class_id": ids[some], "n": count[some].astype(np.int64), "other": ids[some][group]})

        def close_groups(rows: pd.DataFrame, bounds: list[int]) -> np.ndarray:
            """Which groups of sorted rows may hold a link; small ones are compared all at once."""
            sizes = np.diff(bounds)
            maybe = sizes > FEW
            small = np.flatnonzero((sizes > 1) & (sizes <= FEW))
            if not len(small):
                return np.flatnonzero(maybe)
            at = np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in small.tolist()])
            group = np.repeat(small, sizes[small])
            dims = rows["dim"].to_numpy()[at]
            x = np.zeros((len(at), int(dims.max())))
            for k, (v, d) in enumerate(zip(rows["vector"].iloc[at], dims.tolist(), strict=True)):
                x[k, :d] = np.frombuffer(v, dtype=f"<f{len(v) // d}")
            x = scaled(x)
            norm = np.linalg.norm(x, axis=1)
            for step in range(1, FEW):
                a = np.flatnonzero(group[step:] == group[:-step])
                if not len(a):
                    break
                b = a + step
                # a hair below the threshold: the exact comparison follows
                near = np.einsum("ij,ij->i", x[a], x[b]) >= (threshold - 1e-6) * norm[a] * norm[b]
                maybe[group[a[near]]] = True
            return np.flatnonzero(maybe)

        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rest is None or not len(rest):
                continue
            mark = rest[["tab", "dim", "code", "i", "j"]].to_numpy()
            bounds = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1).tolist()]
            if batch is None:
                bounds.append(len(rest))  # else the last group may go on
            for g in close_groups(rest, bounds).tolist():
                if (got := out(rest.iloc[bounds[g] : bounds[g + 1]])) is not None:
                    yield got
            rest = rest.iloc[bounds[-1] :]

    n = partitions(heavy.sparkSession)
    tasks = [*key, "i", "j"]
    return heavy.repartition(n, *tasks).sortWithinPartitions(*tasks).mapInPandas(compare, "class_id long, n long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = own.where(valid()).withColumn("key", F.unhex(F.sha2(F.to_json("embedding").cast("binary"), 256)))
    good = settle(good, "vectors")
    classes = good.groupBy("key").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"), F.min(F.struct(F.col("vec_id").isNull().alias("n"), F.col("vec_id").alias("v"), F.col("embedding").alias("embedding"))).alias("one"))
    # classes get an id of their own: vec ids may be null
    classes = settle(classes.select("key", "weight", "low", F.coalesce("low", F.xxhash64("key")).alias("class_id"), "one.embedding"), "classes")
    found = settle(links(classes.select("class_id", "weight", "embedding"), threshold), "links")
    counts = found.groupBy("class_id").agg(F.sum("n").alias("n"))
    groups = components(found.select("class_id", "other").where("class_id <> other").distinct(), "class_id", "other")
    named = classes.select("key", "weight", "class_id").join(counts, "class_id", "left").join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = named.select("key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    linked = good.select("vec_id", "key").join(named, "key", "left").select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    rest = own.where(~F.coalesce(valid(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionAll(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
