"""Tables of which a change writes its own rows alone, read with their changes merged.

A table is a folder: ``base/version=n`` holds all rows as of version n, ``delta/version=n``
the rows that version n changed, with ``_deleted`` for those that it took away.  A
version counts once Spark has marked its folder as complete, so a job that is killed leaves
the version before it as it was, and the next change takes its number.  There is one writer
at a time.  Keys are unique; rows with a null key are left out of changes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Table(NamedTuple):
    spark: SparkSession
    path: str
    key: str


def _folders(table: Table, kind: str) -> dict[int, str]:
    """Complete versions of a kind and their folders."""
    jvm = table.spark._jvm
    path = lambda *x: jvm.org.apache.hadoop.fs.Path("/".join(x))
    root = f"{table.path}/{kind}"
    fs = path(root).getFileSystem(table.spark._jsc.hadoopConfiguration())
    if not fs.exists(path(root)):
        return {}
    found = [s.getPath().getName() for s in fs.listStatus(path(root))]
    return {int(n.removeprefix("version=")): f"{root}/{n}" for n in found if n.startswith("version=") and fs.exists(path(root, n, "_SUCCESS"))}


def newest(table: Table) -> int | None:
    """The newest complete version; None before there is one."""
    return max([*_folders(table, "base"), *_folders(table, "delta")], default=None)


def create(table: Table, rows: DataFrame) -> Table:
    """Version 0, all rows; nothing is done where it is there already."""
    if newest(table) is None:
        rows.write.mode("overwrite").parquet(f"{table.path}/base/version=0")
    return table


def changes(table: Table, after: int, until: int) -> DataFrame | None:
    """All changed rows of versions after one and until another, with ``version`` and ``_deleted``."""
    taken = [p for n, p in sorted(_folders(table, "delta").items()) if after < n <= until]
    if not taken:
        return None
    return table.spark.read.option("basePath", f"{table.path}/delta").parquet(*taken)


def read(table: Table, version: int | None = None) -> DataFrame:
    """The rows as of a version, the newest one where none is given.

    Only the keys of changes meet the base, which isn't shuffled where Spark finds them
    small enough to send around.
    """
    last = newest(table)
    until = last if version is None else version
    bases = {n: p for n, p in _folders(table, "base").items() if until is not None and n <= until}
    if not bases:
        raise ValueError(f"{table.path} has no version {version}")
    whole = table.spark.read.parquet(bases[max(bases)])
    delta = changes(table, max(bases), until)
    if delta is None:
        return whole
    latest = delta.groupBy(table.key).agg(F.max_by(F.struct(*whole.columns, "_deleted"), "version").alias("_row"))
    kept = whole.join(delta.select(table.key).distinct(), table.key, "left_anti").select(*whole.columns)
    return kept.unionByName(latest.where("not _row._deleted").select(*[F.col(f"_row.{c}").alias(c) for c in whole.columns]))


def touched(table: Table, ids: DataFrame) -> DataFrame:
    """The rows of the newest version whose keys are listed."""
    now = read(table)
    return now.join(ids.select(table.key).distinct(), table.key, "left_semi").select(*now.columns)


def commit(table: Table, rows: DataFrame | None = None, gone: DataFrame | None = None, version: int | None = None) -> int:
    """Write a version: ``rows`` as they are from now on, and the keys in ``gone``, which have no row any more.

    A version that is complete already isn't written again, so that a caller that
    numbers its changes may repeat them.
    """
    number = newest(table) + 1 if version is None else version
    if number in _folders(table, "delta") or number in _folders(table, "base"):
        return number
    parts = []
    if rows is not None:
        parts.append(rows.where(F.col(table.key).isNotNull()).withColumn("_deleted", F.lit(False)))
    if gone is not None:
        blank = [F.col(table.key) if f.name == table.key else F.lit(None).cast(f.dataType).alias(f.name) for f in read(table).schema]
        parts.append(gone.where(F.col(table.key).isNotNull()).select(table.key).distinct().select(*blank, F.lit(True).alias("_deleted")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out.write.mode("overwrite").parquet(f"{table.path}/delta/version={number}")
    return number


def upsert(table: Table, new: DataFrame, keep: tuple[str, ...] = (), version: int | None = None) -> int:
    """Rows of ``new`` replace those of their keys; columns in ``keep`` hold their old values where there was a row."""
    columns = read(table).columns
    old = touched(table, new).select(table.key, F.lit(True).alias("_had"), *[F.col(c).alias(f"_old_{c}") for c in keep])
    pick = lambda c: F.when(F.col("_had"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c)
    return commit(table, new.join(old, table.key, "left").select(*[pick(c) for c in columns]), version=version)


def alter(table: Table, ids: DataFrame, values: dict[str, Column], version: int | None = None) -> int:
    """New values of columns in the listed rows; rows that have them already aren't written."""
    differs = F.lit(False)
    for column, value in values.items():
        differs = differs | ~F.col(column).eqNullSafe(value)
    return commit(table, touched(table, ids).where(differs).withColumns(values), version=version)


def delete(table: Table, ids: DataFrame, version: int | None = None) -> int:
    """The listed rows go; keys without a row aren't written."""
    return commit(table, gone=touched(table, ids), version=version)


def compact(table: Table) -> int:
    """The newest version written as a base, in files of a size that Spark picks; older versions stay until ``vacuum``."""
    number = newest(table)
    if number not in _folders(table, "base"):
        read(table).repartition(table.key).write.mode("overwrite").parquet(f"{table.path}/base/version={number}")
    return number


def vacuum(table: Table) -> list[int]:
    """Delete what the newest base made needless; readers of those older versions must have ended.  Returns the versions left."""
    first = max(_folders(table, "base"))
    jvm = table.spark._jvm
    for kind, spare in (("base", lambda n: n < first), ("delta", lambda n: n <= first)):
        for number, path in _folders(table, kind).items():
            if spare(number):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(table.spark._jsc.hadoopConfiguration()).delete(at, True)
    return sorted({*_folders(table, "base"), *_folders(table, "delta")})
