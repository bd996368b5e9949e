"""WARC archives: one gzip member per record, written and read sequentially.

An archive is a byte stream.  Executors have no common file system of their own,
so the writer returns archives as rows (archive, chunk, data) that any Spark
sink can store; the concatenated chunks of an archive are a valid .warc.gz file.
The reader decompresses incrementally, member by member, frames each block by its
Content-Length and checks block and payload digests.

Edge cases: a null payload counts as empty; a null url gives an empty target; a
null page id gives record id ``urn:page:null``; of repeated rows with the same id
and payload each is a response; an empty table gives no archives; a very long
payload is one record, read and written in memory by one task; columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

CHUNK = 1 << 20
#: Archives end after the record that passes this many bytes.
ARCHIVE_BYTES = 32 << 20
#: Places that share the copies of a payload while they find the first one.
SALTS = 32
DATE = "1970-01-01T00:00:00Z"


def digest32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to=None, size: int | None = None) -> bytes:
    """One WARC record as its own gzip member.

    A revisit's block is empty; it names the record it repeats, the digest of the
    full payload and, in an extension field, that payload's length (``size``, where the
    payload isn't at hand).
    """
    name = lambda x: f"<urn:page:{'null' if x is None else int(x)}>"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"WARC-Full-Payload-Length: {len(payload) if size is None else size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    raw = ("\r\n".join(head) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class WarcError(ValueError):
    """A record that doesn't keep to the format, or whose digest differs."""


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of a stream that comes in chunks."""
    inflate, parts, fresh = zlib.decompressobj(31), [], True
    for chunk in chunks:
        while chunk:
            fresh = False
            parts.append(inflate.decompress(chunk))
            chunk = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts, fresh = zlib.decompressobj(31), [], True
            else:
                break
    if not fresh:
        raise WarcError("the last gzip member is cut off")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and block of one record, framed by Content-Length."""
    end = member.find(b"\r\n\r\n")
    if end < 0 or not member.startswith(b"WARC/"):
        raise WarcError("no WARC header")
    fields = {}
    for row in member[:end].decode("utf-8").split("\r\n")[1:]:
        key, _, value = row.partition(":")
        fields[key.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    block = member[end + 4 : end + 4 + size]
    if len(block) != size or member[end + 4 + size :] != b"\r\n\r\n":
        raise WarcError("the block doesn't end where Content-Length says")
    if fields.get("warc-block-digest", "") != f"sha1:{digest32(block)}":
        raise WarcError("block digest differs")
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{digest32(block)}":
        raise WarcError("payload digest differs")
    return fields, block


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(archive, chunk, data) of the records of ``pages`` (page_id, url, html).

    Of the records with equal payloads of at least ``min_revisit_bytes``, those
    with the smallest page id are responses; the others become revisits.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("_body"),
    ).withColumn("_key", F.sha2("_body", 256))
    # only keys meet here, in SALTS places each; the bodies are dealt by page, so that a common payload's copies stay apart
    keys = own.select("page_id", "_key").where(F.octet_length("_body") >= min_revisit_bytes)
    first = keys.groupBy("_key").agg(F.min("page_id").alias("_refers"), F.count("*").alias("n")).where("n > 1")
    first = first.select("_key", "_refers", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    keys = keys.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = keys.join(first, ["_key", "_salt"]).where("page_id <> _refers").select("page_id", "_key", "_refers").distinct()

    def respond(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = [bytes(x) for x in batch["_body"]]
            digests = [digest32(x) for x in bodies]
            ids = [None if x is None or pd.isna(x) else int(x) for x in batch["_id"]]
            records = [record_bytes(i, u, b, d) for i, u, b, d in zip(ids, batch["url"], bodies, digests, strict=True)]
            yield pd.DataFrame({"_id": batch["_id"], "url": batch["url"], "_key": batch["_key"], "digest": digests, "size": [len(x) for x in bodies], "record": records})

    # records go to the join as they are stored, compressed; revisits are written after it, from their digest and length
    own = own.select(F.col("page_id").cast("string").alias("_id"), "url", "_key", "_body").mapInPandas(respond, "_id string, url string, _key string, digest string, size long, record binary")
    own = own.withColumn("page_id", F.col("_id").cast("long")).join(again, ["page_id", "_key"], "left")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, shard, chunk, held, size, total = TaskContext.get().partitionId(), 0, 0, [], 0, 0
        rows = lambda: pd.DataFrame({"archive": [f"{part:06d}-{shard:06d}"], "chunk": [chunk], "data": [b"".join(held)]})
        for batch in batches:
            for page_id, url, digest, full, record, refers in zip(*(batch[c] for c in ("page_id", "url", "digest", "size", "record", "_refers")), strict=True):
                record = bytes(record) if refers is None or pd.isna(refers) else record_bytes(int(page_id), url, b"", digest, refers, full)
                held.append(record)
                size, total = size + len(record), total + len(record)
                if size >= CHUNK or total >= ARCHIVE_BYTES:
                    yield rows()
                    chunk, held, size = chunk + 1, [], 0
                if total >= ARCHIVE_BYTES:
                    shard, chunk, total = shard + 1, 0, 0
        if held:
            yield rows()

    revisit = F.col("_refers").isNotNull()
    own = own.select(F.col("_id").alias("page_id"), "url", "digest", "size", F.when(~revisit, F.col("record")).alias("record"), F.col("_refers").cast("string"))
    return own.mapInPandas(pack, "archive string, chunk long, data binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives: page_id, url, record_type, refers_to, payload digest and length, payload.

    Each archive is read in order by one task; archives are bounded in size.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def streams():
            for batch in batches:
                yield from zip(batch["archive"], batch["data"], strict=True)

        def number(value: str) -> int | None:
            got = value.strip("<>").rpartition(":")[2]
            return None if got == "null" else int(got)

        flow, ahead = streams(), None
        ahead = next(flow, None)
        while ahead is not None:
            archive = ahead[0]

            def chunks():
                nonlocal ahead
                while ahead is not None and ahead[0] == archive:  # noqa: B023
                    yield bytes(ahead[1])
                    ahead = next(flow, None)

            rows, size = [], 0
            for member in members(chunks()):
                fields, block = parse(member)
                refers = fields.get("warc-refers-to")
                rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], number(refers) if refers else None, fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["warc-full-payload-length"]), block))
                size += len(block)
                if size > 8 << 20:
                    yield _frame(rows)
                    rows, size = [], 0
            if rows:
                yield _frame(rows)

    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.repartition(parts, "archive").sortWithinPartitions("archive", "chunk").mapInPandas(unpack, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives written, stored in the shared folder, and read back: one row a page."""
    stored = settle(write_archives(pages), "warc")
    return read_archives(stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
