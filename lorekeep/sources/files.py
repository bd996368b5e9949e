"""Reading trees of documents and sources, and the Markdown form of a memory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lorekeep.functions import hashing as H
from lorekeep.functions import text as T

# Folders that hold no documents of the project, and the size of a chunk.
SKIPPED = ("target", "node_modules", "dist", "build", ".venv", "venv")
MAX_CHUNK_CHARS = 1600


def tree(spark: SparkSession, root: str, extensions: Sequence[str] = ("md",)) -> DataFrame:
    """path (relative), text: files under a root, without hidden and build folders."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    base = root.rstrip("/")
    own = files.select(F.substring_index("_metadata.file_path", f"{base.rpartition('/')[2]}/", -1).alias("path"), F.col("value").alias("text"))
    folders = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    return own.where(~F.rlike("path", F.lit(rf"(^|/)(\.[^/]+|{folders})/"))).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def admitted(files: DataFrame, exclusions: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by substrings of the relative path and by paths that leave the root."""
    bad = F.rlike("path", F.lit(r"(^|/)\.\.(/|$)|^/"))
    for x in exclusions:
        bad = bad | F.contains("path", F.lit(x))
    return files.where(~bad), files.where(bad)


def chunk_markdown(text: str, limit: int = MAX_CHUNK_CHARS) -> list[tuple[str | None, str]]:
    """(heading, body) chunks: cut at headings, long sections packed by paragraphs."""
    sections, heading, lines = [], None, []

    def close() -> None:
        body = "\n".join(lines).strip()
        if body:
            sections.append((heading, body))

    for line in text.split("\n"):
        line = line.removesuffix("\r")
        bare = line.lstrip()
        title = bare.lstrip("#")
        if bare.startswith("#") and title.startswith(" "):
            close()
            heading, lines = title.strip(), []
        else:
            lines.append(line)
    close()
    out = []
    for title, body in sections:
        if len(body) <= limit:
            out.append((title, body))
            continue
        held: list[str] = []
        size = 0
        for paragraph in filter(None, (p.strip() for p in body.split("\n\n"))):
            if held and size + len(paragraph) > limit:
                out.append((title, "\n\n".join(held)))
                held, size = [], 0
            size += len(paragraph) + (2 if held else 0)
            held.append(paragraph)
            if size >= limit:
                out.append((title, "\n\n".join(held)))
                held, size = [], 0
        if held:
            out.append((title, "\n\n".join(held)))
    return out


_CHUNK = ArrayType(StructType([StructField("ordinal", LongType()), StructField("heading", StringType()), StructField("body", StringType())]))


@F.pandas_udf(_CHUNK)
def markdown_chunks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"ordinal": i, "heading": h, "body": b} for i, (h, b) in enumerate(chunk_markdown(t or ""))])


def chunks(files: DataFrame) -> DataFrame:
    """chunk_id, path, ordinal, heading, body of each file."""
    rows = files.select("path", F.inline(markdown_chunks("text")))
    return rows.select(F.concat_ws("#", "path", F.col("ordinal").cast("string")).alias("chunk_id"), "path", "ordinal", "heading", "body")


FIELDS = ("id", "scope", "category", "status", "confidence", "created_at")


def to_markdown(memory: DataFrame) -> DataFrame:
    """memory with ``markdown``: front matter, then the body."""
    head = [F.concat(F.lit(f"{f}: "), F.coalesce(F.regexp_replace(F.col(f).cast("string"), r"\s+", " "), F.lit(""))) for f in FIELDS]
    return memory.withColumn("markdown", F.concat(F.concat_ws("\n", F.lit("---"), *head, F.lit("---")), F.lit("\n\n"), F.col("body"), F.lit("\n")))


def from_markdown(rows: DataFrame, text: str = "markdown") -> DataFrame:
    """The fields and body of serialised memories; rows without front matter are dropped."""
    parts = rows.where(F.rlike(text, F.lit(r"^---\n(.|\n)*?\n---\n")))
    head = F.regexp_extract(text, r"^---\n((?:.|\n)*?)\n---\n", 1)
    field = lambda f: F.regexp_extract(head, rf"(?m)^{f}: (.*)$", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"^---\n(?:.|\n)*?\n---\n\n?", ""), r"\n\z", "")
    return parts.select(*[F.when(field(f) != "", field(f)).alias(f) for f in FIELDS], body.alias("body"))


def lesson_bullets(text: str) -> list[str]:
    """Top-level bullets with their indented continuations, without short and link entries."""
    out: list[str] = []
    open_ = False
    for line in text.splitlines():
        if line.startswith("- "):
            out.append(line[2:].strip())
            open_ = True
        elif open_ and line[:1] in (" ", "\t") and line.strip():
            out[-1] += " " + line.strip()
        else:
            open_ = False
    return [b for b in out if len(b.encode()) >= 20 and not b.startswith("[")]


@F.pandas_udf(ArrayType(StringType()))
def bullets(text: pd.Series) -> pd.Series:
    return text.map(lambda t: lesson_bullets(t or ""))


def import_transcripts(rows: DataFrame, raw: str, source: str, form: str) -> DataFrame:
    """``rows`` with redacted text, the session id named by it, and the format's label."""
    clean = T.redact(raw)
    return rows.withColumn("redacted", clean).withColumn("session_id", H.fnv_hex(F.concat(F.lit(f"{source}\n"), "redacted"))).withColumn("format", F.lit(form))


def json_payload(reply: str | Column) -> Column:
    """The JSON object within a model's reply: after thoughts, within fences, between the outer braces."""
    x = F.regexp_replace(reply, r"(?s)^.*</think>", "")
    return F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))


def embed(rows: DataFrame, embedder, text: str = "body", key: str = "memory_id", batch: int = 64) -> DataFrame:
    """key, vector: an injected callable (list of texts to list of vectors) run over Arrow batches."""
    schema = StructType([rows.schema[key]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(0, len(part), batch):
                now = part.iloc[i : i + batch]
                yield pd.DataFrame({key: now[key], "vector": embedder(now[text].to_list())})

    return rows.select(key, text).mapInPandas(run, f"{key} {schema[key].dataType.simpleString()}, vector array<double>")
