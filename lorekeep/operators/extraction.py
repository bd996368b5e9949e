"""Order-dependent passes over a session's lines or a queue, and source parsing."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T

from .graph import resolve_calls
from .stages import settle
from .state import first_per
from .workspace import tests_of_functions

WINDOW = 30


def failure_resolutions(lines: DataFrame, limit: int = 5) -> DataFrame:
    """session, fail_line, fix_line: each failure with the first resolution of the next 30 lines.

    The scan goes on behind a resolution, so that one fix answers one failure: a
    fold over the session's marked lines.  Only those lines go to Python.
    """
    said = T.strip_speaker("line")
    flags = lines.select("session", "line_no", (T.failure_line("line") & T.lesson_like(said)).alias("bad"), (T.resolution_line("line") & T.lesson_like(said)).alias("good"))
    ranked = flags.withColumn("at", F.row_number().over(Window.partitionBy("session").orderBy("line_no"))).where("bad or good")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        at, no = rows["at"].to_list(), rows["line_no"].to_list()
        bad, good = rows["bad"].to_list(), rows["good"].to_list()
        out, i = [], 0
        while i < len(at) and len(out) < limit:
            j = next((k for k in range(i + 1, len(at)) if good[k] and at[k] - at[i] <= WINDOW), None) if bad[i] else None
            if j is None:
                i += 1
            else:
                out.append((rows["session"].iloc[0], no[i], no[j]))
                i = j + 1
        return pd.DataFrame(out, columns=["session", "fail_line", "fix_line"])

    return ranked.groupBy("session").applyInPandas(fold, "session long, fail_line long, fix_line long")


def parse_python(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """Definitions (kind, qualified name, first and last line) and calls (caller, callee) of a Python file."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return [], []
    items, calls = [], []

    def walk(node: ast.AST, scope: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = (*scope, child.name)
                kind = "type" if isinstance(child, ast.ClassDef) else "test" if child.name.startswith("test_") else "function"
                items.append((kind, "::".join((path, *inner)), child.lineno, child.end_lineno))
            elif isinstance(child, ast.Call):
                name = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", None)
                if name and scope:
                    calls.append(("::".join((path, *scope)), name))
            walk(child, inner)

    walk(tree, ())
    return items, calls


_FACTS = "path string, what string, kind string, name string, line_start long, line_end long"


def _facts(files: DataFrame) -> DataFrame:
    """Definitions (``what`` = item) and calls (name calls kind) of Python files, each parsed once."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                items, calls = parse_python(path, text or "")
                rows += [(path, "item", *item) for item in items]
                rows += [(path, "call", callee, caller, None, None) for caller, callee in calls]
            yield pd.DataFrame(rows, columns=["path", "what", "kind", "name", "line_start", "line_end"]).astype({"line_start": "Int64", "line_end": "Int64"})

    return files.select("path", "text").mapInPandas(run, _FACTS)


def parse_files(files: DataFrame) -> DataFrame:
    """path, kind, name, line_start, line_end of the definitions of Python files."""
    return _facts(files).where("what = 'item'").drop("what")


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind, path) and edges (src, dst, kind, confidence) of Python files.

    Files contain their definitions; calls and tests lead to the only function of
    the name in the file, or else anywhere.
    """
    facts = settle(_facts(files), "facts")
    items = facts.where("what = 'item'")
    nodes = items.select(F.col("name").alias("node"), "kind", "path").unionAll(files.select(F.col("path").alias("node"), F.lit("file"), "path"))
    functions = items.where("kind = 'function'").select(F.col("path").alias("file"), F.col("name").alias("node"), F.element_at(F.split("name", "::"), -1).alias("name"))
    calls = facts.where("what = 'call'").select(F.col("path").alias("file"), F.col("name").alias("caller"), F.col("kind").alias("callee")).distinct()
    inside = items.select(F.col("path").alias("src"), F.col("name").alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    called = resolve_calls(calls, functions).select("src", "dst", F.lit("calls").alias("kind"), "confidence")
    tests = calls.join(items.where("kind = 'test'").select(F.col("name").alias("caller")), "caller", "left_semi").withColumnRenamed("caller", "test")
    tested = tests_of_functions(tests, functions).select("src", "dst", F.lit("tested_by").alias("kind"), "confidence")
    return nodes, inside.unionAll(called).unionAll(tested)


def reindex(nodes: DataFrame, present: DataFrame, changed: DataFrame) -> DataFrame:
    """node, path, state after a run: nodes of files that are gone are pruned, of changed files read anew, others kept."""
    fresh = ingest(changed)[0]
    here = present.select("path", F.lit(True).alias("_here"))
    old = nodes.join(changed.select("path"), "path", "left_anti").join(here, "path", "left")
    kept = old.select("node", "path", F.when(F.col("_here"), "kept").otherwise("pruned").alias("state"))
    return kept.unionAll(fresh.select("node", "path", F.lit("indexed")))


#: Words by which a key point counts as a risk, or as out of date.
RISKS, STALE = ("blocked", "risk", "failed"), ("stale", "superseded", "instead")


def summaries(lines: DataFrame, most: int = 5) -> DataFrame:
    """session, first_line, key_points, risks, stale: the first lines with text of each session, and those of them with a marker.

    The points are one text, a line each.  A session without a line that has text has no row.
    """
    kept = first_per(lines.where("line <> ''"), ["session"], ["line_no"], most)
    points = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])  # ``most`` a session
    own = kept.groupBy("session").agg(points.alias("points"))
    of = lambda markers: F.array_join(F.filter("points", lambda x: T.has_any(T.ascii_lower(x), markers)), "\n")
    return own.select("session", F.get("points", 0).alias("first_line"), F.array_join("points", "\n").alias("key_points"), of(RISKS).alias("risks"), of(STALE).alias("stale"))


def search_state(chunks: Column, embedder: Column, reachable: Column, vectors: Column, matching: Column) -> Column:
    """The first thing that stands in the way of a document search, or Searched."""
    ladder = F.when(chunks == 0, "NoDocChunks").when(~embedder, "EmbeddingsNotConfigured").when(~reachable, "EndpointUnavailable")
    return ladder.when(vectors == 0, "NoDocVectors").when(matching == 0, "IndexMismatch").otherwise("Searched")


def doc_search_state(chunks: int, embedder: bool, reachable: bool, vectors: int, matching: int) -> str:
    """The first thing that stands in the way of a document search, or Searched."""
    ladder = (("NoDocChunks", chunks == 0), ("EmbeddingsNotConfigured", not embedder), ("EndpointUnavailable", not reachable), ("NoDocVectors", vectors == 0), ("IndexMismatch", matching == 0))
    return next((name for name, holds in ladder if holds), "Searched")
