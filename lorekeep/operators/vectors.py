"""The vector index kept up to date: only changed texts are embedded, failures leave a trace and nothing else."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import settle

Embedder = Callable[[list[str]], list]


def _answers(embedder: Embedder, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """A vector or an error for each text; after a failed call the texts are tried one by one."""
    try:
        got = embedder(texts)
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
    except Exception as e:  # whatever the service raises belongs to the record
        if len(texts) == 1:
            return [(None, str(e) or type(e).__name__)]
        return [x for t in texts for x in _answers(embedder, [t])]
    return [([float(x) for x in v], None) if v is not None and len(v) else (None, "no vector") for v in got]


def refreshed(stored: DataFrame, subjects: DataFrame, embedder: Embedder, model: str, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(vectors, audit) after the subjects' texts have been brought up to date.

    ``stored``: kind, id, fingerprint, model, dimensions, vector; ``subjects``: kind, id, text,
    each once.  A text whose fingerprint is stored isn't embedded again.  New vectors
    replace those of their subject; where the embedder fails the old one stays.  ``audit``
    has a row for each call: kind, id, ok, error.  Null texts count as empty; rows of other
    subjects stay as they are.
    """
    own = subjects.select("kind", "id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fingerprint", F.md5(F.col("text").cast("binary")))
    due = own.join(stored.select("kind", "id", "fingerprint"), ["kind", "id", "fingerprint"], "left_anti")
    id_type = due.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(0, len(part), batch):
                now = part.iloc[i : i + batch]
                answers = _answers(embedder, now["text"].to_list())
                yield pd.DataFrame({"kind": now["kind"], "id": now["id"], "fingerprint": now["fingerprint"], "vector": [v for v, _ in answers], "error": [e for _, e in answers]})

    # written once: the vectors and the audit stand on the same answers
    told = settle(due.mapInPandas(run, f"kind string, id {id_type}, fingerprint string, vector array<double>, error string"), "answers")
    new = told.where("vector is not null").select("kind", "id", "fingerprint", F.lit(model).alias("model"), F.size("vector").cast("long").alias("dimensions"), "vector")
    kept = stored.join(new.select("kind", "id"), ["kind", "id"], "left_anti")
    audit = told.select("kind", "id", F.col("error").isNull().alias("ok"), "error")
    return kept.select(*new.columns).unionByName(new), audit
