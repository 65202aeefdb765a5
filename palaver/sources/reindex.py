"""Embedding a log anew under another model.

Vectors are a :class:`BucketTable` by event.  A run goes through the buckets, some at a time, and writes each as one
version: vectors of the target model as they are, vectors of other models replaced by new ones of their events, and events
with text that had no vector.  A run that was cut short is started again with its number and goes on with the buckets that
it had not written; until then readers see each bucket either whole under the old models or whole under the new one.  A
bucket without anything stale is not written at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.enrichment import Embedder, embed_events
from palaver.functions.text import embeddable
from palaver.sources.buckets import BucketTable
from palaver.sources.messages import reindex_rows

VECTOR_COLUMNS = ["event_id", "session_id", "segment_id", "type", "token_count", "embedding", "embedding_model_id"]


def changed_buckets(table: BucketTable, events: DataFrame, of: dict[int, int], due: list[int], model: str) -> list[int]:
    """Those of the *due* buckets that hold vectors of other models or lack some; ids and models alone are read, texts for their length."""
    mine = events.filter(table.bucket().isin(due))
    old = table.read(of)
    if old is None:
        changed = mine.filter(embeddable(F.col("content"))).select("event_id")
    else:
        old = old.select("event_id", "embedding_model_id")
        changed = reindex_rows(mine, old, model).select("event_id").unionByName(old.filter(F.col("embedding_model_id") != model).select("event_id"))
    return sorted(r[0] for r in changed.select(table.bucket().alias("b")).distinct().collect())  # of the table's buckets


def reembed(table: BucketTable, events: DataFrame, embedder: Embedder, model: str, run: int, at_once: int = 8) -> list[int]:
    """Bring *table* to one model; returns the buckets that this call wrote.  Runs have growing numbers; a repeated run has the same one.

    Events are read once to find what is due and once more for each *at_once* buckets that are written: hand on a table, or a view
    that is written down, and not one that is costly to compute.
    """
    known, written = table.newest(), []
    due = [b for b in range(table.buckets) if known.get(b, -1) < run]
    if not due:
        return []
    todo = changed_buckets(table, events, {b: known[b] for b in due if b in known}, due, model)
    for at in range(0, len(todo), at_once):
        group = todo[at : at + at_once]
        mine = events.filter(table.bucket().isin(group))
        old = table.read({b: known[b] for b in group if b in known})
        new = embed_events(mine if old is None else reindex_rows(mine, old, model), embedder, model).select(*VECTOR_COLUMNS)
        if old is not None:
            new = old.filter(F.col("embedding_model_id") == model).select(*VECTOR_COLUMNS).unionByName(new)
        table.write(new, run)
        written += group
    now = table.newest()
    return [b for b in written if now.get(b) == run]
