"""What a host calls (X4): model changes, assembly of turns, enrichment of the sessions that are due, status."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.config import Settings
from palaver.functions import text as tx
from palaver.functions.enrichment import Enricher, enrich_histories
from palaver.functions.endpoints import HostModel, Services, services
from palaver.operators.folds import enrichment_states
from palaver.plans import assembly as asm

ANSWERS = ["session_id", "turn", "segment_id", "intent_label", "topic_tags", "decisions"]


def due_sessions(events: DataFrame, answers: DataFrame, every: int, on_boundary: bool = True) -> DataFrame:
    """W12 for a batch: (session_id, turn, segment_id) of the sessions whose enrichment is due.

    turn is the number of user messages, segment_id that of the last event.  A session is due *every* so many turns after its
    last answer (session_id, turn, segment_id), or where its segment is another than at that answer; before any answer, than its first.
    """
    at = F.struct("ts", "event_id")
    now = events.groupBy("session_id").agg(
        F.count_if(F.col("type") == "user_message").alias("turn"), F.max_by("segment_id", at).alias("segment_id"), F.min_by("segment_id", at).alias("first")
    )
    last = answers.groupBy("session_id").agg(F.max_by(F.struct("turn", "segment_id"), "turn").alias("last"))
    joined = now.join(last, "session_id", "left")
    by_turns = F.lit(every > 0) & (F.col("turn") - F.greatest(F.coalesce("last.turn", F.lit(0)), F.lit(0)) >= every)
    by_segment = F.lit(on_boundary) & ~F.col("segment_id").eqNullSafe(F.when(F.col("last").isNotNull(), F.col("last.segment_id")).otherwise(F.col("first")))
    return joined.filter((F.col("turn") >= 1) & (by_turns | by_segment)).select("session_id", "turn", "segment_id")


def due_histories(events: DataFrame, due: DataFrame, most_turns: int) -> DataFrame:
    """due with the history of each session: its last events, two a turn, oldest first; sessions that say nothing are left out."""
    order = W.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    kept = events.join(due.select("session_id"), "session_id", "left_semi").withColumn("back", F.row_number().over(order)).filter(F.col("back") <= 2 * most_turns)
    role = F.coalesce("role", "type") if "role" in events.columns else F.col("type")
    lines = kept.select("session_id", "back", tx.format_history_line(role, F.col("content")).alias("line")).filter("line IS NOT NULL")
    listed = lines.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("back", "line")), False).alias("l"))
    return due.join(listed.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("history")), "session_id")


def enrich_due(events: DataFrame, answers: DataFrame, enricher: Enricher | None, settings: Settings) -> DataFrame:
    """New answers (session_id, turn, segment_id, intent_label, topic_tags, decisions), to be added to *answers*.

    Without an enricher, or where enrichment is switched off, none.  A session whose request fails gets no row, so it is due again the next time.
    """
    due = due_sessions(events, answers, settings.enrichment_every, settings.enrichment_boundary)
    if enricher is None or not settings.enrichment_enabled:
        due = due.limit(0)
    asked = enrich_histories(due_histories(events, due, settings.enrichment_turns), enricher)
    return asked.filter("answer IS NOT NULL").select("session_id", "turn", "segment_id", "answer.*").select(*ANSWERS)


class ContextEngine:
    """Settings and services under one roof; data comes and goes as DataFrames.  Services that are passed come before named ones."""

    def __init__(self, settings: Settings | None = None, host: HostModel | None = None, given: Services | None = None):
        self.settings, self.host, self.given = settings or Settings(), host, given
        self.update_model(host)

    def update_model(self, host: HostModel | None) -> None:
        """The host has another model; the budget follows its context length, the enricher its address."""
        self.host = host
        if host and host.context_length > 0:
            self.settings = replace(self.settings, context_length=host.context_length)
        named, given = services(self.settings, host), self.given or Services(None, None, None)
        self.services = Services(given.embedder or named.embedder, given.reranker or named.reranker, given.enricher or named.enricher)

    def should_compress(self, prompt_tokens: int | None = None) -> bool:
        """Every turn is assembled here; sessions within budget pass through unchanged."""
        return True

    def assemble(self, messages: DataFrame, as_of: str, **further) -> DataFrame:
        """:func:`assembly.assemble_turns` with the engine's services."""
        if self.services.embedder is None:
            raise ValueError("no embedder: set embedding_endpoint and embedding_model, or pass one")
        further.setdefault("overhead", self.settings.overhead_start)
        return asm.assemble_turns(messages, self.services.embedder, as_of, self.settings, self.services.reranker, **further)

    def enrich(self, events: DataFrame, answers: DataFrame) -> DataFrame:
        return enrich_due(events, answers, self.services.enricher, self.settings)

    def states(self, answers: DataFrame) -> DataFrame:
        """the enrichment of each session after all its answers."""
        return enrichment_states(answers)

    def status(self, events: DataFrame, vectors: DataFrame) -> DataFrame:
        """One row: what is stored, the budget, and which services are ready."""
        held = events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions"), F.max("ts").alias("last_ts"))
        ready = {k: F.lit(getattr(self.services, k) is not None) for k in ("embedder", "reranker", "enricher")}
        models = vectors.agg(F.count(F.lit(1)).alias("vectors"), F.sort_array(F.collect_set("embedding_model_id")).alias("models"))
        return held.join(models).withColumns({"budget": F.lit(self.settings.budget).cast("long")} | {f"{k}_ready": c for k, c in ready.items()})
