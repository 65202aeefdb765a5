"""Enrichment and plug-in points (F11-F13, X1-X4, V8): protocols with deterministic offline defaults."""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver import schemas as S
from palaver.functions.text import embeddable, summarize


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: list[str]) -> list[float | None] | None: ...


class Enricher(Protocol):
    def enrich(self, history: str) -> str | None: ...


def crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


CRC = crc_table()


def trigram_hashes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, CRC-32 of its UTF-8) of every run of three characters within a piece; pieces have three or more."""
    raw = np.frombuffer("".join(pieces).encode(), np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    sizes = np.array([len(p) for p in pieces])
    inside, ends = np.ones(len(starts) - 1, bool), np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    first = np.flatnonzero(inside)
    at, size = starts[first], starts[first + 3] - starts[first]
    crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
    for k in range(int(size.max(initial=0))):
        on = slice(None) if k < 3 else np.flatnonzero(size > k)
        crc[on] = CRC[(crc[on] ^ raw[at[on] + k]) & 0xFF] ^ (crc[on] >> 8)
    return np.repeat(np.arange(len(pieces)), sizes)[first], ~crc


class HashedEmbedder:
    """Character trigrams hashed into a unit vector."""

    #: Texts that are handed over at once, and characters that are hashed at once.
    batch, block = 256, 1 << 16

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts):
        counts = np.zeros((len(texts), self.dim))
        rows: list[int] = []
        pieces: list[str] = []
        held = 0
        for row, t in enumerate(texts):
            low = f" {t.lower()} "
            for at in range(0, len(low) - 2, self.block):
                rows.append(row)
                pieces.append(low[at : at + self.block + 2])
                held += len(pieces[-1])
                if held >= self.block:
                    self.count(counts, rows, pieces)
                    rows, pieces, held = [], [], 0
        if pieces:
            self.count(counts, rows, pieces)
        norms = np.sqrt((counts * counts).sum(axis=1))
        units = (counts / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
        return [u.tolist() if n else None for u, n in zip(units, norms, strict=True)]

    def count(self, counts: np.ndarray, rows: list[int], pieces: list[str]) -> None:
        of, h = trigram_hashes(pieces)
        cells = (np.array(rows)[of] - rows[0]) * self.dim + h % self.dim
        got = np.bincount(cells, np.where(h & 0x10000, 1.0, -1.0), (rows[-1] - rows[0] + 1) * self.dim)
        counts[rows[0] : rows[-1] + 1] += got.reshape(-1, self.dim)


class OverlapReranker:
    """The share of the query's words that a text holds."""

    def rerank(self, query, texts):
        words = set(query.lower().split())
        return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]


class Breaker:
    """V8: after 3 failures calls are skipped for 300 s, then one is tried."""

    def __init__(self, inner: Embedder, failures: int = 3, pause: float = 300.0, clock=time.monotonic):
        self.inner, self.most, self.pause, self.clock = inner, failures, pause, clock
        self.failed, self.until = 0, 0.0

    def embed(self, texts):
        if self.failed >= self.most and self.clock() < self.until:
            return [None] * len(texts)
        try:
            out = self.inner.embed(texts)
            self.failed = 0
            return out
        except Exception:  # an external service: a failure yields no vectors, and the breaker counts it
            self.failed += 1
            self.until = self.clock() + self.pause
            return [None] * len(texts)


def floats(vector) -> np.ndarray | list | None:
    """A vector in four bytes a number; one with gaps as it is."""
    return vector if vector is None or any(x is None for x in vector) else np.asarray(vector, np.float32)


def embed_column(embedder: Embedder, batch: int = 16, rows: int = 1024):
    """A vectorised function from text to vector; blank texts give null.

    So many texts are handed over at once, or as many as an embedder of no service names as its ``batch``; a task hands on *rows* vectors at a time
    and holds no more.  The function counts as not deterministic, as services are: a filter on its result then stays behind it, instead of
    running it once more in a second worker of each task.
    """
    batch = getattr(embedder, "batch", batch)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for whole in texts:
            for start in range(0, max(1, len(whole)), rows):
                s = whole.iloc[start : start + rows]
                filled = [i for i, t in enumerate(s) if isinstance(t, str) and t.strip()]
                out: list = [None] * len(s)
                for at in range(0, len(filled), batch):
                    part = filled[at : at + batch]
                    for i, v in zip(part, embedder.embed([s.iloc[i] for i in part]), strict=True):
                        out[i] = floats(v)
                yield pd.Series(out, dtype=object)

    return run.asNondeterministic()


def embed_events(events: DataFrame, embedder: Embedder, model: str, threshold: int = S.SUMMARY_THRESHOLD, summary: int = S.SUMMARY_TOKENS) -> DataFrame:
    """Vectors of embeddable events (P4), long tool outputs as their summary (F10); null vectors are not stored."""
    said = F.when(F.col("type") == "tool_output", summarize(F.col("content"), threshold, summary)).otherwise(F.col("content"))
    some = events.filter(embeddable(F.col("content")))
    rows = some.select("event_id", "session_id", "segment_id", "type", F.col("token_estimate").alias("token_count"), embed_column(embedder)(said).alias("embedding"))
    return rows.filter("embedding IS NOT NULL").withColumn("embedding_model_id", F.lit(model))


def rerank_groups(candidates: DataFrame, reranker: Reranker, k: int | None = None, clip: int = 2000) -> DataFrame:
    """Candidates (query_id, query_text, event_id, content, score) with the reranker's score where it gives one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "event_id"], ascending=[False, True])
        scores = reranker.rerank(pdf["query_text"].iloc[0], [str(c or "")[:clip] for c in pdf["content"]])
        if scores is not None:
            pdf = pdf.assign(score=[o if n is None else float(n) for o, n in zip(pdf["score"], scores, strict=True)])
        pdf = pdf.sort_values(["score", "event_id"], ascending=[False, True])
        return pdf.head(k) if k else pdf

    return candidates.groupBy("query_id").applyInPandas(run, candidates.schema)


# -- tolerant JSON --------------------------------------------------------------------------------


def parse_json(text: str | None):
    """the text itself, its first object, or a cut object with its open parts closed; None otherwise."""
    body = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip())
    first = body.find("{")
    tries = [body]
    if first >= 0:
        tries += [body[first : body.rfind("}") + 1], close_json(body[first:])]
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


_PARTS = re.compile(r'"(?:[^"\\]|\\.)*(?P<end>"?)|[{}\[\]]', re.S)
_CLOSER = {"{": "}", "[": "]"}


def close_json(text: str) -> str:
    """The text with an open string and all open brackets closed, without a dangling comma or colon."""
    waiting: list[str] = []
    in_string = False
    for m in _PARTS.finditer(text):
        part = m.group()
        if part[0] == '"':
            in_string = m["end"] == ""
        elif part in _CLOSER:
            waiting.append(_CLOSER[part])
        elif waiting and waiting[-1] == part:
            waiting.pop()
    text += '"' if in_string else ""
    return text.rstrip(",: \t\r\n") + "".join(reversed(waiting))


@F.pandas_udf(T.StringType())
def recover_json(texts: pd.Series) -> pd.Series:
    """What is not JSON as it stands: the recovered object as JSON text."""

    def one(text):
        found = parse_json(text) if isinstance(text, str) else None
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None

    return texts.map(one).astype(object)


def parse_json_text(text: Column) -> Column:
    """F11 for a column: the object as JSON text; only what the JVM's parser refuses goes to Python."""
    whole = F.startswith(F.trim(text), F.lit("{")) & F.try_parse_json(text).isNotNull()
    whole = F.coalesce(whole, F.lit(False))
    return F.when(whole, text).otherwise(recover_json(F.when(~whole, text)))


ANSWER = "struct<intent_label:string,topic_tags:array<string>,decisions:array<struct<decision:string,rationale:string>>>"


def normalize_answer(answer: Column) -> Column:
    """lower-cased tags (6 at most) and decisions that say something (5 at most)."""
    trim = lambda c: F.trim(F.coalesce(c, F.lit("")))
    none_tags, none_decisions = F.array().cast("array<string>"), F.array().cast("array<struct<decision:string,rationale:string>>")
    tags = F.filter(F.transform(F.coalesce(answer["topic_tags"], none_tags), lambda t: F.lower(trim(t))), lambda t: t != "")
    made = F.filter(F.coalesce(answer["decisions"], none_decisions), lambda d: F.coalesce(d["decision"], F.lit("")) != "")
    tidy = F.transform(made, lambda d: F.struct(trim(d["decision"]).alias("decision"), trim(d["rationale"]).alias("rationale")))
    label = F.when(F.coalesce(answer["intent_label"], F.lit("")) != "", answer["intent_label"])
    return F.struct(label.alias("intent_label"), F.slice(tags, 1, 6).alias("topic_tags"), F.slice(tidy, 1, 5).alias("decisions"))


def merge_answer(state: DataFrame, answer: str = "answer") -> DataFrame:
    """label and tags where given; the last 5 different decisions; the last one as summary."""
    a = F.col(answer)
    stack = F.concat(F.coalesce("decision_stack", F.array().cast("array<struct<decision:string,rationale:string>>")), a["decisions"])
    # of equal decisions the first place counts
    stack = F.array_distinct(stack)
    last = F.when(F.size(stack) > 5, F.slice(stack, -5, 5)).otherwise(stack)
    return state.withColumns(
        {
            "intent_label": F.coalesce(a["intent_label"], F.col("intent_label")),
            "topic_tags": F.when(F.size(a["topic_tags"]) > 0, a["topic_tags"]).otherwise(F.col("topic_tags")),
            "decision_stack": last,
            "decision_summary": F.when(F.size(a["decisions"]) > 0, F.element_at(a["decisions"], -1)["decision"]).otherwise(F.col("decision_summary")),
        }
    )


def enrich_histories(histories: DataFrame, enricher: Enricher) -> DataFrame:
    """(session_id, history) to a normalised answer; no answer gives null."""

    @F.pandas_udf("string")
    def ask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: enricher.enrich(t) if isinstance(t, str) and t.strip() else None)

    raw = histories.withColumn("raw", ask("history")).withColumn("raw", parse_json_text(F.col("raw")))
    return raw.withColumn("answer", F.when(F.col("raw").isNotNull(), normalize_answer(F.from_json("raw", ANSWER)))).drop("raw")
