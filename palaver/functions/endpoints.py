"""Services behind the plug-in points (X1-X3): embedding, reranking and enrichment endpoints over HTTP.

A client holds plain settings and is shipped to tasks as it is.  A task waits for one request at a time and a request
carries a batch of texts, so as many requests are under way as tasks that call the service; fewer partitions mean fewer of them.
"""

from __future__ import annotations

import json
import logging
import urllib.request
from dataclasses import dataclass, field

from palaver.config import Settings
from palaver.functions.enrichment import Breaker, Embedder, Enricher, Reranker

log = logging.getLogger(__name__)

INSTRUCTION = "You answer with one JSON object and nothing else."
REQUEST = """Read the end of a conversation and return a JSON object with these fields:
intent_label: what the user is working on, in a few words
topic_tags: up to 6 short lower-case tags
decisions: up to 5 objects with the fields decision and rationale, for what was decided; empty where nothing was

Conversation:
"""


@dataclass(frozen=True)
class HostModel:
    """What the host says of its own model (X4): the enricher's fallback and the context length."""

    model: str = ""
    context_length: int = 0
    base_url: str = ""
    key: str = field(default="", repr=False)


@dataclass(frozen=True)
class Endpoint:
    url: str
    model: str
    key: str = field(default="", repr=False)
    timeout: float = 60.0

    def post(self, body: dict):
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)


@dataclass(frozen=True)
class EndpointEmbedder(Endpoint):
    """{model, input} to {data: [{embedding, index?}]}.  A failure or a wrong number of vectors raises, so that a breaker counts it."""

    def embed(self, texts):
        items = self.post({"model": self.model, "input": texts}).get("data") or []
        if len(items) != len(texts):
            raise ValueError(f"{len(items)} vectors for {len(texts)} texts")
        if all(isinstance(i.get("index"), int) for i in items):
            items = sorted(items, key=lambda i: i["index"])
        return [i.get("embedding") for i in items]


@dataclass(frozen=True)
class EndpointReranker(Endpoint):
    """{model, query, documents} to {results: [{index, relevance_score or score}]} or {scores: [...]}.

    Texts without a score keep the one that they have; a failure or an answer of another shape leaves all as they are.
    """

    def rerank(self, query, texts):
        try:
            answer = self.post({"model": self.model, "query": query, "documents": texts})
            scores: list[float | None] = [None] * len(texts)
            if isinstance(answer.get("results"), list):
                given = [(r.get("index"), r.get("relevance_score", r.get("score"))) for r in answer["results"]]
            elif isinstance(answer.get("scores"), list):
                given = list(enumerate(answer["scores"]))
            else:
                return None
            for i, score in given:
                if isinstance(i, int) and 0 <= i < len(texts) and score is not None:
                    scores[i] = float(score)
            return scores
        except Exception as problem:  # an external service: reranking may better an order, which stands without it
            log.warning("reranker: %s", problem)
            return None


@dataclass(frozen=True)
class EndpointEnricher(Endpoint):
    """A chat completion over the history; no answer gives None, and the state stays as it is."""

    tokens: int = 1500

    def enrich(self, history):
        said = [{"role": "system", "content": INSTRUCTION}, {"role": "user", "content": REQUEST + history}]
        try:
            answer = self.post({"model": self.model, "messages": said, "temperature": 0.0, "max_tokens": self.tokens})
            return answer["choices"][0]["message"]["content"]
        except Exception as problem:  # an external service
            log.warning("enricher: %s", problem)
            return None


def chat_url(base: str) -> str:
    """The address of chat completions, from that of the service, its version or the whole one."""
    base = base.rstrip("/")
    if base.endswith("/chat/completions"):
        return base
    return base + ("/chat/completions" if "/v1" in base else "/v1/chat/completions")


def enricher_service(settings: Settings, host: HostModel | None = None) -> tuple[str, str, str]:
    """(address, model, key): each from the settings, or else from the host's model."""
    host = host or HostModel()
    return settings.enricher_endpoint or host.base_url, settings.enricher_model or host.model, settings.enricher_key or host.key


@dataclass(frozen=True)
class Services:
    embedder: Embedder | None
    reranker: Reranker | None
    enricher: Enricher | None


def services(settings: Settings, host: HostModel | None = None) -> Services:
    """The services that settings and host name; None stands for one that is not named or switched off."""
    embedder = reranker = enricher = None
    if settings.embedding_endpoint and settings.embedding_model:
        embedder = Breaker(EndpointEmbedder(settings.embedding_endpoint, settings.embedding_model, settings.embedding_key, settings.embedding_timeout))
    if settings.reranker_enabled and settings.reranker_endpoint:
        reranker = EndpointReranker(settings.reranker_endpoint, settings.reranker_model or "rerank", settings.reranker_key, settings.reranker_timeout)
    base, model, key = enricher_service(settings, host)
    if settings.enrichment_enabled and base and model:
        enricher = EndpointEnricher(chat_url(base), model, key, settings.enricher_timeout, settings.enricher_tokens)
    return Services(embedder, reranker, enricher)
