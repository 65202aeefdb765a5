"""Services over HTTP, the enrichment of due sessions, and what a host calls."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from palaver.config import Settings
from palaver.functions import endpoints as ep
from palaver.functions.enrichment import Breaker, HashedEmbedder, embed_column, rerank_groups
from palaver.plans import host as hs


@pytest.fixture(scope="module")
def server():
    """Vectors by length in reverse order, scores by length, and a chat that knows one tag; what was asked is kept."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            answer, code = {}, 200
            if self.path == "/embed":
                answer = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])][::-1]}
            elif self.path == "/short":
                answer = {"data": []}
            elif self.path == "/results":
                answer = {"results": [{"index": 1, "relevance_score": 9.0}, {"index": 7, "score": 1.0}, {"index": 0}]}
            elif self.path == "/scores":
                answer = {"scores": [len(d) for d in body["documents"]]}
            elif self.path == "/odd":
                answer = {"ranking": []}
            elif self.path == "/v1/chat/completions" and "refuse" not in body["messages"][1]["content"]:
                told = {"intent_label": "topic", "topic_tags": ["A "], "decisions": [{"decision": "d", "rationale": "r"}]}
                answer = {"choices": [{"message": {"content": "Here it is: " + json.dumps(told)}}]}
            else:
                code = 500
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *args):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}", seen
    running.shutdown()


def test_embedding_endpoint(spark, server):
    url, seen = server
    client = ep.EndpointEmbedder(url + "/embed", "m", "secret")
    assert client.embed(["a", "abc"]) == [[1.0, 1.0], [3.0, 1.0]] and "secret" not in repr(client)
    assert seen[-1] == ("/embed", "Bearer secret", {"model": "m", "input": ["a", "abc"]})
    rows = spark.createDataFrame([(1, "ab"), (2, " "), (3, None), (4, "abcd")], "id int, t string")
    got = {r.id: r.v for r in rows.select("id", embed_column(client)(F.col("t")).alias("v")).collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: None, 4: [4.0, 1.0]}


def test_failing_embedding_endpoint_opens_the_breaker(server):
    url, seen = server
    guarded = Breaker(ep.EndpointEmbedder(url + "/short", "m"), failures=2, clock=lambda: 0.0)
    asked = len(seen)
    assert [guarded.embed(["x"]) for _ in range(4)] == [[None]] * 4
    assert len(seen) - asked == 2


def test_reranking_endpoint(spark, server):
    url, _ = server
    client = lambda path: ep.EndpointReranker(url + path, "rerank", timeout=5.0)
    assert client("/results").rerank("q", ["a", "b"]) == [None, 9.0]
    assert client("/scores").rerank("q", ["a", "bcd"]) == [1.0, 3.0]
    assert client("/odd").rerank("q", ["a"]) is None and client("/none").rerank("q", ["a"]) is None
    assert ep.EndpointReranker("http://127.0.0.1:9/", "m", timeout=1.0).rerank("q", ["a"]) is None
    rows = spark.createDataFrame([(1, "q", 1, "aaaa", 0.1), (1, "q", 2, "b", 0.9), (1, "q", 3, None, 0.5)], "query_id int, query_text string, event_id int, content string, score double")
    got = rerank_groups(rows, client("/scores"), 2).orderBy(F.col("score").desc()).collect()
    assert [(r.event_id, r.score) for r in got] == [(1, 4.0), (2, 1.0)]
    assert {(r.event_id, r.score) for r in rerank_groups(rows, client("/odd")).collect()} == {(1, 0.1), (2, 0.9), (3, 0.5)}


def test_services_come_from_settings_then_host(server):
    url, _ = server
    assert ep.services(Settings()) == ep.Services(None, None, None)
    host = ep.HostModel("big", 1000, url + "/v1", "k")
    assert ep.enricher_service(Settings(enricher_model="own"), host) == (url + "/v1", "own", "k")
    assert ep.services(Settings(), host).enricher.url == url + "/v1/chat/completions"
    assert ep.services(Settings(enrichment_enabled=False), host).enricher is None
    assert ep.services(Settings(reranker_endpoint="http://r", reranker_enabled=False)).reranker is None
    assert [ep.chat_url(u) for u in ("http://a/", "http://a/v1", "http://a/v1/chat/completions")] == ["http://a/v1/chat/completions"] * 3



def log_of(spark, sessions):
    """sessions: id to (type, segment, content) in order."""
    rows = [(s, i, i, *e) for s, events in sessions.items() for i, e in enumerate(events)]
    frame = spark.createDataFrame(rows, "session_id string, event_id int, at int, type string, segment_id string, content string")
    return frame.withColumn("ts", F.timestamp_seconds("at")).drop("at")


def turns(n, segment="s1", text="hello"):
    return [("user_message", segment, f"{text} {i}") for i in range(n)]


GIVEN = "session_id string, turn long, segment_id string"


def test_due_sessions(spark):
    log = log_of(spark, {
        "early": turns(4), "late": turns(5), "answered": turns(7), "again": turns(8), "cut": turns(1) + turns(1, "s2"),
        "seen": turns(1) + turns(1, "s2"), "silent": [("tool_output", "s1", "x")] * 9, "moved": turns(3) + turns(1, "s2"),
    })
    answers = spark.createDataFrame([("answered", 3, "s1"), ("again", 1, "s1"), ("again", 3, "s1"), ("seen", 2, "s2"), ("moved", 3, "s1"), ("elsewhere", 1, "s1")], GIVEN)
    got = {(r.session_id, r.turn) for r in hs.due_sessions(log, answers, 5).collect()}
    assert got == {("late", 5), ("again", 8), ("cut", 2), ("moved", 4)}
    assert {r.session_id for r in hs.due_sessions(log, answers, 5, on_boundary=False).collect()} == {"late", "again"}
    assert {r.session_id for r in hs.due_sessions(log, answers, 0).collect()} == {"cut", "moved"}
    assert hs.due_sessions(log.limit(0), answers, 5).count() == 0


def test_enrichment_of_due_sessions(spark, server):
    url, seen = server
    log = log_of(spark, {"a": turns(6), "b": turns(6, text="refuse"), "c": turns(2), "d": [("user_message", "s1", " ")] * 6})
    none = spark.createDataFrame([], GIVEN)
    engine = hs.ContextEngine(Settings(enrichment_turns=2), ep.HostModel("m", 0, url))
    answers = engine.enrich(log, none).collect()
    assert [(r.session_id, r.turn, r.segment_id, r.intent_label, r.topic_tags) for r in answers] == [("a", 6, "s1", "topic", ["a"])]
    asked = [b["messages"][1]["content"] for p, _, b in seen if p == "/v1/chat/completions"]
    assert any(t.endswith("Conversation:\n" + "\n".join(f"[user_message] hello {i}" for i in range(2, 6))) for t in asked)
    held = spark.createDataFrame(answers)
    # answered: not due again; the one that was refused is
    assert {r.session_id for r in hs.due_sessions(log, held, 5).collect()} == {"b", "d"}
    (state,) = engine.states(held).collect()
    assert (state.intent_label, state.decision_summary) == ("topic", "d")
    off = hs.ContextEngine(Settings(enrichment_enabled=False), ep.HostModel("m", 0, url))
    assert off.enrich(log, none).count() == 0


def test_host_calls(spark):
    engine = hs.ContextEngine(given=ep.Services(HashedEmbedder(), None, None))
    assert engine.should_compress(5) and engine.services.enricher is None
    engine.update_model(ep.HostModel("m", 1000, "http://h"))
    assert engine.settings.budget == 700 and engine.services.enricher.model == "m" and engine.services.embedder is not None
    log = log_of(spark, {"a": turns(2), "b": turns(1)})
    vectors = spark.createDataFrame([("old",), ("new",), ("new",)], "embedding_model_id string")
    (s,) = engine.status(log, vectors).collect()
    assert (s.events, s.sessions, s.vectors, s.models, s.budget) == (3, 2, 3, ["new", "old"], 700)
    assert (s.embedder_ready, s.reranker_ready, s.enricher_ready) == (True, False, True)
    messages = spark.createDataFrame([("a", 0, 0, "user", "hi")], "session_id string, msg_index int, at int, role string, content string")
    messages = messages.withColumn("ts", F.timestamp_seconds("at")).drop("at")
    with pytest.raises(ValueError):
        hs.ContextEngine().assemble(messages, "2024-01-01")
    (r,) = engine.assemble(messages, "2024-01-01", overhead=0).collect()
    assert (r.role, r.content) == ("user", "hi")
