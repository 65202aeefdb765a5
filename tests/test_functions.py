"""Functions and operators on literals, and packing against a plain model."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.config import load_settings
from palaver.functions import enrichment as enr
from palaver.functions import text as tx
from palaver.functions import vector as vc
from palaver.operators import budget as bd
from palaver.operators import graph as gr
from palaver.operators import retrieval as rt
from palaver.operators import sessions as ss
from palaver.operators import state as st
from palaver.operators import timeline as tl
from palaver.plans.tools import MemoryTools
from palaver.sources import fixtures as fx
from palaver.sources import messages as ms


def values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_mode_weights_sum_to_one():
    assert all(abs(sum(w) - 1) < 1e-9 for w in S.MODE_WEIGHTS.values())


def test_questions(spark):
    rows = ["Is it done", "it is done", "Really?", "", None, "  Why, though", "(How) come", "почему так", "ШТО это", "What's up"]
    assert values(spark, tx.is_question(F.col("t")), rows) == [True, False, True, False, False, True, True, True, False, False]


def test_entities(spark):
    rows = ['Use `foo.bar` and "the plan" with Alice, alice and Bob_2', "The And", None, "Ёлка и Москва"]
    assert values(spark, tx.entities(F.col("t")), rows) == [["foo.bar", "the plan", "Use", "Alice", "Bob_2"], [], [], ["Ёлка", "Москва"]]


def test_switch_and_intent(spark):
    assert values(spark, tx.is_switch(F.col("t")), ["OK, New Topic please", "ДАВАЙ переключимся", "news", None]) == [True, True, False, False]
    df = spark.createDataFrame([(True, 0.9, True), (False, 0.9, True), (False, 0.2, True), (False, 0.2, False)], "s boolean, d double, q boolean")
    got = [r[0] for r in df.select(tx.intent(F.col("s"), F.lit(False), F.col("d"), F.col("q"))).collect()]
    assert got == ["SWITCH", "NEW_TASK", "CLARIFICATION", "CONTINUATION"]


def test_contradiction_and_output_question(spark):
    df = spark.createDataFrame([("drop the Foo note", ["foo"]), ("keep foo", ["foo"]), ("why foo", ["FOO"])], "t string, e array<string>")
    got = df.select(tx.contradicts(F.col("t"), F.col("e")), tx.asks_about(F.col("t"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True)]


def test_modes(spark):
    df = spark.createDataFrame(
        [("a Traceback here", None), ("is this wrong", "Bash"), ("is this wrong", "edit"), ("why not", None), ("x" * 501, None), ("show me it", None), ("hm", None)], "t string, l string"
    )
    got = [r[0] for r in df.select(tx.mode(F.col("t"), F.col("l"))).collect()]
    assert got == ["debugging", "debugging", "general", "reasoning", "reasoning", "factual", "general"]


def test_envelope_is_stripped(spark):
    rows = ["[RETRIEVED CONTEXT]\nold\n\nnew question", "[RETRIEVED CONTEXT]\nonly old", "plain", None]
    assert values(spark, tx.clean_message(F.col("t")), rows) == ["new question", "", "plain", ""]


def test_query_text(spark):
    df = spark.createDataFrame([("g", "", "s", ["A", "B"], "m", "CLARIFICATION", "f"), ("", "", "", [], " ", "CONTINUATION", "last")], "g string, c string, s string, e array<string>, m string, i string, f string")
    got = [r[0] for r in df.select(tx.query_text(*map(F.col, "gcsemif"))).collect()]
    assert got == ["g s A B m", "last"]


def test_summary_has_head_and_tail(spark):
    (got,) = values(spark, tx.summarize(F.col("t")), ["a" * 3000 + "b" * 1000])
    assert got == "a" * 200 + "\n...[truncated 3600 chars]...\n" + "b" * 200


def test_parse_messages(spark):
    rows = [
        ("s", 0, "user", "hello there", None, None),
        ("s", 1, "assistant", "ignored text!", None, [("1", ("web", '{"q": 1}')), ("2", ("calc", None))]),
        ("s", 2, "tool", "out", "web", None),
        ("s", 3, "assistant", "done", None, None),
        ("s", 4, "system", "no event", None, None),
    ]
    got = ms.parse_messages(spark.createDataFrame(rows, S.MESSAGES)).orderBy("msg_index", "sub_index").collect()
    assert [(r.type, r.tool_name) for r in got] == [("user_message", None), ("tool_call", "web"), ("tool_call", "calc"), ("tool_output", "web"), ("assistant_message", None)]
    assert [r.token_estimate for r in got] == [2, 1, 1, 0, 1] and len({r.event_id for r in got}) == 5
    assert json.loads(got[1].content) == {"name": "web", "arguments": '{"q": 1}'} and got[2].tool_input == "{}"


def test_cosine_skips_zero_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(F.round(vc.cosine(F.col("a"), F.col("b")), 6)).collect()]
    assert got == [0.0, 1.0, None]


def test_no_drift_without_a_centroid(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], [-1.0, 0.0]), (3, [0.0, 0.0], [1.0, 0.0]), (4, [1.0, 0.0], [1.0, 0.0])], "i int, v array<double>, c array<double>")
    assert {r.i: r.d for r in rows.select("i", vc.drift(F.col("v"), F.col("c")).alias("d")).collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0}


def test_centroid_needs_three(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0])] * 2 + [("b", [float(i), 0.0]) for i in range(3)], "k string, embedding array<float>")
    got = {r.k: r.centroid for r in vc.centroids(df, ["k"]).collect()}
    assert got == {"a": None, "b": [1.0, 0.0]}


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1]}\n```', {"a": [1]}), ('sure: {"a": 2} ok', {"a": 2}), ('{"label": "cut off te', {"label": "cut off te"}),
        ('{"a": {"b": ["x", "y"], ', {"a": {"b": ["x", "y"]}}), ('{"a": "q\\"', {"a": 'q"'}), ("none", None), ("", None), (None, None),
    ],
)
def test_tolerant_json(text, want):
    assert enr.parse_json(text) == want


def test_answers_are_normalized_and_merged(spark):
    class Fixed:
        def enrich(self, history):
            return '{"intent_label": "build", "topic_tags": [" A ", "", "b"], "decisions": [{"decision": " d1 "}, {"rationale": "x"}, {"decision": "d2", "rationale": "r"}]' if history != "no" else "nothing"

    df = spark.createDataFrame([("s", "h"), ("t", "no")], "session_id string, history string")
    got = {r.session_id: r.answer for r in enr.enrich_histories(df, Fixed()).collect()}
    assert got["t"] is None and got["s"].topic_tags == ["a", "b"] and [d.decision for d in got["s"].decisions] == ["d1", "d2"]
    state = spark.createDataFrame([("old", ["z"], [(f"d{i}", "") for i in range(5)], None)], "intent_label string, topic_tags array<string>, decision_stack array<struct<decision:string,rationale:string>>, decision_summary string")
    answer = spark.createDataFrame([(("new", [], [("d4", ""), ("d9", "")]),)], "answer struct<intent_label:string,topic_tags:array<string>,decisions:array<struct<decision:string,rationale:string>>>")
    (row,) = enr.merge_answer(state.crossJoin(answer)).collect()
    assert (row.intent_label, row.topic_tags, row.decision_summary) == ("new", ["z"], "d9")
    assert [d.decision for d in row.decision_stack] == ["d1", "d2", "d3", "d4", "d9"]


def test_names_are_extracted_once(spark):
    """Extraction stood inside the lambda that removes repeats, so it was run again for every name."""
    text = " ".join(f"Name{i % 40} NAME{i % 40} `code {i}`" for i in range(60))
    df = spark.createDataFrame([(text,), (None,), ("",), ("Only Alpha and alpha, ALPHA",)], "t string").select(tx.entities(F.col("t")).alias("e"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 4
    got = [r.e for r in df.collect()]
    assert got[0] == [f"code {i}" for i in range(30)] and got[1:3] == [[], []] and got[3].count("Alpha") == 1 and "ALPHA" not in got[3]


def test_hashed_vectors_equal_the_plain_form(monkeypatch):
    import zlib

    import numpy as np

    def plain(t, dim):
        v, low = np.zeros(dim), f" {t.lower()} "
        for i in range(len(low) - 2):
            h = zlib.crc32(low[i : i + 3].encode())
            v[h % dim] += 1 if h & 0x10000 else -1
        n = np.linalg.norm(v)
        return (v / n).astype(np.float32).tolist() if n else None

    rng = random.Random(5)
    texts = ["", "a", "ab", "\u0130stanbul \U0001f600\U0001f600\U0001f601 \u4e2d\u6587", "x" * 500] + ["".join(rng.choice("ab \u00e9\u20ac\U0001f600Z") for _ in range(rng.randrange(300))) for _ in range(60)]
    for block in (7, 1 << 16):
        monkeypatch.setattr(enr.HashedEmbedder, "block", block)
        for dim in (8, 64):
            assert enr.HashedEmbedder(dim).embed(texts) == [plain(t, dim) for t in texts]
    assert enr.HashedEmbedder().embed([]) == []


def test_a_text_is_embedded_once(spark):
    """The filter on the vectors stays behind the function that makes them, and vectors are handed on in bounded pieces."""
    df = spark.range(3000).select(F.col("id").alias("event_id"), F.lit("s").alias("session_id"), F.lit("g").alias("segment_id"), F.lit("user_message").alias("type"),
        F.concat(F.lit("some text "), F.col("id")).alias("content"), F.lit(1).alias("token_estimate")).coalesce(1)
    rows = enr.embed_events(df, enr.HashedEmbedder(), "m")
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.event_id: r.embedding for r in rows.collect()}
    assert len(got) == 3000 and all(got[i] == enr.HashedEmbedder().embed([f"some text {i}"])[0] for i in (0, 1023, 1024, 2999))
    seen: list = []

    class Gaps:
        def embed(self, texts):
            seen.append(len(texts))
            return [[1.0, None] if t == "some text 1" else [0.5] for t in texts]

    import pandas as pd

    pieces = list(enr.embed_column(Gaps()).func(iter([pd.Series([f"some text {i}" for i in range(2500)])])))
    assert [len(p) for p in pieces] == [1024, 1024, 452] and max(seen) == 16 and pieces[0][1] == [1.0, None]


def test_embedder_and_breaker(spark):
    df = spark.createDataFrame([("hello world",), (" ",), (None,)], "t string")
    got = [r[0] for r in df.select(enr.embed_column(enr.HashedEmbedder())(F.col("t"))).collect()]
    assert len(got[0]) == 64 and got[1:] == [None, None]

    class Down:
        calls = 0

        def embed(self, texts):
            Down.calls += 1
            raise OSError("down")

    now = [0.0]
    b = enr.Breaker(Down(), clock=lambda: now[0])
    for _ in range(5):
        assert b.embed(["x"]) == [None]
    assert Down.calls == 3
    now[0] = 301
    b.embed(["x"])
    assert Down.calls == 4


def test_rerank(spark):
    rows = [(1, "red fox", 10, "blue", 0.9), (1, "red fox", 11, "red fox runs", 0.1)]
    df = spark.createDataFrame(rows, "query_id int, query_text string, event_id long, content string, score double")
    assert [r.event_id for r in enr.rerank_groups(df, enr.OverlapReranker(), 1).collect()] == [11]
    cands = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.1), (1, 3, 12, 0.05)], "query_id int, rank int, event_id long, score double")
    body = spark.createDataFrame([(1, '{"results": [{"index": 1, "relevance_score": 0.95}, {"index": 0, "score": 0.2}]}')], "query_id int, body string")
    assert [(r.event_id, r.score) for r in rt.merge_rerank(cands, body).orderBy("rank").collect()] == [(11, 0.95), (10, 0.2), (12, 0.05)]


def model_pack(cands, budget):
    """Chunks in order while they fit; one head; stop."""
    used, out = 0, []
    for kind, ident, text in cands:
        head = f"[{kind} id={ident}] "
        n, left = len(head + text) // 4, budget - used
        if n <= left:
            out.append((ident, head + text))
            used += n
            continue
        room = left - len(head) // 4 - 4
        if left >= 200 and room >= 200:
            size = min(len(text), room * 4)
            while size and (len(head) + size) // 4 > left:
                size = int(size * 0.9)
            if size:
                out.append((ident, head + text[:size]))
        break
    return out


def test_packing_follows_the_model(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for q in range(30):
        cands = [("user_message", q * 100 + i, "x" * rng.choice([10, 400, 900, 3000, 5000])) for i in range(rng.randrange(1, 7))]
        rows += [(q, ident, kind, text, 1.0 - i / 100) for i, (kind, ident, text) in enumerate(cands)]
        want[q] = model_pack(cands, 900)
    df = spark.createDataFrame(rows, "query_id int, event_id long, type string, content string, score double")
    got = {}
    for r in bd.pack_retrieved(df, F.lit(900)).orderBy("query_id", F.col("score").desc()).collect():
        got.setdefault(r.query_id, []).append((r.event_id, r.chunk))
        assert r.used <= 900
    assert got == {q: w for q, w in want.items() if w}


def test_collision_drops_retrieved_then_tail(spark):
    rows = [("s", "fixed", 1, 50)] + [("s", "retrieved", i, 20) for i in (1, 2)] + [("s", "tail", i, 30) for i in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "session_id string, kind string, place int, cost long")
    left = lambda n: sorted((r.kind, r.place) for r in bd.resolve_collision(df, n).collect())
    assert len(left(300)) == 7
    assert ("retrieved", 2) not in left(195) and ("retrieved", 1) in left(195)
    assert left(150) == [("fixed", 1), ("tail", 1), ("tail", 2), ("tail", 3)]
    assert left(10) == [("fixed", 1), ("tail", 1), ("tail", 2)]


def test_dependency_bonus(spark):
    edges = spark.createDataFrame([("u1", "tc1"), ("tc1", "to1"), ("to1", "am1")], "from_event_id string, to_event_id string")
    anchors = spark.createDataFrame([("s", "to1")], "session_id string, event_id string")
    got = {r.event_id: r.bonus for r in gr.dependency_bonus(anchors, edges, 0.5, 4).collect()}
    assert got == {"to1": 1.0, "tc1": 0.5, "am1": 0.5, "u1": 0.25}
    assert {r.event_id for r in gr.dependency_bonus(anchors, edges, 0.5, 1).collect()} == {"to1", "tc1", "am1"}
    assert gr.dependency_bonus(anchors, edges, 0.0, 4).count() == 0


def test_lineage_cycle_ends(spark):
    lineage = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "old_session_id string, new_session_id string")
    ids = spark.createDataFrame([("a",), ("z",)], "session_id string")
    got = {(r.session_id, r.member) for r in gr.lineage_chain(ids, lineage).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("z", "z")}
    wanted = spark.createDataFrame([("b", "a"), ("x", "y"), ("q", "q")], "old_session_id string, new_session_id string")
    assert gr.rollover(lineage, wanted).count() == 4


def test_lineage_of_a_long_chain(spark):
    lineage = spark.createDataFrame([(i, i + 1) for i in range(300)], "old_session_id long, new_session_id long")
    ids = spark.createDataFrame([(0,), (300,)], "session_id long")
    got = {(r.session_id, r.member) for r in gr.lineage_chain(ids, lineage).collect()}
    assert got == {(s, m) for s in (0, 300) for m in range(301)}
    assert {r.old_session_id: r.current_id for r in gr.resolve_sessions(lineage).collect()} == {i: 300 for i in range(300)}
    state = gr.inherited_state(ids, spark.createDataFrame([(0, "g")], "session_id long, goal string"), lineage)
    assert (300, 0, "g") in {(r.session_id, r.source_session, r.goal) for r in state.collect()}


def test_lineage_cycles_and_forks(spark):
    rows = [(1, 2, 1), (2, 3, 1), (3, 1, 1), (9, 1, 1), (10, 11, 5), (10, 12, 3), (11, 13, 1), (20, 20, 1), (None, 21, 1)] + [(100 + i, 101 + i, 0) for i in range(1100)]
    lineage = spark.createDataFrame(rows, "old_session_id long, new_session_id long, created_at int")
    got = {r.old_session_id: r.current_id for r in gr.resolve_sessions(lineage).collect()}
    assert got == {10: 13, 11: 13} | {100 + i: 1200 for i in range(1100)}  # the cycle and what leads to it have no end
    up = {(r.session_id, r.member) for r in gr.lineage_chain(spark.createDataFrame([(9,)], "session_id long"), lineage.limit(4)).collect()}
    assert up == {(9, m) for m in (9, 1, 2, 3)}


def test_hooks(spark):
    rows = [
        ("h", 1, "start", "A", None, None, True), ("h", 2, "start", "B", "compression", "A", True), ("h", 3, "start", "B", None, None, True),
        ("h", 4, "drift", "C", None, None, True), ("h", 5, "drift", "A", None, None, True), ("h", 6, "reset", None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "host string, t int, kind string, session_id string, boundary_reason string, old_session_id string, has_events boolean")
    got = ss.fold_hooks(df.select("host", F.timestamp_seconds("t").alias("ts"), "kind", "session_id", "boundary_reason", "old_session_id", "has_events")).orderBy("ts").collect()
    assert [(r.action, r.bound, r.edges) for r in got] == [
        ("fresh", "A", ""), ("rollover", "B", "A>B"), ("resume", "B", ""), ("fresh", "C", "B>C"), ("dead", "A", "C>A"), ("reset", None, "")
    ]


def test_live_state_batch_equals_stream_fold(spark):
    import pandas as pd

    from palaver.streaming.pipelines import fold_state

    rng = random.Random(2)
    rows = [
        (f"s{rng.randrange(5)}", i, rng.choice(["user_message", "tool_call", "tool_output", "assistant_message", "decision"]), rng.choice(["", " ", "short", "y" * 600]), f"t{i}")
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "session_id string, event_id int, type string, content string, tool_name string").withColumn("ts", F.timestamp_seconds("event_id"))
    got = {r.session_id: r.asDict() for r in st.live_state(df).collect()}
    pdf = pd.DataFrame(rows, columns=["session_id", "event_id", "type", "content", "tool_name"]).assign(at=lambda d: d.event_id, event_key=lambda d: d.event_id)
    for s, part in pdf.groupby("session_id"):
        for order in (part, part.sample(frac=1, random_state=3)):  # late events change nothing
            state = {}
            for at in range(0, len(order), 7):
                state = fold_state(state, order[at : at + 7])
            want = {f: state[f][1] if f in state else None for f in ("goal", "current_step", "last_tool", "last_tool_output_summary")}
            assert {k: got[s][k] for k in want} == want and got[s]["turn_count"] == state.get("turn_count", 0)


def test_graph_edges_follow_pointers(spark):
    rng = random.Random(9)
    kinds = ["tool_call", "tool_output", "assistant_message", "user_message"]
    rows = [(s, i, rng.choice(kinds)) for s in range(20) for i in range(s * 100, s * 100 + 25)]
    want = set()
    for s in range(20):
        call = output = None
        for _, i, kind in (r for r in rows if r[0] == s):
            if kind == "tool_call":
                call = i
            elif kind == "tool_output":
                if call is not None:
                    want.add((call, i))
                call, output = None, i
            elif kind == "assistant_message":
                if output is not None:
                    want.add((output, i))
                output = None
    df = spark.createDataFrame(rows, "session_id int, event_id int, type string").withColumn("ts", F.timestamp_seconds("event_id"))
    assert {(r.from_event_id, r.to_event_id) for r in gr.derive_edges(df).collect()} == want


def test_drift_segments_cut_on_opposite_vectors(spark):
    rows = [("s", i, [1.0, 0.0]) for i in range(4)] + [("s", i, [-1.0, 0.05]) for i in range(4, 8)]
    df = spark.createDataFrame(rows, "session_id string, msg_index int, embedding array<float>")
    assert [r.segment for r in ss.drift_segments(df).orderBy("msg_index").collect()] == [1] * 4 + [2] * 4


def test_state_compression(spark):
    long = "First part. " + "x" * 300 + ". Last"
    df = spark.createDataFrame([(long, "y" * 250, [str(i) for i in range(9)])], "goal string, current_step string, active_entities array<string>")
    (r,) = st.compress_state(df).collect()
    assert (r.goal, r.current_step, r.active_entities) == ("First part. ... Last", "y" * 200 + "...", ["4", "5", "6", "7", "8"])


def test_settings():
    s = load_settings({"tail_floor": 4}, {"PALAVER_TAIL_FLOOR": "6", "PALAVER_RERANKER_ENABLED": "no", "PALAVER_MEMORY_TOOLS": "a, b"}, {"total_budget": 200})
    assert (s.tail_floor, s.reranker_enabled, s.memory_tools, s.budget) == (6, False, ("a", "b"), 200)
    assert load_settings(env={}).budget == int(S.CONTEXT_LENGTH * 0.7)


def test_metrics(spark):
    df = spark.createDataFrame([([1.0, 0.0, 1.0],)], "r array<double>")
    assert df.select(bd.moving_metric(F.col("r"))).first()[0] == pytest.approx(0.625)


def test_tools(spark):
    folder = "/root/testdata/sf0.001"
    ev = fx.event_log(spark, folder)
    vec = enr.embed_events(ev.limit(60), enr.HashedEmbedder(), "m").select("event_id", "session_id", "embedding").cache()
    tools = MemoryTools(ev, vec, fx.history(spark, folder), fx.lineage(spark, folder), 3, enr.HashedEmbedder())
    hits = json.loads(tools.handle("context_search", {"query": "tool_call", "session": "all", "k": 3}))
    assert len(hits) == 3 and hits[0]["score"] >= hits[1]["score"]
    assert "error" in json.loads(tools.handle("context_search", {"query": " "})) and "error" in json.loads(tools.handle("nope"))
    one = json.loads(tools.handle("fetch_event", {"event_id": 5}))
    assert one["event_id"] == 5 and one["_estimated_tokens"] >= 1
    from palaver.plans.tools import TOOLS, tool_schemas

    assert [t["name"] for t in tool_schemas()] == list(TOOLS) and all(callable(getattr(tools, n)) for n in TOOLS)
    assert json.loads(tools.handle("expand_context", {"event_id": 5, "mode": "segment"}))
    for name, args in (("list_segments", {"limit": 2}), ("get_goal_history", {"limit": 2}), ("recall_recent", {"turns": 2}), ("get_execution_state", {}), ("expand_context", {"event_id": 5, "depth": 9})):
        assert "error" not in tools.handle(name, args)


def test_trace_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("t1", "s", 3)], "turn_id string, session_id string, candidates int")
    for _ in range(2):
        ms.write_trace(df, str(tmp_path / "trace"))
    assert ms.read_trace(spark, str(tmp_path / "trace")).filter("candidates = 3").count() == 2 and ms.read_trace(spark, str(tmp_path / "trace"), 1).count() == 1


def test_garbage_collection(spark):
    reg = spark.createDataFrame([(1, None, "2024-01-01"), (2, None, "2024-01-01"), (3, 1, "2024-01-01"), (4, None, "2024-01-30 12:00:00")], "session_id int, parent_id int, last_active string")
    events = spark.createDataFrame([(2,)], "session_id int")
    assert [r.session_id for r in ss.collectable(reg, events, fx.AS_OF).collect()] == [1]


def test_asof_matches_join(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(i, i % 3, rng.randrange(100)) for i in range(60)], "x int, k int, at int")
    right = spark.createDataFrame([(i, i % 3, rng.randrange(100), rng.choice([None, f"g{i}"])) for i in range(60)], "id int, k int, ts int, goal string")
    got = {r.x: r.g for r in tl.asof_latest(left, right, ["k"], "at", "ts", "id", "goal", "g").collect()}
    marks = [tuple(r) for r in right.collect()]
    for x, k, at in left.collect():
        fit = [(i, g) for i, kk, ts, g in marks if kk == k and ts <= at and g is not None]
        assert got[x] == (max(fit)[1] if fit else None)


def test_enrichment_fold(spark):
    from palaver.plans.assembly import due_enrichments

    rows = [("s", t, f"g{t // 7}", t == 8, t != 5) for t in range(15)]
    df = spark.createDataFrame(rows, "session_id string, turn int, segment string, boundary boolean, ok boolean")
    # the run at 5 fails, so 6 runs; 8 is a boundary in a new segment; 13 is five turns later
    assert [r.turn for r in due_enrichments(df).orderBy("turn").collect()] == [5, 6, 8, 13]


def test_assembly_stays_in_budget_and_keeps_short_sessions(spark):
    from palaver.config import Settings
    from palaver.plans.assembly import assemble_turns

    rows = [("long", i, "user" if i % 2 == 0 else "assistant", f"topic{i % 3} " + "word " * 120) for i in range(11)] + [("short", 0, "user", "hello there")]
    df = spark.createDataFrame(rows, "session_id string, msg_index int, role string, content string").withColumn("ts", F.timestamp_seconds("msg_index"))
    settings = Settings(total_budget=1200, tail_floor=2, min_candidates=3)
    for reranker in (None, enr.OverlapReranker()):
        got = assemble_turns(df, enr.HashedEmbedder(), "1970-01-02 00:00:00", settings, reranker).orderBy("session_id", "pos").collect()
        long = [r for r in got if r.session_id == "long"]
        assert [r.role for r in got if r.session_id == "short"] == ["user"] and long[0].role == "system" and long[-1].content.startswith("topic1")
        assert long[1].content.startswith("[RETRIEVED CONTEXT]") and sum(len(r.content) // 4 + 4 for r in long) <= 1200 + 100


def test_calls_are_written_in_ascii(spark):
    said = {"name": "sök", "arguments": '{"q": "й😀\\n"}'}
    calls = spark.createDataFrame([("s", 0, "assistant", None, None, [("1", (said["name"], said["arguments"]))])], S.MESSAGES)
    assert ms.parse_messages(calls).first().content == json.dumps(said)


def test_edges_are_added_once(spark):
    edges = spark.createDataFrame([(1, 2, "tool_output")], "from_event_id int, to_event_id int, edge_type string")
    more = spark.createDataFrame([(1, 2, "decision"), (2, 3, "decision"), (2, 3, "follows"), (3, 4, "odd")], "from_event_id int, to_event_id int, edge_type string")
    assert sorted((r.from_event_id, r.to_event_id) for r in gr.add_edges(edges, more).collect()) == [(1, 2), (2, 3)]


def test_neighbours_know_their_hop(spark):
    edges = spark.createDataFrame([(1, 2, "tool_output", "s"), (2, 3, "decision", "s"), (1, 3, "follows", "t")], "from_event_id int, to_event_id int, edge_type string, session_id string")
    seeds = spark.createDataFrame([(1, 1)], "seed int, node int")
    got = {(r.node, r.depth, r.edge_type, r.edge_session) for r in gr.with_hops(gr.neighbors(seeds, edges, 2), edges).collect()}
    assert got == {(2, 1, "tool_output", "s"), (3, 1, "follows", "t")}


def test_json_is_recovered_where_the_parser_fails(spark):
    texts = ['{"intent_label": "a"}', '```json\n{"intent_label": "b"}\n```', '{"intent_label": "c", "topic_tags": ["x", "y', "nothing", None, "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("o", enr.parse_json_text(F.col("t")))
    assert [r.l for r in df.orderBy("i").select(F.get_json_object("o", "$.intent_label").alias("l")).collect()] == ["a", "b", "c", None, None, None]


def test_large_states_are_compressed(spark):
    rows = [("big", "First. " + "x" * 5000 + ". Last", "s", [str(i) for i in range(9)], ("d", "l", ["t"])), ("small", "a goal", "s", ["1"] * 9, ("d", "l", ["t"]))]
    df = spark.createDataFrame(rows, "session_id string, goal string, current_step string, active_entities array<string>, enrichment struct<decision_summary:string,intent_label:string,topic_tags:array<string>>")
    big, small = st.compress_state(df, S.STATE_CAP_TOKENS).orderBy("session_id").collect()
    assert (big.goal, len(big.active_entities), big.enrichment) == ("First. ... Last", 5, None) and len(small.active_entities) == 9 and small.enrichment.intent_label == "l"


def test_stream_forgets_repeats(spark, tmp_path):
    from palaver.streaming import pipelines as pipes

    rows = spark.createDataFrame([(i % 10, i % 10) for i in range(40)], "event_id long, at long").select("event_id", F.timestamp_seconds(F.col("at") + 100_000).alias("ts"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = pipes.deduplicated(pipes.read_events(spark, str(tmp_path / "in"), rows.schema, files=1))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10))


def test_state_order(spark):
    folder = "/root/testdata/sf0.001"
    ev = fx.event_log(spark, folder)
    lineage = spark.createDataFrame([(2, 3)], "old_session_id long, new_session_id long")
    states = spark.createDataFrame([(2, "old goal")], "session_id long, goal string")
    tools = MemoryTools(ev, fx.vectors(spark, folder), fx.history(spark, folder), lineage, 3, enr.HashedEmbedder(), states=states)
    row = tools.get_execution_state().first()
    assert (row.goal, row.source, row.source_session) == ("old goal", "ancestor", 2)


def test_snapshot_rule(spark):
    rows = [  # id, second, goal, latest activity
        ("s", 1, 0, "a", None), ("s", 2, 10, "a", None), ("s", 3, 130, "a", None), ("s", 4, 140, "b", None), ("s", 5, 150, "b", 145), ("s", 6, 160, "b", 150), ("s", 7, 170, None, None), ("s", 8, 180, None, None),
        ("t", 9, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "session_id string, id int, at int, goal string, act int")
    commits = df.select("session_id", "id", F.timestamp_seconds("at").alias("ts"), "goal", F.lit("x").alias("current_step"), F.lit(None).cast("string").alias("intent_label"), F.timestamp_seconds("act").alias("activity_ts"))
    # 3 is old enough, 4 differs, 5 had activity since 4, 7 differs; 6 had none after 5
    assert sorted(r.id for r in st.snapshot_log(commits).collect()) == [1, 3, 4, 5, 7, 9]


def test_function_json_has_all_keys(spark):
    """F16: further fields and nested ones in their order, as json.dumps writes them (a map from Python has no order in the JVM)."""
    kind = "array<struct<id:string,function:struct<name:string,strict:boolean,arguments:string,parameters:struct<a:array<int>,`b c`:map<string,string>>>>>"
    schema = f"session_id string, msg_index int, role string, content string, name string, tool_calls {kind}"
    text = 'a "q", \\u001B \x1b \x0f é \U0001f600: {"k":1}'
    full = {"name": "f", "strict": True, "arguments": text, "parameters": {"a": [1, 2], "b c": {"x:y,é": 'z, "w": \\\\'}}}
    less = {"name": "g", "arguments": "{}"}
    rows = [("s", 0, "assistant", None, None, [("1", (full["name"], True, text, ([1, 2], full["parameters"]["b c"]))), ("2", ("g", None, "{}", None))])]
    got = ms.parse_messages(spark.createDataFrame(rows, schema)).orderBy("sub_index").collect()
    assert [r.content for r in got] == [json.dumps(full), json.dumps(less)]


def test_settings_reach_assembly():
    s = load_settings({"goal_trail": 2}, {"PALAVER_DRIFT_THRESHOLD": "0.5", "PALAVER_MEMORY_HINT": "off", "PALAVER_RERANKER_TOP_K": "7"}, {"enricher_endpoint": "http://e"})
    assert (s.goal_trail, s.drift_threshold, s.memory_hint, s.reranker_top_k, s.enricher_endpoint) == (2, 0.5, False, 7, "http://e")
