"""Staged search and the assembly of a turn around it."""

import json

import pytest
from pyspark.sql import functions as F

from palaver.config import Settings
from palaver.functions.enrichment import HashedEmbedder
from palaver.operators import cascade as cs
from palaver.operators import knn
from palaver.plans import assembly as asm

AS_OF = "1970-01-02 00:00:00"
POOL = "session_id string, event_id string, segment_id string, embedding array<float>, second int, type string, content string"


def pool_of(spark, rows):
    return spark.createDataFrame(rows, POOL).withColumn("ts", F.timestamp_seconds("second")).drop("second")


def asked_of(spark, rows):
    return spark.createDataFrame(rows, "session_id string, segment_id string, query array<float>, clean array<float>").withColumn("mode", F.lit("general"))


def stages(spark, asked, rows, protected=(), **more):
    shield = spark.createDataFrame(list(protected), "session_id string, event_id string")
    got = cs.staged_search(asked_of(spark, asked), pool_of(spark, rows), shield, as_of=AS_OF, **more).collect()
    return {s: sorted(r.event_id for r in got if r.stage == s) for s in {r.stage for r in got}}


def events(session, segment, n, vector, prefix, content="x" * 400):
    return [(session, f"{prefix}{i}", segment, vector, i, "user_message", content) for i in range(n)]


A, B = [1.0, 0.0], [0.0, 1.0]


def test_a_rich_segment_needs_no_further_search(spark):
    rows = events("s", "now", 5, A, "n") + events("s", "old", 5, A, "o")
    assert stages(spark, [("s", "now", A, B)], rows, budget=1000, least=3, k=None) == {"segment": [f"n{i}" for i in range(5)]}


def test_a_small_segment_is_widened_to_the_session(spark):
    rows = events("s", "now", 2, A, "n") + events("s", "old", 4, A, "o")
    assert stages(spark, [("s", "now", A, B)], rows, budget=1000, least=3) == {"segment": ["n0", "n1"], "session": ["o0", "o1", "o2", "o3"]}


def test_what_the_tail_holds_makes_room_for_other_segments(spark):
    rows = events("s", "now", 4, A, "n") + events("s", "old", 3, A, "o")
    shield = [("s", "n0"), ("s", "n1"), ("s", "n2")]
    assert stages(spark, [("s", "now", A, A)], rows, shield, budget=1000, least=3) == {"segment": ["n3"], "segments": ["o0", "o1", "o2"]}


def test_a_pool_of_few_tokens_is_joined_by_the_plain_message(spark):
    rows = events("s", "now", 3, A, "n", "x" * 40) + events("s", "now", 3, B, "m", "y" * 40)
    got = stages(spark, [("s", "now", A, B)], rows, budget=100, least=3, k=3)
    assert got == {"segment": ["n0", "n1", "n2"], "message": ["m0", "m1", "m2"]}  # 30 of 50 tokens wanted, found by the message


def test_only_thin_sessions_enter_a_stage(spark):
    rows = events("rich", "now", 6, A, "r") + events("rich", "old", 6, A, "q") + events("poor", "now", 1, A, "p") + events("poor", "old", 2, A, "o")
    got = stages(spark, [("rich", "now", A, B), ("poor", "now", A, B)], rows, budget=1000, least=3)
    assert got["segment"] == ["p0", *[f"r{i}" for i in range(6)]] and got["session"] == ["o0", "o1"]
    assert stages(spark, [("none", "now", A, B)], rows, budget=1000) == {}


def test_probe_of_new_sessions(spark):
    vectors = spark.createDataFrame([("new", "a", A), ("old", "b", [0.9, 0.1]), ("older", "c", B)], "session_id string, event_id string, embedding array<float>")
    asked = asked_of(spark, [("new", "s", A, A), ("old", "s", A, A)])
    counts = spark.createDataFrame([("new", 1), ("old", 50)], "session_id string, n long")
    got = cs.probe(asked, counts, knn.build_index(vectors), 2, 20).collect()
    assert [(r.session_id, r.event_id, r.from_session, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("new", "b", "old", 1), ("new", "c", "older", 2)]


# -- the whole turn -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def talk(spark):
    rows = [("long", i, "user" if i % 2 == 0 else "assistant", f"topic{i % 3} " + "word " * 120) for i in range(11)]
    rows += [("short", 0, "user", "hello there"), ("short", 1, "assistant", "hello"), ("short", 2, "user", "and again")]
    return spark.createDataFrame(rows, "session_id string, msg_index int, role string, content string").withColumn("ts", F.timestamp_seconds("msg_index"))


SETTINGS = Settings(total_budget=1200, tail_floor=2, min_candidates=3)


def run(talk, **more):
    got = asm.assemble_turns(talk, HashedEmbedder(), AS_OF, SETTINGS, **more).orderBy("session_id", "pos").collect()
    return {s: [r for r in got if r.session_id == s] for s in {r.session_id for r in got}}


def test_resumed_sessions_are_assembled(spark, talk):
    plain = run(talk)
    assert [r.role for r in plain["short"]] == ["user", "assistant", "user"]
    resumed = spark.createDataFrame([("short",), ("unknown",)], "session_id string")
    got = run(talk, resumed=resumed)
    assert got["short"][0].role == "system" and got["short"][-1].content == "and again" and set(got) == {"short", "long"}


def test_blocks_of_the_system_message(spark, talk):
    history = spark.createDataFrame([("long", 1, "ship it"), ("long", 2, "test it")], "session_id string, id long, goal string").withColumn("ts", F.timestamp_seconds("id"))
    lineage = spark.createDataFrame([("before", "long")], "old_session_id string, new_session_id string")
    extras = spark.createDataFrame([("long", 1, "[NOTE] two"), ("long", 0, "[NOTE] one")], "session_id string, pos int, block string")
    others = spark.createDataFrame([("x1", "elsewhere", [0.1] * 64, "words of another session")], "event_id string, session_id string, embedding array<float>, content string")
    system = run(talk, history=history, lineage=lineage, extras=extras)["long"][0].content
    at = [system.index(b) for b in ("[MEMORY STATS] events: 11", "compressed:1", "[GOAL TRAIL]\n1. ship it\n2. test it", "[EXECUTION STATE]\n", "[NOTE] one", "[NOTE] two")]
    assert at == sorted(at) and "[CHECKPOINT]" not in system and "[CROSS-SESSION" not in system
    new = run(talk, resumed=spark.createDataFrame([("short",)], "session_id string"), others=others)
    state = new["short"][0].content
    assert "[CROSS-SESSION CANDIDATES]" not in state  # three events are more than the tail of two
    small = Settings(total_budget=1200, tail_floor=3, min_candidates=3)
    got = asm.assemble_turns(talk, HashedEmbedder(), AS_OF, small, resumed=spark.createDataFrame([("short",)], "session_id string"), others=others)
    assert "- session=elsewhere event=x1 :: words of another session" in got.filter("session_id = 'short' AND pos = 0").first().content


def test_checkpoint_after_a_streak_of_memory_calls(spark):
    call = lambda i: [{"id": str(i), "function": {"name": "context_search", "arguments": json.dumps({"query": i})}}]
    rows = [("s", 0, "user", "look it up", None)] + [("s", i, "assistant", "", call(i)) for i in range(1, 7)]
    shape = "session_id string, msg_index int, role string, content string, tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>"
    said = spark.createDataFrame(rows, shape).withColumn("ts", F.timestamp_seconds("msg_index"))
    system = run(said, resumed=spark.createDataFrame([("s",)], "session_id string"))["s"][0].content
    assert "[CHECKPOINT] 6 memory calls in a row\ngoal: look it up" in system


def test_the_hosts_count_decides_where_it_is_larger(spark, talk):
    counted = spark.createDataFrame([("short", 5000), ("long", 1)], "session_id string, current_tokens long")
    got = run(talk, prompt_tokens=counted)
    assert got["short"][0].role == "system" and got["long"][0].role == "system"


def test_drift_is_that_of_the_message(spark):
    """A message unlike the segment so far is a new task; one like it is not."""
    rows = [("same", i, "user", f"compile the parser module number {i}") for i in range(6)]
    rows += [("other", i, "user", "aaaa aaaa aaaa aaaa") for i in range(5)] + [("other", 5, "user", "zzzz qqqq zzzz qqqq zzzz")]
    said = spark.createDataFrame(rows, "session_id string, msg_index int, role string, content string").withColumn("ts", F.timestamp_seconds("msg_index"))
    from palaver.functions.enrichment import embed_column, embed_events
    from palaver.operators import state as st
    from palaver.operators import timeline as tl
    from palaver.sources import messages as ms

    parsed = ms.parse_messages(said).join(said.select("session_id", "msg_index", "ts"), ["session_id", "msg_index"])
    work = parsed.join(tl.segment_ordinals(said).select("session_id", "msg_index", F.col("segment").cast("string").alias("segment_id")), ["session_id", "msg_index"])
    current = asm.current_messages(said).withColumn("vector", embed_column(HashedEmbedder())(F.col("message")))
    drifts = asm.message_drifts(current, work, embed_events(work, HashedEmbedder(), "m"))
    got = {r.session_id: r for r in asm.turns(said, st.live_state(work), drifts).collect()}
    assert got["other"].signals.drifts and not got["other"].signals.is_switch and got["other"].signals.intent == "NEW_TASK" and not got["same"].signals.drifts
    assert got["same"].drift < 0.2 < got["other"].drift and got["same"].intent == "CONTINUATION" and got["other"].intent == "NEW_TASK"


def test_segments_carry_the_sessions_tags(spark):
    from palaver.plans.tools import MemoryTools
    from palaver.sources import fixtures as fx

    folder = "/root/testdata/sf0.001"
    log, history = fx.event_log(spark, folder), fx.history(spark, folder)
    session = log.groupBy("session_id").count().orderBy(F.col("count").desc(), "session_id").first().session_id
    states = spark.createDataFrame([(session, "goal", ["spark", "joins"])], "session_id long, goal string, topic_tags array<string>")
    tools = MemoryTools(log, fx.vectors(spark, folder), history, fx.lineage(spark, folder), session, HashedEmbedder(), states=states)
    rows = tools.list_segments(3).collect()
    assert rows and all(r.topic_tags == ["spark", "joins"] for r in rows)
    assert "topic_tags" not in MemoryTools(log, fx.vectors(spark, folder), history, fx.lineage(spark, folder), session, HashedEmbedder()).list_segments(3).columns
