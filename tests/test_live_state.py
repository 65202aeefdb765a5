"""The live state as a stream against the fold of all events."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from palaver.streaming import pipelines as pipes

EVENTS = "session_id string, event_id long, ts timestamp, type string, content string, tool_name string"
START = datetime(2024, 1, 1)
KINDS = ["user_message", "tool_call", "tool_output", "assistant_message", "decision"]


def test_parts_join_to_the_fold_of_all_events(spark, tmp_path):
    """Sessions that were quiet for longer than *idle* keep their goal and turns; late events count; no Python per session."""
    rng, rows = random.Random(6), []
    for i in range(240):
        day = i // 60 * 25 + rng.randrange(8)  # four bursts: the watermark passes the span of the first ones
        session = "once" if i == 0 else f"s{rng.randrange(4)}"
        rows.append((session, i, START + timedelta(days=day, seconds=rng.randrange(86_400)), rng.choice(KINDS), rng.choice(["", " ", " short ", "y" * 600, None]), f"t{i}"))
    for b in range(4):
        part = rows[b * 60 : b * 60 + 60]
        rng.shuffle(part)
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    states = pipes.live_states(pipes.read_events(spark, f"{tmp_path}/in", spark.createDataFrame([], EVENTS).schema, files=1), "10 days")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/states/batch={number}")

    run = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start()
    run.awaitTermination()
    assert "Python" not in run._jsq.explainInternal(False) and "Pandas" not in run._jsq.explainInternal(False)
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] < 4 * 5  # parts that the watermark has passed are forgotten
    got = {r.session_id: r.asDict() for r in pipes.session_states(spark.read.parquet(f"{tmp_path}/states")).collect()}
    pdf = pd.DataFrame(rows, columns=["session_id", "event_id", "ts", "type", "content", "tool_name"]).assign(at=lambda d: d.ts.astype("int64"), event_key=lambda d: d.event_id.map("{:020d}".format))
    assert set(got) == set(pdf.session_id)
    for s, part in pdf.groupby("session_id"):
        state = pipes.fold_state({}, part)
        want = {f: state[f][1] if f in state else None for f in pipes.FIELDS} | {"turn_count": state.get("turn_count", 0)}
        assert {k: got[s][k] for k in want} == want


def test_an_event_without_a_time_is_an_error(spark, tmp_path):
    spark.createDataFrame([("s", 1, None, "user_message", "x", None)], EVENTS).write.parquet(f"{tmp_path}/in")
    states = pipes.live_states(pipes.read_events(spark, f"{tmp_path}/in", spark.createDataFrame([], EVENTS).schema))
    run = states.writeStream.outputMode("update").format("memory").queryName("no_time").option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="no ts"):
        run.awaitTermination()
