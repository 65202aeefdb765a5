"""Session life cycle and clean-up (ST7, ST8 drift mode, P9, J5).

The life cycle is a fold over a host's hook log: what a hook does depends on what earlier ones left.  Hooks of
one host stream through a task in order; the state is the set of that host's sessions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver import schemas as S


def fold_hooks(hooks: DataFrame) -> DataFrame:
    """ST7: hooks (host, ts, kind, session_id, boundary_reason, old_session_id, has_events) to decisions.

    kind: 'start', 'drift', 'reset' or 'end'.  Each hook yields what happened (action), the session bound after
    it, the lineage edges it adds (old -> bound, as 'old>new' joined by commas) and sessions it closes.
    """
    out = "host string, ts timestamp, kind string, action string, bound string, edges string, closed string, cursor int"

    def fold(batches: Iterator) -> Iterator:
        import pandas as pd

        host = None
        status: dict[str, str] = {}
        edges: set[tuple[str, str]] = set()
        bound = None
        for pdf in batches:
            rows = []
            for h in pdf.itertuples(index=False):
                if h.host != host:
                    host, status, edges, bound = h.host, {}, set(), None
                sid = h.session_id if isinstance(h.session_id, str) and h.session_id else None
                old = h.old_session_id if isinstance(h.old_session_id, str) and h.old_session_id else None
                new_edges: list[tuple[str, str]] = []
                closed: list[str] = []
                action, cursor = "none", 0

                def move(a, b):
                    """Events of a go to b, unless they are one or b already went to a."""
                    if a and b and a != b and (b, a) not in edges and (a, b) not in edges:
                        edges.add((a, b))
                        new_edges.append((a, b))  # noqa: B023
                        status[a] = "compressed"
                        status[b] = "active"

                def close(x):
                    if x and status.get(x) == "active":
                        status[x] = "closed"
                        closed.append(x)  # noqa: B023

                if h.kind == "start" and h.boundary_reason == "compression" and old and sid and old != sid:
                    action = "rollover"
                    if bound not in (None, old, sid):
                        move(bound, sid)
                    move(old, sid)
                    status.setdefault(sid, "active")
                    bound = sid
                elif h.kind == "start" and sid:
                    action = "resume" if sid in status else "fresh"
                    cursor = 0 if action == "resume" else -1
                    if action == "resume":
                        status[sid] = "active"
                    elif bool(h.has_events):
                        status[sid] = "active"
                    bound = sid
                elif h.kind == "drift" and sid:
                    if status.get(sid) == "active":
                        action = "resume"
                        if bound != sid:
                            close(bound)
                    else:
                        action, cursor = ("dead" if sid in status else "fresh"), -1
                        if bound and bound in status and bool(h.has_events):
                            was = status.get(sid)
                            move(bound, sid)
                            if action == "dead":
                                status[sid] = was
                        elif bound:
                            close(bound)
                        if action == "fresh":
                            status.setdefault(sid, "active")
                    bound = sid
                elif h.kind == "reset":
                    action = "reset"
                    close(bound)
                    bound = None
                elif h.kind == "end" and (sid or bound):
                    action = "end"
                    close(sid or bound)
                rows.append((h.host, h.ts, h.kind, action, bound, ",".join(f"{a}>{b}" for a, b in new_edges), ",".join(closed), cursor))
            yield pd.DataFrame(rows, columns=["host", "ts", "kind", "action", "bound", "edges", "closed", "cursor"])

    return hooks.repartition("host").sortWithinPartitions("host", "ts").mapInPandas(fold, out)


def drift_segments(messages: DataFrame, threshold: float = S.DRIFT_THRESHOLD, window: int = S.CENTROID_WINDOW, least: int = S.COLD_START) -> DataFrame:
    """ST8, drift mode: messages (session_id, msg_index, embedding) with their segment number.

    A message whose drift score from the mean of the segment's last vectors exceeds the threshold opens a
    segment.  The mean depends on earlier cuts, so it is a fold; it holds one window of vectors.
    """

    def fold(batches: Iterator) -> Iterator:
        session, segment, held = None, 1, []
        for pdf in batches:
            numbers = []
            for row in pdf.itertuples(index=False):
                if row.session_id != session:
                    session, segment, held = row.session_id, 1, []
                v = None if row.embedding is None else np.asarray(row.embedding, np.float64)
                if v is not None:
                    if len(held) >= least:
                        c = np.mean(held, axis=0)
                        n = np.linalg.norm(c) * np.linalg.norm(v)
                        cos = float(c @ v / n) if n else 0.0
                        if S.DRIFT_WEIGHTS[0] * min(1.0, max(0.0, (1 - cos) / 2)) > threshold:
                            segment, held = segment + 1, []
                    held = [*held, v][-window:]
                numbers.append(segment)
            yield pdf[["session_id", "msg_index"]].assign(segment=numbers)

    kind = messages.schema["session_id"].dataType.simpleString()
    dealt = messages.select("session_id", F.col("msg_index").cast("int").alias("msg_index"), "embedding")
    return dealt.repartition("session_id").sortWithinPartitions("session_id", "msg_index").mapInPandas(fold, f"session_id {kind}, msg_index int, segment int")


def session_status(sessions: DataFrame, lineage: DataFrame, ended: DataFrame) -> DataFrame:
    """Compressed where events moved on, closed where ended, else active."""
    moved = lineage.select(F.col("old_session_id").alias("session_id")).distinct().withColumn("moved", F.lit(True))
    over = ended.select("session_id").distinct().withColumn("over", F.lit(True))
    joined = sessions.join(moved, "session_id", "left").join(over, "session_id", "left")
    return joined.withColumn("status", F.when(F.col("moved"), "compressed").when(F.col("over"), "closed").otherwise("active")).drop("moved", "over")


def collectable(sessions: DataFrame, events: DataFrame, as_of: str, age: int = S.GC_SECONDS) -> DataFrame:
    """Sessions to collect: no parent, no events, and no activity for *age* seconds."""
    old = F.unix_timestamp(F.col("last_active").cast("timestamp")) < F.unix_timestamp(F.lit(as_of).cast("timestamp")) - age
    return sessions.filter(F.col("parent_id").isNull() & old).join(events.select("session_id"), "session_id", "left_anti")
