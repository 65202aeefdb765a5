"""Decision stacks against the fold answer by answer."""

import random

import pytest

from palaver.operators import folds

ANSWERS = "session_id string, turn long, intent_label string, topic_tags array<string>, decisions array<struct<decision:string,rationale:string>>"


def plain(rows):
    out = {}
    for session, _, label, tags, decisions in sorted(rows, key=lambda r: (r[0], r[1])):
        state = out.setdefault(session, {"label": None, "tags": None, "stack": [], "summary": None})
        state["label"] = label or state["label"]
        state["tags"] = tags or state["tags"]
        for d in decisions or []:
            if d not in state["stack"]:
                state["stack"].append(d)
        if decisions:
            state["stack"], state["summary"] = state["stack"][-5:], decisions[-1][0]
    return out


@pytest.mark.parametrize(("block_turns", "parts", "names"), [(500, 4, 9), (20, 7, 9), (30, 2, 5)])
def test_stacks_equal_the_sequential_fold(spark, block_turns, parts, names):
    """Few names keep a stack's order for ever, so that the first guess is wrong for every block."""
    rng = random.Random(names)
    rows = []
    for turn in range(60):
        for session in ("a", "b"):
            made = [(f"d{rng.randrange(names)}", rng.choice(["", "why"]) if names > 6 else "") for _ in range(rng.randrange(4))]
            rows.append((session, turn * 2, rng.choice([None, "", "x", "y"]), rng.choice([None, [], ["t"], ["u", "v"]]), made or rng.choice([None, []])))
    rows.append(("silent", 1, None, None, None))
    frame = spark.createDataFrame(rows, ANSWERS).repartition(parts)
    got = {r.session_id: r for r in folds.enrichment_states(frame, block_turns).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for s, state in want.items():
        r = got[s]
        assert [tuple(d) for d in r.decision_stack] == state["stack"] and r.decision_summary == state["summary"]
        assert (r.intent_label, r.topic_tags) == (state["label"], state["tags"])


def test_rounds_do_not_grow_with_the_blocks_of_a_session(spark, monkeypatch):
    """Sessions of few turns far apart are one block; one of 40 blocks that no guess settles ends after ROUNDS rounds all the same."""
    cuts, plainly = [], folds.cut
    monkeypatch.setattr(folds, "cut", lambda df: cuts.append(1) or plainly(df))
    far = [(s, turn * 1_000_000, None, None, [(f"d{(turn * 7 + i) % 11}", "") for i in range(2)]) for s in ("a", "b") for turn in range(30)]
    got = folds.decision_stacks(spark.createDataFrame(far, ANSWERS)).collect()
    assert len(cuts) == 3 and {r.session_id: [tuple(d) for d in r.decision_stack] for r in got} == {s: x["stack"] for s, x in plain(far).items()}
    same = [("c", turn, None, None, [(f"d{(turn + turn // 40) % 4 + (9 if turn > 190 else 0)}", "")]) for turn in range(200)] + [("c", 0, None, None, [("first", ""), ("second", "")])]
    cuts.clear()
    got = folds.decision_stacks(spark.createDataFrame(same + far, ANSWERS).repartition(3), 5).collect()
    assert len(cuts) <= 3 + 2 * folds.ROUNDS
    assert {r.session_id: [tuple(d) for d in r.decision_stack] for r in got} == {s: x["stack"] for s, x in plain(same + far).items()}
    in_order = folds.decision_stacks(spark.createDataFrame(same + far, ANSWERS).repartition(3), 5, rounds=0).collect()
    assert sorted(map(repr, in_order)) == sorted(map(repr, got))
