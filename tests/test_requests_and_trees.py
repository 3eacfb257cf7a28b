"""Request starts of hand-made sequences, and states down parent links against a walk."""

import json
import random

import pytest

from ledgerloom.operators import requests, trees
from ledgerloom.sources import rollout


def line(second, kind, **payload):
    return {"timestamp": f"2026-03-01T00:00:{second:02d}Z", "type": kind, "payload": payload}


def item(second, kind, role=None):
    return line(second, "response_item", type=kind, **({"role": role} if role else {}))


def told(second, response, given=5, output=1):
    return line(second, "token_usage_record", response_id=response, usage={"input_tokens": given, "output_tokens": output, "total_tokens": given + output + (given == 0)})


def seen(second, given, so_far, output=1):
    return line(second, "event_msg", type="token_count", info={"last_token_usage": {"input_tokens": given, "output_tokens": output, "total_tokens": given + output + (given == 0)}, "total_token_usage": {"input_tokens": so_far}})


ASK, ANSWER, TOOL = ("message", "user"), ("message", "assistant"), ("function_call_output",)
#: Sequences of records, and the second of the request behind each usage record, in order.
CASES = {
    "the last prompt": ([item(1, *ASK), item(3, *ASK), told(9, "a")], [3]),
    "frozen at the first output": ([item(1, *ASK), item(4, *ANSWER), item(6, *TOOL), told(9, "a")], [1]),
    "the tool's output starts the next": ([item(1, *ASK), item(4, *ANSWER), item(6, *TOOL), told(9, "a"), item(12, *ANSWER), told(13, "b")], [1, 6]),
    "a compaction is later": ([item(1, *ASK), line(5, "compacted"), item(7, *ANSWER), told(9, "a")], [5]),
    "a compaction without an output tells nothing": ([item(1, *ASK), line(5, "compacted"), told(9, "a")], [1]),
    "a prompt after the compaction": ([line(2, "compacted"), item(3, *ASK), item(7, *ANSWER), told(9, "a")], [3]),
    "an abort clears": ([item(1, *ASK), item(2, *ANSWER), line(3, "event_msg", type="turn_aborted"), item(20, *ASK), item(21, *ANSWER), told(22, "a")], [20]),
    "a turn that opens clears and starts": ([item(1, *ASK), item(2, *ANSWER), line(15, "turn_context"), item(18, *ANSWER), told(19, "a")], [15]),
    "world state is a prompt": ([line(4, "world_state"), told(9, "a")], [4]),
    "a repeated id is no record and clears nothing": ([item(1, *ASK), item(2, *ANSWER), told(3, "a"), item(4, *ASK), item(5, *ANSWER), item(6, *TOOL), told(7, "a"), told(9, "b")], [1, 4]),
    "context clears nothing": ([item(1, *ASK), item(2, *ANSWER), seen(3, 0, 9, 0), item(4, *TOOL), seen(9, 5, 14)], [1, 1]),
    "a repeated state clears nothing": ([item(1, *ASK), item(2, *ANSWER), seen(3, 5, 5), item(4, *ASK), item(5, *ANSWER), seen(6, 5, 5), item(7, *TOOL), seen(9, 6, 11)], [1, 4, 4]),
    "unknown items are neither side": ([item(1, *ASK), item(3, "message", "other"), item(4, "note"), told(9, "a")], [1]),
    "any call is an output": ([item(1, *ASK), item(3, "web_search_call"), item(5, *TOOL), told(9, "a")], [1]),
    "no prompt": ([told(9, "a")], [None]),
    "an output before any prompt": ([item(1, *ANSWER), item(3, *ASK), told(9, "a"), told(10, "b")], [None, 3]),
}


def test_request_starts(spark):
    rows = [(name, n, json.dumps(r)) for name, (records, _) in CASES.items() for n, r in enumerate(records)]
    events = rollout.events(spark.createDataFrame(rows, "path string, place long, line string"))
    got = {name: [] for name in CASES}
    first = 1772323200
    for r in requests.request_starts(events).orderBy("path", "place").collect():
        got[r["path"]].append(None if r["req"] is None else int(r["req"]) - first)
    assert got == {name: want for name, (_, want) in CASES.items()}


def test_request_starts_of_nothing(spark):
    assert requests.request_starts(rollout.events(spark.createDataFrame([("f", 0, "junk"), ("f", 1, "")], "path string, place long, line string"))).count() == 0


def walk(rows):
    """Each record after its parent's state, in file order."""
    out, states, turns = {}, {}, {}
    for path, at, uuid, parent, side, t, fork_end in sorted(rows, key=lambda r: (r[0], r[1])):
        state = dict(states.get((path, parent), {"anchor": None, "compact": None, "turn": None}))
        own = fork_end is None or at > fork_end
        if side == "summary":
            state["compact"] = t
        elif own and side in ("turn", "input"):
            state["anchor"] = t
            if side == "turn":
                state["turn"] = turns[path] = turns.get(path, -1) + 1
        if fork_end == at:
            state = {"anchor": None, "compact": None, "turn": None}
        if uuid is not None:
            states[path, uuid] = state
        anchor = state["anchor"]
        out[path, at] = (anchor if anchor is None or state["compact"] is None else max(anchor, state["compact"]), state["turn"])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_states_go_down_parent_links(spark, seed):
    draw, rows = random.Random(seed), []
    for path in "abc":
        fork = draw.choice((None, 7))
        for at in range(200):
            parent = draw.choice((None, f"u{draw.randrange(210)}", f"u{at - 1}", f"u{at - 1}", f"u{at - 1}"))
            uuid = draw.choice((f"u{at}", f"u{at}", f"u{at}", f"u{max(at - 4, 0)}", None))
            rows.append((path, at, uuid, parent, draw.choice(("turn", "input", "summary", None, None, None)), float(draw.randrange(1000)), fork))
    df = spark.createDataFrame(rows, "path string, line long, uuid string, parent string, side string, t double, fork_end long").repartition(3)
    got = {(r["path"], r["line"]): (r["anchor"], r["turn"]) for r in trees.request_state(df).collect()}
    assert got == walk(rows)


def test_a_chain_of_ten_thousand(spark):
    rows = [("f", i, f"u{i}", f"u{i - 1}" if i else None, "turn" if i == 3 else None, float(i), None) for i in range(10_000)]
    df = spark.createDataFrame(rows, "path string, line long, uuid string, parent string, side string, t double, fork_end long")
    got = trees.request_state(df)
    assert got.where("line >= 3 AND anchor = 3 AND turn = 0").count() == 9997
    assert got.where("line < 3 AND anchor is null AND turn is null").count() == 3
