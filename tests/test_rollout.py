"""Rollout logs: small corpora with own figures, one for each rule of charging, and the counters that the rules give them."""

import json

import pytest

from ledgerloom.operators import charge
from ledgerloom.sources import rollout


def stamp(second):
    return f"2026-01-01T00:00:{second:02d}.000Z"


def counts(given, output, total):
    return {"input_tokens": given, "cached_input_tokens": 0, "output_tokens": output, "reasoning_output_tokens": 0, "total_tokens": total}


def head(thread, second=0, parent=None, session="S"):
    return {"timestamp": stamp(second), "type": "session_meta", "payload": {"session_id": session, "id": thread, "timestamp": stamp(second)} | ({"parent_thread_id": parent} if parent else {})}


def snapshot(second, given, so_far):
    return {"timestamp": stamp(second), "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": counts(given, 10, given + 10), "total_token_usage": counts(so_far, 10, so_far + 10)}}}


def context(second, total):
    return {"timestamp": stamp(second), "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": counts(0, 0, total), "total_token_usage": counts(total, 0, total)}}}


def explicit(second, response, given):
    return {"timestamp": stamp(second), "type": "token_usage_record", "payload": {"response_id": response, "usage": counts(given, 10, given + 10)}}


def grown(*sizes, start=1):
    """Snapshots of responses of these sizes, the running total beside each."""
    return [snapshot(start + i, n, sum(sizes[: i + 1])) for i, n in enumerate(sizes)]


TRUNK = grown(37, 52, 61, 18)
NOTED = [*TRUNK[:3], context(3, 150), TRUNK[3]]
#: A rule, files of records, and the counters that they give; others are not looked at.
GOLDEN = {
    "explicit records silence the snapshots beside them": ([[head("solo"), explicit(1, "k-1", 44), snapshot(1, 44, 44), explicit(2, "k-2", 29), snapshot(2, 29, 73), explicit(3, "k-2", 29)]], {"responses": 2, "input": 73, "files_explicit": 1, "files_legacy": 0}),
    "one response id is charged once in a session, in the file that started first": ([[head("late", 9), explicit(9, "k-1", 6), explicit(10, "k-4", 8)], [head("early", 2), explicit(3, "k-1", 6), explicit(4, "k-2", 7), explicit(5, "k-3", 5)]], {"responses": 4, "cross_file_response_id": 1, "input": 26}),
    "and once in each of two sessions": ([[head("one", session="north"), explicit(1, "k-1", 6)], [head("two", 4, session="south"), explicit(5, "k-1", 6)]], {"responses": 2, "cross_file_response_id": 0}),
    "a state that is written again is one response": ([[head("solo"), *grown(23, 64), snapshot(2, 64, 87), snapshot(2, 64, 87)]], {"responses": 2, "legacy_repeat": 2, "input": 87}),
    "an equal size with another total is a response": ([[head("solo"), *grown(64, 64, 64)]], {"responses": 3, "legacy_repeat": 0}),
    "a context state between two equal ones parts them": ([[head("solo"), snapshot(1, 23, 23), context(2, 9), snapshot(3, 23, 23)]], {"responses": 2, "legacy_repeat": 0, "context_snapshots": 1}),
    "a context state is no response": ([[head("solo"), context(1, 812), *grown(90, start=2)]], {"responses": 1, "input": 90, "output": 10, "context_snapshots": 1}),
    "a child that begins as its parent did inherits that": ([[head("trunk"), *TRUNK], [head("twig", 20, "trunk"), *TRUNK[:3], snapshot(21, 5, 155), snapshot(22, 6, 161)]], {"responses": 6, "inherited": 3, "input": 179}),
    "context states do not break what is inherited": ([[head("trunk"), *NOTED], [head("twig", 20, "trunk"), *NOTED, snapshot(21, 5, 173)]], {"responses": 5, "inherited": 4}),
    "a run out of the parent's middle is inherited": ([[head("trunk"), *TRUNK], [head("twig", 20, "trunk"), *TRUNK[1:3], snapshot(21, 5, 155)]], {"responses": 5, "inherited": 2}),
    "one equal state alone is charged and ambiguous": ([[head("trunk"), *TRUNK], [head("twig", 20, "trunk"), TRUNK[2], snapshot(21, 5, 155)]], {"responses": 6, "inherited": 0, "ambiguous": 1}),
    "files without a declared parent inherit nothing": ([[head("trunk"), *TRUNK[:2]], [head("other", 20), *TRUNK[:2]]], {"responses": 4, "inherited": 0}),
    "a grandchild inherits from its parent, which inherited": ([[head("trunk"), *TRUNK[:2]], [head("bough", 10, "trunk"), *TRUNK[:3]], [head("twig", 20, "bough"), *TRUNK[:3], snapshot(21, 5, 155)]], {"responses": 4, "inherited": 5}),
    "siblings inherit each for itself": ([[head("trunk"), *TRUNK[:2]], [head("left", 10, "trunk"), *TRUNK[:2], snapshot(11, 3, 92)], [head("right", 12, "trunk"), *TRUNK[:2], snapshot(13, 4, 93)]], {"responses": 4, "inherited": 4}),
}


@pytest.mark.parametrize("case", GOLDEN)
def test_golden_ledgers(spark, case):
    files, want = GOLDEN[case]
    rows = [(f"f{i}", n, json.dumps(record)) for i, file in enumerate(files) for n, record in enumerate(file)]
    records = rollout.parse(spark.createDataFrame(rows, "path string, place long, line string"))
    got = {r["counter"]: r["n"] for r in charge.counters(charge.judged(records)).collect()}
    assert {k: got[k] for k in want} == want


def test_files_lines_and_damage(spark, tmp_path):
    at = tmp_path / "2026" / "01" / "02"
    at.mkdir(parents=True)
    whole = "\n".join(map(json.dumps, [head("x"), snapshot(1, 100, 100), {"type": "token_usage_record", "payload": {"response_id": 5, "usage": "none"}}]))
    (at / "rollout-a.jsonl").write_text(whole + '\n{"type": "token_count\n\n[1]\n' + json.dumps(snapshot(2, 7, 107)))
    (tmp_path / "rollout-2026-01-05T10.jsonl").write_text(whole + "\n")
    (tmp_path / "other.jsonl").write_text(whole)
    files = rollout.found(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["day"]) for r in files.collect()) == [("rollout-2026-01-05T10.jsonl", "2026-01-05"), ("rollout-a.jsonl", "2026-01-02")]
    assert rollout.in_days(files, "2026-01-03").count() == 1 == rollout.in_days(files, None, "2026-01-02").count() and rollout.in_days(files).count() == 2
    lines = rollout.lines(spark, str(tmp_path))
    seen = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in rollout.damage(lines).collect()}
    assert seen == {"rollout-a.jsonl": (5, 1, 1), "rollout-2026-01-05T10.jsonl": (3, 0, 0)}
    got = {r["counter"]: r["n"] for r in charge.counters(charge.judged(rollout.parse(lines))).collect()}
    assert (got["responses"], got["files_legacy"], got["files_explicit"]) == (2, 2, 0)


def test_models_tiers_and_efforts_hold_until_the_next(spark):
    turn = lambda model, **more: {"timestamp": stamp(1), "type": "turn_context", "payload": {"model": model, **more}}
    tier = lambda **more: {"timestamp": stamp(1), "type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_settings": more}}
    file = [head("x"), explicit(1, "a", 1), turn("m", effort="high"), tier(service_tier="fast"), explicit(2, "b", 1), turn(None), explicit(3, "c", 1), tier(), explicit(4, "d", 1)]
    records = rollout.parse(spark.createDataFrame([("f", n, json.dumps(r)) for n, r in enumerate(file)], "path string, place long, line string"))
    got = {r["response_id"]: (r["model"], r["effort"], r["tier"]) for r in rollout.carried(records).collect()}
    assert got == {"a": (None, None, None), "b": ("m", "high", "fast"), "c": ("m", None, "fast"), "d": ("m", None, "default")}


def test_charging_has_a_small_plan_and_parses_lines_once(spark, capsys):
    rows = [(f"f{i}", n, json.dumps(r)) for i, file in enumerate(GOLDEN["siblings inherit each for itself"][0]) for n, r in enumerate(file)]
    records = rollout.parse(spark.createDataFrame(rows, "path string, place long, line string"))
    records.explain()
    assert capsys.readouterr().out.count("from_json") == 1
    charge.judged(records).explain()
    plan = capsys.readouterr().out
    assert "from_json" not in plan and plan.count("Exchange ") + plan.count("Exchange(") <= 10
