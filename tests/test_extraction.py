"""Incremental extraction over folders of logs that grow, move, vanish and are rewritten."""

import json
import os
import time

from ledgerloom.operators import charge
from ledgerloom.sources import extraction, rollout


def record(thread, *counts):
    usage = lambda n: {"input_tokens": n, "output_tokens": 1, "total_tokens": n + 1}
    head = {"timestamp": "2026-02-01T00:00:00Z", "type": "session_meta", "payload": {"session_id": f"s-{thread}", "id": thread, "timestamp": "2026-02-01T00:00:00Z"}}
    body = [{"timestamp": f"2026-02-01T00:00:{i:02d}Z", "type": "token_usage_record", "payload": {"response_id": f"{thread}-{i}", "usage": usage(n)}} for i, n in enumerate(counts)]
    return "".join(json.dumps(r) + "\n" for r in (head, *body))


def write(path, text, later=0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    stamp = time.time() + later
    os.utime(path, (stamp, stamp))


def names(paths):
    return [p.rsplit("/", 1)[1] for p in paths]


def charged(spark, store, **more):
    got = {r["counter"]: r["n"] for r in charge.counters(charge.judged(extraction.records(spark, store, **more))).collect()}
    return got["responses"], got["input"]


def test_only_what_changed_is_read(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    a, b, c = (root / "2026/02/01" / f"rollout-{x}.jsonl" for x in "abc")
    write(a, record("a", 10, 20)), write(b, record("b", 5))
    assert names(extraction.update(spark, str(root), store, "x1").read) == ["rollout-a.jsonl", "rollout-b.jsonl"]
    assert charged(spark, store) == (3, 35)
    again = extraction.update(spark, str(root), store, "x1")
    assert (again.read, again.unstable, again.archived, again.version) == ([], [], 0, 2)
    assert charged(spark, store) == (3, 35)

    write(b, record("b", 5, 7), later=5), write(c, record("c", 100), later=5)  # one grows, one is new
    assert names(extraction.update(spark, str(root), store, "x1").read) == ["rollout-b.jsonl", "rollout-c.jsonl"]
    assert charged(spark, store) == (5, 142)

    c.unlink()  # archived, and still charged
    gone = extraction.update(spark, str(root), store, "x1")
    assert (gone.read, gone.archived) == ([], 1)
    assert charged(spark, store) == (5, 142) and charged(spark, store, archived=False) == (4, 42)
    assert [tuple(r)[1:3] for r in extraction.statistics(spark, store).collect()] == [(3, 1)]

    write(c, record("c", 100), later=9)  # and back
    assert extraction.update(spark, str(root), store, "x1").archived == 0

    a.rename(root / "rollout-moved.jsonl")  # one session and thread, so one file
    assert names(extraction.update(spark, str(root), store, "x1").read) == ["rollout-moved.jsonl"]
    assert charged(spark, store) == (5, 142)
    assert extraction.manifest(spark, store).count() == 3

    assert len(extraction.update(spark, str(root), store, "x2").read) == 3  # another extractor reads all
    assert charged(spark, store) == (5, 142)


def test_rewritten_files_and_unstable_reads(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    a, b = root / "rollout-a.jsonl", root / "rollout-b.jsonl"
    write(a, record("a", 10)), write(b, record("b", 5))
    extraction.update(spark, str(root), store, "x")
    paths = [r["path"] for r in extraction.manifest(spark, store).select("path").collect()]
    assert not any(r["rewritten"] for r in extraction.rewritten(spark, store, paths).collect())
    a.write_text(record("a", 99))
    assert {names([r["path"]])[0]: r["rewritten"] for r in extraction.rewritten(spark, store, paths).collect()} == {"rollout-a.jsonl": True, "rollout-b.jsonl": False}

    write(b, record("b", 5, 6), later=3)
    calls = []

    def moving():
        """The listing of a folder in which b is written to at every look."""
        calls.append(1)
        write(b, record("b", *range(5, 6 + len(calls))), later=10 * len(calls))
        return rollout.found(spark, str(root))

    done = extraction.update(spark, str(root), store, "x", list_files=moving)
    assert names(done.unstable) == ["rollout-b.jsonl"]
    assert charged(spark, store) == (2, 104)  # a as it is now, b as it was known
    assert names(extraction.update(spark, str(root), store, "x").read) == ["rollout-b.jsonl"]


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    done = extraction.update(spark, str(tmp_path / "logs"), str(tmp_path / "store"), "x")
    assert (done.read, done.archived) == ([], 0) and extraction.manifest(spark, str(tmp_path / "store")).count() == 0
