"""Merged copies against a step-by-step insertion, on hand-made and on random captures."""

import random

import pytest

from ledgerloom.operators import history


def block(record, index=None, t=None, output=None, parent=None):
    return {"record": record, "parent": parent, "index": index, "t": t, "usage": None if output is None else {"input": 1, "cached": 0, "output": output}}


def capture(blocks, response="r", source="s", model="m", aborted=False, stable=True):
    with_usage = [b["record"] for b in blocks if b["usage"]]
    return {"response": response, "source": source, "model": model, "aborted": aborted, "truncated": False, "stable": stable, "blocks": blocks, "revisions": [], "terminal": with_usage[-1] if with_usage else None, "conflict": False}


def one_by_one(old, new):
    """Every incoming block is looked up, then put next to a neighbour that is already there."""
    blocks, terminal = [dict(b) for b in old["blocks"]], next((b for b in old["blocks"] if b["record"] == old["terminal"]), None)
    revisions, conflict, order = list(old["revisions"]), old["conflict"], [b["record"] for b in new["blocks"]]
    retained = list(blocks)
    model = old["model"]
    for n, b in enumerate(new["blocks"]):
        twin = [x for x in blocks if (b["index"] is not None and x["index"] == b["index"]) or x["record"] == b["record"]]
        if twin:
            if twin[0] != b:
                conflict = True
                if b not in revisions:
                    revisions.append(b)
            continue
        here = [x["record"] for x in blocks]
        after, before = [r for r in order[n + 1 :] if r in here], [r for r in order[:n] if r in here]
        if after:
            spot = here.index(after[0])
        elif before:
            spot = here.index(before[-1]) + 1
        else:
            spot = len(blocks)
            for i in range(len(blocks) - 1, -1, -1):
                x = blocks[i]
                if b["index"] is not None and x["index"] is not None:
                    if b["index"] < x["index"]:
                        spot = i
                elif b["t"] is not None and x["t"] is not None and b["t"] < x["t"]:
                    spot = i
        blocks.insert(spot, b)
        if b["usage"]:
            if terminal is None:
                later = True
            elif b["index"] is not None and terminal["index"] is not None:
                later = b["index"] > terminal["index"]
            elif terminal["record"] in order:
                later = n > order.index(terminal["record"])
            else:
                later = b["t"] is not None and terminal["t"] is not None and b["t"] > terminal["t"]
            if later:
                terminal, model = b, new["model"]
    assert [b for b in blocks if b in retained] == retained
    return {**old, "blocks": blocks, "revisions": revisions, "conflict": conflict or old["model"] != new["model"], "terminal": terminal["record"] if terminal else None, "model": model, "aborted": old["aborted"] or new["aborted"], "stable": True}


def plain(row):
    return {k: [{**b, "usage": b["usage"]} for b in v] if k in ("blocks", "revisions") else v for k, v in row.asDict(recursive=True).items()}


def run(spark, old, new):
    frames = [spark.createDataFrame(x, history.COPY) for x in (old, new)]
    return sorted((plain(r) for r in history.merged(*frames).collect()), key=lambda r: (r["response"], r["source"]))


CASES = {
    "a block between two that both have": ([block("a", 0, 1.0, 5), block("c", 2, 3.0, 7)], [block("a", 0, 1.0, 5), block("b", 1, 2.0, 9), block("c", 2, 3.0, 7)], ["a", "b", "c"], "c", False),
    "a later block advances": ([block("a", 0, 1.0, 5)], [block("a", 0, 1.0, 5), block("b", 1, 2.0, 9)], ["a", "b"], "b", False),
    "an earlier block does not": ([block("b", 1, 2.0, 9)], [block("a", 0, 1.0, 5)], ["a", "b"], "b", False),
    "by time without an index": ([block("b", None, 2.0, 9)], [block("a", None, 1.0, 5), block("x", None, 1.5, 5)], ["a", "x", "b"], "b", False),
    "a changed block is a revision": ([block("a", 0, 1.0, 5)], [block("a", 0, 1.0, 6)], ["a"], "a", True),
    "one index under two records": ([block("a", 0, 1.0, 5)], [block("z", 0, 1.0, 5)], ["a"], "a", True),
    "what is gone stays": ([block("a", 0, 1.0, 5), block("b", 1, 2.0, 9)], [block("b", 1, 2.0, 9)], ["a", "b"], "b", False),
    "before the record that follows, not by index": ([block("a", 1), block("b", 4), block("c", 5)], [block("a", 1), block("n", 3), block("c", 5)], ["a", "b", "n", "c"], None, False),
    "no usage anywhere": ([block("a", 0)], [block("b", 1)], ["a", "b"], None, False),
    "nothing retained": ([], [block("b", 1, 1.0, 3)], ["b"], "b", False),
}


def test_merges_of_hand_made_captures(spark):
    old = [capture(c[0], response=name) for name, c in CASES.items()]
    new = [capture(c[1], response=name) for name, c in CASES.items()]
    for row in run(spark, old, new):
        _, _, order, terminal, conflict = CASES[row["response"]]
        assert ([b["record"] for b in row["blocks"]], row["terminal"], row["conflict"]) == (order, terminal, conflict), row["response"]


def test_sides_and_unstable_copies(spark):
    a, b = [block("a", 0, 1.0, 5)], [block("b", 1, 2.0, 6)]
    old = [capture(a, "kept"), capture(a, "both", model="m1"), capture(a, "unstable")]
    new = [capture(b, "new"), capture(b, "both", model="m2", aborted=True), capture(b, "unstable", stable=False)]
    got = {r["response"]: r for r in run(spark, old, new)}
    assert {k: [x["record"] for x in r["blocks"]] for k, r in got.items()} == {"kept": ["a"], "new": ["b"], "both": ["a", "b"], "unstable": ["a"]}
    assert (got["both"]["model"], got["both"]["aborted"], got["both"]["conflict"]) == ("m2", True, True)
    assert run(spark, [], []) == [] and run(spark, old[:1], []) == run(spark, [], old[:1])


@pytest.mark.parametrize("seed", range(3))
def test_merges_are_one_by_one_and_idempotent(spark, seed):
    draw, old, new = random.Random(seed), [], []
    for n in range(150):
        whole = [block(f"r{i}", draw.choice((i, i, None)), draw.choice((float(i), None, float(draw.randrange(9)))), draw.choice((None, i))) for i in range(draw.randrange(1, 9))]
        if draw.random() < 0.5:
            draw.shuffle(whole)
        sides = [[dict(b) for b in whole if draw.random() < 0.6] for _ in range(2)]
        for b in sides[1]:
            if draw.random() < 0.15:
                b.update(draw.choice(({"t": 99.0}, {"record": b["record"] + "x"}, {"parent": "p"})))
        for side, out in zip(sides, (old, new), strict=True):
            out.append(capture(side, f"{n:03d}", model=draw.choice(("m", "m", "k"))))
    once = run(spark, old, new)
    assert once == [one_by_one(a, b) for a, b in zip(old, new, strict=True)]
    again = run(spark, once, new)
    same = lambda rows: [{k: v for k, v in r.items() if k not in ("model", "terminal")} for r in rows]
    assert [r["blocks"] for r in again] == [r["blocks"] for r in once]
    stable = [i for i, r in enumerate(once) if not r["conflict"]]
    assert same([again[i] for i in stable]) == same([once[i] for i in stable])


def test_first_captures_and_charges(spark):
    rows = [("r", "s", 2, None, False, None, True, "b", None, 1, 2.0, (4, 1, 9)), ("r", "s", 1, "m", True, None, True, "a", None, 0, 1.0, (4, 1, 3)), ("r", "s", 3, "k", None, None, None, "c", "b", 2, 3.0, None)]
    schema = "response string, source string, line int, model string, aborted boolean, truncated boolean, stable boolean, record string, parent string, index long, t double, usage struct<input: long, cached: long, output: long>"
    (copy,) = history.copies(spark.createDataFrame(rows, schema)).collect()
    assert ([b["record"] for b in copy["blocks"]], copy["terminal"], copy["model"], copy["aborted"], copy["truncated"], copy["stable"]) == (["a", "b", "c"], "b", "k", True, False, True)
    (row,) = history.charged(history.copies(spark.createDataFrame(rows, schema))).collect()
    assert tuple(row["usage"]) == (4, 1, 9) and row["partial"] and row["blocks"] == 3 and not row["conflict"]
