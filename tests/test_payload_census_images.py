"""Months within a budget, key censuses and image fits against brute force."""

import json
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import payload
from ledgerloom.plans.catalog import QUERIES
from ledgerloom.sources import census


def test_fits_are_the_largest_of_all_edges(spark):
    draw = random.Random(6)
    rows = [(draw.randrange(1, 9000), draw.randrange(1, 9000), *draw.choice(((1568, 1568), (2576, 4784), (280, 40), (28, 1), (27, 5)))) for _ in range(2000)]
    rows += [(0, 5, 1568, 1568), (5, -1, 1568, 1568), (8192, 8192, 8191, 10**6), (1, 1, 1568, 1568), (9000, 1, 1568, 1568)]
    df = spark.createDataFrame(rows, "w long, h long, e long, t long")
    found = df.select("*", scalar.patch_fit(F.col("w"), F.col("h"), F.col("e"), F.col("t")).alias("x")).collect()

    def largest(w, h, e, t):
        if w <= 0 or h <= 0:
            return None
        long_, short = max(w, h), min(w, h)
        for edge in range(min(long_, e), 0, -1):
            other = max(1, round(short * edge / long_))
            a, b = -(-edge // 28), -(-other // 28)
            if a * 28 <= e and b * 28 <= e and a * b <= t:
                return (edge, other, a * b) if w >= h else (other, edge, a * b)
        return None

    for r in found:
        assert (tuple(r["x"]) if r["x"] else None) == largest(r["w"], r["h"], r["e"], r["t"]), tuple(r)


def test_fits_of_long_sides(spark):
    """30,000 pixels take more halvings than 8,192."""
    df = spark.createDataFrame([(40_000, 3, 30_000, 10**9), (7, 65_000, 60_001, 10**9), (None, 5, 99, 99), (5, 5, None, 99), (5, 5, 99, None)], "w long, h long, e long, t long")
    found = [r["x"] and tuple(r["x"]) for r in df.select(scalar.patch_fit(F.col("w"), F.col("h"), F.col("e"), F.col("t")).alias("x")).collect()]
    assert found == [(29_988, 2, 1071), (6, 59_976, 2142), None, None, None]


def test_arguments_of_fits_are_computed_once(spark):
    """The limits come from a pattern over the model's name, which no step of the search may match again."""
    df = QUERIES["image_patch_fit"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "ArrowEvalPython" in plan and plan.count("_fitted_edge(") == 1


def test_limits_by_version(spark):
    names = {"m-x-4": 1568, "m-x-4-6": 1568, "m-x-4-7": 2576, "M-X-4-10": 2576, "m-x-5": 2576, "m-x-3-9": 1568, "m": None, None: None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["e"] for r in df.select("n", scalar.image_limits(F.col("n"))["max_edge"].alias("e")).collect()} == names


def walk(value, key, out):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    out.append((key, kind))
    for k, v in value.items() if isinstance(value, dict) else ():
        walk(v, f"{key}.{k}", out)
    for v in value if isinstance(value, list) else ():
        walk(v, f"{key}[]", out)


def test_census_is_a_walk(spark):
    draw = random.Random(9)

    def made(depth):
        pick = draw.randrange(8 if depth else 6)
        if pick == 6:
            return {draw.choice(("a", "b", "c d", "é")): made(depth - 1) for _ in range(draw.randrange(4))}
        return [made(depth - 1) for _ in range(draw.randrange(4))] if pick == 7 else draw.choice((1, 2.5, "s", True, None, 10**15, ""))

    rows = [(f"f{i % 4}", json.dumps(made(4))) for i in range(200)] + [("f9", json.dumps({f"k{i}": i for i in range(1000)})), ("f0", "{broken"), ("f0", ""), ("f0", None)]
    count, files = Counter(), defaultdict(set)
    for file, line in rows:
        try:
            value = json.loads(line)
        except (TypeError, ValueError):
            continue
        out = []
        walk(value, "$", out)
        for x in out:
            count[x] += 1
            files[x].add(file)
    found = census.key_census(spark.createDataFrame(rows, "path string, line string").repartition(3))
    assert {(r["key"], r["type"]): (r["n"], r["files"]) for r in found.collect()} == {x: (n, len(files[x])) for x, n in count.items()}
    assert census.key_census(spark.createDataFrame([], "path string, line string")).count() == 0


def test_census_moves_a_row_for_each_shape_in_a_file(spark, monkeypatch):
    moved = []
    monkeypatch.setattr(census, "cut", lambda df, cut=census.cut: moved.append((x := cut(df)).count()) or x)
    odd = {"`": 1, "a`b": {"``": None}, "a.b": "", "a: b": {"c>": True}, "BIGINT": "s", "OBJECT<": {"x": {}}, "(1,2)": {"12": 1, "": "DECIMAL(1,2)"}, "é\n": 0, "_": "ARRAY<", "VOID": {"STRING": {"k": 1e300}}}
    rows = [(f"f{i % 3}", json.dumps({**odd, "i": i + 0.5 * 10 ** -(i % 9)})) for i in range(300)] + [(f"f{i % 3}", json.dumps({"t": str(i)})) for i in range(300)] + [("f0", "[" + x) for x in ("", "}")]
    nested = [("f1", json.dumps({"a": [{"ARRAY<": [1, "s", {"b": i}]}, odd], "c": {"d": []}})) for i in range(40)]
    for more, most in (([], 6), (nested, None)):
        count, files = Counter(), defaultdict(set)
        for file, line in rows[:600] + more:
            walk(json.loads(line), "$", out := [])
            count.update(out)
            for x in out:
                files[x].add(file)
        moved.clear()
        found = census.key_census(spark.createDataFrame(rows + more, "path string, line string").repartition(3))
        assert {(r["key"], r["type"]): (r["n"], r["files"]) for r in found.collect()} == {x: (n, len(files[x])) for x, n in count.items()}
        assert most is None or sum(moved) <= most


def test_months_are_dropped_from_the_oldest(spark):
    draw = random.Random(1)
    days, sessions = [], []
    for account in "abcdef":
        for month in range(1, 10):
            n = draw.randrange(1, 12) if draw.random() < 0.9 else 40
            days += [(account, f"2026-0{month}", f"2026-0{month}-{d + 1:02d}", draw.randrange(1000)) for d in range(n)]
            sessions += [(account, f"2026-0{month}", "s" * draw.randrange(30)) for _ in range(draw.randrange(5))]
    days += [("a", "2026-03", "2026-03-30", 10**12), ("b", "2024-01", "2024-01-01", 1), ("c", "2026-09", None, 1)]
    limits = {"envelope": 50, "most_days": 31, "most_bytes": 1500}
    found = payload.months_within(spark.createDataFrame(days, "account string, month string, date string, input long"), spark.createDataFrame(sessions, "account string, month string, id string"), "2026-12-31", **limits)
    size = lambda rows, names: sum(len(json.dumps({k: v for k, v in zip(names, r[2:], strict=True) if v is not None}, separators=(",", ":"))) + 1 for r in rows)
    want = {}
    for account in "abcdef":
        own = {m: [r for r in days if r[:2] == (account, m)] for m in {r[1] for r in days if r[0] == account}}
        more = {m: [r for r in sessions if r[:2] == (account, m)] for m in own}
        left = {}
        for m, rows in own.items():
            rule = any(r[2] is None or not "2025-04-01" <= r[2] <= "2026-12-31" or r[3] > payload.MAX_DAY_INPUT for r in rows)
            want[account, m] = "rule" if rule else "alone" if len(rows) > 31 or size(rows, ("date", "input")) + 50 > 1500 else None
            if want[account, m] is None:
                left[m] = (len(rows), size(rows, ("date", "input")) + size(more[m], ("id",)))
        while left and (sum(n for n, _ in left.values()) > 31 or sum(b for _, b in left.values()) + 50 > 1500):
            want[account, min(left)] = "budget"
            del left[min(left)]
    assert {(r["account"], r["month"]): r["reason"] for r in found.collect()} == want
    assert {"rule", "alone", "budget", None} == set(want.values())
