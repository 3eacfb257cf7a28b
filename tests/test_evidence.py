"""Prompt chains, calls, facts, budgets and plausibility, on cases that were calculated by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import evidence, prompts


def test_prompts_share_the_shorter_range_until_a_reset(spark):
    items = spark.createDataFrame([("s", 1, 100, False), ("s", 2, 50, False), ("s", 3, 30, True), ("s", 4, 20, False), ("z", 1, 7, False)], "stream string, place long, tokens long, reset boolean")
    placed = prompts.placed(items, "stream", ["place"], "tokens", F.col("reset"))
    rows = prompts.stable_prefix(placed, "stream", ["place"]).orderBy("stream", "place").collect()
    assert [(r["segment"], r["start"], r["end"], r["stable"]) for r in rows] == [(0, 0, 100, 0), (0, 100, 150, 100), (1, 0, 30, 0), (1, 30, 50, 30), (0, 0, 7, 0)]
    again = prompts.resends(placed, "stream", ["place"], F.lit(True)).orderBy("stream", "place").collect()
    assert [r["resent"] for r in again] == [1, 0, 1, 0, 0]
    leads = prompts.divergence_leads(prompts.stable_prefix(placed, "stream", ["place"]).withColumn("cached", F.lit(10)), "place", least=20, most=1)
    assert [(r["place"], r["gap"]) for r in leads.collect()] == [(2, 90)]


def test_runs_break_at_gaps_and_thin_spans(spark):
    series = spark.createDataFrame([("m", 0, 10, 9), ("m", 12, 20, 9), ("m", 20, 30, 1), ("m", 30, 40, 9)], "key string, s long, e long, n long")
    assert sorted(tuple(r) for r in prompts.runs(series, "key", "s", "e", "n", most_gap=5).collect()) == [("m", 0, 20, 2), ("m", 30, 40, 1)]


def test_an_output_answers_the_last_open_call(spark):
    events = [(1, "a", True), (2, "a", True), (5, "a", False), (6, "a", False), (7, "b", True), (8, "c", False)]
    rows = spark.createDataFrame([("f", *e) for e in events], "file string, t long, id string, is_call boolean")
    got = evidence.answered(rows, "file", "id", ["t"], F.col("is_call")).orderBy("t").collect()
    assert [(r["outcome"], r["seconds"]) for r in got] == [("replaced", None), ("answered", None), ("matched", 3), ("orphan", None), ("open", None), ("orphan", None)]
    pairs = evidence.single_pairs(rows, ["id"], F.col("is_call")).orderBy("id").collect()
    assert [(r["starts"], r["results"], r["seconds"], r["conflict"]) for r in pairs] == [(2, 2, None, True), (1, 0, None, False), (0, 1, None, False)]


def test_facts_budgets_and_prefixes(spark):
    facts = spark.createDataFrame([("k", None, "late"), ("k", 4, "b"), ("k", 3, "a"), (None, 1, "n")], "key string, t long, v string")
    assert sorted((tuple(r) for r in evidence.unique_facts(facts, ["key"], ["t"], ["v"]).collect()), key=repr) == [("k", "a", 2), (None, "n", 0)]
    rows = spark.createDataFrame([(w, x) for w in (1, 2, 3) for x in range(4)], "w long, x long")
    kept = evidence.within_budget(rows, "w", ["x"], each=3, total=7).collect()
    assert sorted((r["w"], r["x"]) for r in kept) == [(2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2)]
    assert evidence.resolved(facts, "v", "la") == "late"
    with pytest.raises(ValueError, match="no session"):
        evidence.resolved(facts, "v", "x")
    with pytest.raises(ValueError, match="several"):
        evidence.resolved(facts.union(facts.selectExpr("key", "t", "concat(v, 2)")), "v", "la")


def test_rules_count_each_break(spark):
    days = spark.createDataFrame([("1970-01-01",)], "day string").select(F.to_date("day").alias("day"))
    sessions = spark.createDataFrame([("a", 0, 100, 101), ("b", 50, 40, 0), ("c", 0, 10, 12), ("d", 90_000, 90_001, 1), ("e", 0, 401 * 86_400, 31 * 86_400), ("a", 0, 100, 101)], "session string, first_t long, last_t long, active_s long")
    got = {r["rule"]: r["n"] for r in evidence.session_rules(sessions, days).collect()}
    assert got == {"duplicate": 1, "reversed": 1, "long_span": 1, "active_over_span": 2, "active_bound": 1, "day_missing": 1}
    groups = spark.createDataFrame([(1, 2.0, 3.0), (0, None, None), (5, 9.0, 8.0), (2, 0.0, 4000.0)], "n long, median double, p90 double")
    assert {r["rule"]: r["n"] for r in evidence.latency_rules(groups).collect()} == {"no_samples": 1, "not_positive": 1, "median_over_p90": 1, "over_cap": 1}


def test_recorded_counts_splits_and_resets(spark):
    counts = spark.createDataFrame([(x,) for x in ("5", None, "-1", "1.5", "x", "2e12", "0")], "v string").select(*[c.alias(n) for n, c in zip(("value", "flaw"), scalar.optional_count(F.col("v")), strict=True)])
    assert [tuple(r) for r in counts.collect()] == [(5, None), (None, "missing"), (None, "invalid"), (None, "invalid"), (None, "invalid"), (None, "ceiling"), (0, None)]
    splits = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (-1, 4, 3), (None, 3, 3)], "a long, b long, c long")
    assert [r[0] for r in splits.select(scalar.split_holds(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, False, False, False]
    resets = spark.createDataFrame([("1000", None), ("1970-01-01T00:01:00Z", None), (None, 30), ("-5", 30), ("x", None)], "r string, s long")
    assert [r[0] for r in resets.select(scalar.reset_at(F.col("r"), F.col("s"), F.lit(100))).collect()] == [1000.0, 60.0, 130.0, 130.0, None]
