"""Facts of records, coverage, cost checks and rules of windows, on cases that were calculated by hand."""

from pyspark.sql import functions as F

from ledgerloom.operators import latency, records


def test_efforts_conflict_or_are_missing(spark):
    rows = spark.createDataFrame([("low", None), (None, "high"), ("low", "low"), ("low", "high"), ("odd", "high"), ("low", "odd"), (None, None)], "a string, b string")
    effort, flaw = records.effort_of(F.col("a"), F.col("b"))
    assert [tuple(r) for r in rows.select(effort, flaw).collect()] == [("low", None), ("high", None), ("low", None), (None, "conflict"), (None, "missing"), ("low", None), (None, "missing")]


def test_a_response_agrees_with_its_only_iteration(spark):
    rows = spark.createDataFrame([([(1, 2)], (1, 2)), ([(1, 3)], (1, 2)), ([(1, 2), (1, 2)], (1, 2)), ([], (1, 2)), (None, (1, 2))], "parts array<struct<a:long,b:long>>, top struct<a:long,b:long>")
    n, agree = records.iterations(F.col("parts"), F.col("top"))
    assert [tuple(r) for r in rows.select(n, agree).collect()] == [(1, True), (1, False), (2, False), (0, False), (None, None)]


def test_what_is_charged_and_what_is_partial(spark):
    rows = spark.createDataFrame([("<synthetic>", True, True, None), ("m", True, None, None), ("m", None, False, True), (None, False, False, False)], "model string, error boolean, aborted boolean, cut boolean")
    got = rows.select(records.excluded(F.col("model"), F.col("error")), records.partial(F.col("aborted"), F.col("cut"))).collect()
    assert [tuple(r) for r in got] == [("synthetic", True), ("api_error", False), (None, True), (None, False)]


def test_months_with_a_failure_are_withheld(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "month string")
    failed = spark.createDataFrame([("b", "missing"), ("b", "calendar"), ("b", "missing"), ("z", "missing")], "month string, reason string")
    got = {r["month"]: (r["safe"], r["reasons"]) for r in records.month_coverage(rows, failed, "month").collect()}
    assert got == {"a": (True, []), "b": (False, ["calendar", "missing"]), "z": (False, ["missing"]), None: (True, [])}


def test_costs_are_checked_up_to_their_time(spark):
    checks = spark.createDataFrame([("a", 5, 10), ("a", 1, 4), ("z", 9, 3)], "key string, t long, reported long")
    ledger = spark.createDataFrame([("a", 2, 3), ("a", 5, 4), ("a", 5, None), ("a", 6, 100)], "key string, t long, cost long")
    got = records.cost_checks(checks, ledger, ["key"], "t", "reported", "cost").collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, 4, 0, 0, 4), ("a", 5, 10, 7, 1, 3), ("z", 9, 3, 0, 0, 3)]


def test_windows_break_each_rule_once(spark):
    windows = spark.createDataFrame([(100, 5, 9, 50, 10, 5, 2), (100, 5, 9, 50, 10, 5, 2), (1, 9, 5, 10, 20, 0, 1), (999, 0, 0, 5, 0, 0, 0)], "start long, first_percent long, peak long, input long, cached long, output long, responses long")
    splits = spark.createDataFrame([(1, "m", None, 4, 5, 1, 0, 0), (1, "m", None, 8, 2, 0, 1, 2)], "start long, model string, tier string, input long, cached long, written long, output long, responses long")
    got = {r["rule"]: r["n"] for r in records.window_rules(windows, splits, 50, 500).collect()}
    assert got == {
        "window_duplicate": 1, "window_before": 1, "window_future": 1, "window_first_peak": 1, "window_cached": 1, "window_no_responses": 1, "split_duplicate": 1, "split_cached": 1,
        "split_cache_write": 1, "split_no_responses": 1, "split_responses_total": 1, "split_input_total": 1, "split_cached_total": 0, "split_output_total": 1,
    }


def test_tools_and_turns_take_their_time(spark):
    calls = spark.createDataFrame([("a", 0, 10), ("a", 0, 20), ("b", 0, 100), ("b", 5, 5), ("c", 0, 9000), ("c", None, 3)], "tool string, start_t long, end_t long")
    assert [tuple(r) for r in latency.tool_times(calls).collect()] == [("b", 1, 100, 100.0, 100.0), ("a", 2, 30, 15.0, 19.0)]
    turns = spark.createDataFrame([("s", 0, 100), ("s", 1, 500), ("s", 2, 900)], "stream string, turn long, start_t long")
    timed = spark.createDataFrame([("s", 0, 150, 20, None), ("s", 0, 200, 30, None), ("s", 0, 180, 99, "start"), ("s", 1, 510, 40, None), ("s", 2, 900, 1, None)], "stream string, turn long, t long, seconds long, reason string")
    assert sorted(tuple(r) for r in latency.turn_times(turns, timed).collect()) == [("s", 0, 100, 0.5), ("s", 1, 10, 1.0)]
