"""Rules that the tables do not show: planted pace, replay, carried values, streaming equal to batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import latency, ledger, limits, pricing, rollups
from ledgerloom.streaming import streams


def test_pace_recovers_planted_parameters():
    rng = np.random.default_rng(3)
    output, uncached = rng.integers(50, 4000, 3000).astype(float), rng.integers(100, 60_000, 3000).astype(float)
    seconds = 1.5 + output / 50 + uncached / 5000 + rng.exponential(2.0, 3000) * (rng.random(3000) < 0.7)
    overhead, per_output, per_uncached = latency.pace(seconds, output, uncached)
    assert abs(overhead - 1.5) < 0.1
    assert abs(1 / per_output - 50) < 1.5
    assert abs(1 / per_uncached - 5000) < 400


def test_pace_drops_constant_columns():
    overhead, per_output, per_uncached = latency.pace(np.full(50, 2.0), np.full(50, 10.0), np.full(50, 10.0))
    assert abs(overhead - 2) < 1e-3 and per_output == per_uncached == 0


def test_leading_replay_wants_an_unbroken_run(spark):
    child = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b"), ("c", 3, "x"), ("e", 1, "z")], "child string, pos long, state string")
    history = spark.createDataFrame([("c", "p", 1, "q"), ("c", "p", 2, "a"), ("c", "p", 3, "b"), ("c", "p", 5, "x"), ("e", "p", 1, "a")], "child string, ancestor string, pos long, state string")
    assert [tuple(r) for r in ledger.leading_replay(child, history).collect()] == [("c", 2)]


def test_repeat_collapse_keeps_a_state_that_returns(spark):
    rows = spark.createDataFrame([("s", 1, 5), ("s", 2, 5), ("s", 3, 6), ("s", 4, 5), ("s", 5, None), ("s", 6, None)], "s string, i int, x int")
    assert [r["i"] for r in ledger.collapse_repeats(rows, "s", ["i"], ["x"]).orderBy("i").collect()] == [1, 3, 4, 5]


def test_first_response_never_merges_null_ids(spark):
    rows = spark.createDataFrame([("s", "a", 1), ("s", "a", 2), ("s", None, 3), ("s", None, 4)], "s string, r string, i int")
    assert sorted(r["i"] for r in ledger.first_response(rows, "s", "r", ["i"]).collect()) == [1, 3, 4]


def test_chain_clusters_follow_the_previous_reset(spark):
    merged = spark.createDataFrame([(0, 1, 0, 0, 1), (3600, 1, 1, 1, 2), (7200, 1, 2, 2, 3), (10801, 1, 3, 3, 0)], "resets_at long, n long, first_t long, last_t long, high long")
    assert [(r["reset_low"], r["reset_at"], r["peak"]) for r in limits.chain_clusters(merged).orderBy("cluster").collect()] == [(0, 7200, 3), (10801, 10801, 0)]


def test_ratio_of_nothing_is_null(spark):
    assert spark.range(1).select(rollups.ratio(F.lit(1), F.lit(0)).alias("x")).first()["x"] is None


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streams.hourly_counts(live).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("hours")) == key(streams.hourly_counts(events))


def test_images_cost_what_was_calculated_by_hand(spark):
    sizes = spark.createDataFrame([(1024, 1024), (1800, 2400), (512, 512), (0, 10), (4096, 8192)], "w int, h int")
    got = [tuple(r) for r in sizes.select(scalar.patch_cost(F.col("w"), F.col("h")), scalar.tile_cost(F.col("w"), F.col("h"))).collect()]
    # 32 x 32 patches; 33 x 44; 16 x 16; none; 27 x 54. Tiles of 768 x 768, 768 x 1024, 512 x 512, none, 768 x 1536
    assert got == [(1024, 765), (1452, 765), (256, 255), (0, 0), (1458, 1105)]


def test_a_response_starts_with_its_request(spark):
    rows = [("s", 1, 100, 90), ("s", 2, 110, 95), ("s", 3, 200, None), ("s", 4, 205, 205), ("s", 5, 9000, 300), ("r", 6, 50, 20)]
    ledger_ = spark.createDataFrame(rows, "stream string, response_id long, t long, req long")
    got = {r["response_id"]: (r["seconds"], r["reason"]) for r in latency.samples(ledger_).collect()}
    assert got == {1: (10, None), 2: (10, None), 3: (None, "no_start"), 4: (0, "not_positive"), 5: (8700, "too_long"), 6: (30, None)}


def test_ties_go_to_the_lexically_first_model(spark):
    rows = spark.createDataFrame([("s", "ab", 5, 1), ("s", "a", 5, 2)], "stream string, model string, input long, t long")
    assert rollups.sessions(rows).first()["model"] == "a"


def test_ancestors_of_a_deep_chain_and_a_cycle(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 81)] + [(200, 201), (201, 200), (300, 300)], "node long, parent long")
    got = ledger.ancestors(links, "node", "parent").collect()
    assert {(r["node"], r["ancestor"]): r["distance"] for r in got if r["node"] == 80} == {(80, 80 - k): k for k in range(1, 81)}
    assert sorted((r["node"], r["ancestor"]) for r in got if r["node"] >= 200) == [(200, 201), (201, 200)]
    kinds = {r["node"]: (r["root"], r["status"]) for r in ledger.families(links, "node", "parent").collect()}
    assert kinds[80] == (0, "ok") and kinds[0] == (0, "ok") and kinds[200] == (None, "cycle")


def test_prices_by_hand(spark):
    table = pricing.prices(spark, (("m", "standard", 2, 1, 3, 10, 4, None, None, 20), ("m", "fast", 4, 2, None, 20, None, None, None, None), ("n", "standard", 1, None, None, 1, None, None, None, None)))
    rows = [(1, "m", "default", 100, 40, 30, 5), (2, "M-2025-01-02", None, 100, 40, 30, 5), (3, "m", "auto", 200_000, 50, 0, 10), (4, "m", "priority", 200_000, 0, 0, 1), (5, "n", "fast", 1, 0, 0, 1), (6, "x", None, 1, 0, 0, 1), (7, "n", None, 10, 20, 9, 1)]
    ledger_ = spark.createDataFrame(rows, "id int, model string, tier string, input long, cached long, written long, output long")
    got = {r["id"]: (r["micros"], r["micros_high"], r["reason"]) for r in pricing.priced(ledger_, table).collect()}
    assert got == {
        1: (30 * 2 + 40 + 90 + 50, 240, None), 2: (240, 30 * 4 + 80 + 30 * 4 + 100, None), 3: (200_000 * 4 + 200, 800_200, None),
        4: (None, None, "long_context"), 5: (None, None, "tier"), 6: (None, None, "model"), 7: (11, 11, None),
    }
    with pytest.raises(ValueError):
        pricing.prices(spark, (("m", "standard", -1, None, None, 1, None, None, None, None),))


def test_prices_join_without_moving_the_ledger(spark):
    ledger_ = spark.range(1000).selectExpr("id", "IF(id % 2 = 0, 'view', 'click') AS model", "IF(id % 3 = 0, 'auto', 'fast') AS tier", "id AS input", "0L AS cached", "1L AS output")
    plan = pricing.priced(ledger_, pricing.prices(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_pace_lines_of_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, i * 60, float(2.0 + out / 40 + unc / 4000 + rng.exponential(1.0) * (rng.random() < 0.5)), out, unc, 0, None) for g in "ab" for i in range(600) for out, unc in [(int(rng.integers(50, 3000)), int(rng.integers(100, 40_000)))]]
    rows += [("c", i, i, 1.0, 10, 10, 0, None) for i in range(39)] + [("a", 9000, 1, None, 1, 1, 0, "no_start")]
    timed = spark.createDataFrame(rows, "model string, response_id long, t long, seconds double, output long, input long, cached long, reason string")
    lines = latency.pace_lines(timed, "model")
    got = {r["model"]: r for r in lines.collect()}
    assert set(got) == {"a", "b"} and all(r["n"] == 600 and abs(r["overhead"] - 2) < 0.3 and abs(1 / r["per_output"] - 40) < 2 for r in got.values())
    over = {r["model"]: r for r in latency.above_pace(timed, lines, "model").collect()}
    assert over["c"]["above"] is None and over["a"]["n"] == 600 and 0.3 < over["a"]["above"] / 600 < 0.7


def test_numbers_of_a_group_over_many_days(spark):
    rows = spark.createDataFrame([("a", i, i * 40_000) for i in range(50)] + [(None, i, 7) for i in range(3)], "g string, id long, t long")
    got = {(r["g"], r["id"]): (r["_i"], r["_n"]) for r in limits.numbered(rows, ["g"], "t", ["t", "id"]).collect()}
    assert got == {**{("a", i): (i, 50) for i in range(50)}, **{(None, i): (i, 3) for i in range(3)}}


def test_span_clusters_stay_within_their_spread(spark):
    merged = spark.createDataFrame([(100, 1), (101, 2), (102, 1), (103, 5), (104, 1), (200, 1)], "resets_at long, n long")
    assert sorted(tuple(r) for r in limits.span_clusters(merged).collect()) == [(100, 102, 4), (103, 104, 6), (200, 200, 1)]


def test_times_and_counts(spark):
    texts = spark.createDataFrame([("2026-03-08T23:59:30Z",), ("2026-03-08T01:00:00+08:00",), ("2026-03-08T01:00:00",), ("2026-03-08",), ("no",)], "x string")
    x = F.col("x")
    got = [tuple(r) for r in texts.select(scalar.local_day(x, 60), scalar.strict_epoch_s(x).isNotNull(), scalar.epoch_s(x).isNotNull()).collect()]
    assert got == [("2026-03-09", True, True), ("2026-03-07", True, True), ("2026-03-08", False, True), ("2026-03-08", False, True), (None, False, False)]
    a, b = scalar.day_span(F.lit("2024-03-10").cast("date"), "America/New_York")
    assert spark.range(1).select(b - a).first()[0] == 23 * 3600
    values = spark.createDataFrame([(1.9,), (-2.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in values.select(scalar.count_of(F.col("v"))).collect()] == [1, 0, 0, 0, 0]
    one = spark.range(1).select(scalar.median_half_up(F.array(*map(F.lit, (1, 2, 4, 5)))), scalar.price_cell(F.lit("$1,250.5")), scalar.price_cell(F.lit("-")), scalar.shown_seconds(F.lit(185)), scalar.shown_count(F.lit(1234567)), scalar.off_grid(F.lit(604_803), F.lit(0)), scalar.preview(F.lit(" a \n b ")), scalar.tier_class(F.lit("Priority")))
    assert tuple(one.first()) == (3, 1250.5, None, "3m05s", "1.23M", True, "a b", "fast")
