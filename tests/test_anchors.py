"""Anchors against a walk over sorted resets, in any split of batches; unions of published windows."""

import random

from ledgerloom.operators import anchors

READING = "account string, kind string, scope string, reading_key string, resets_at double"
WINDOW = "account string, start long, first_percent int, peak int, responses long, input long, output long, split array<struct<model: string, tier: string, responses: long, input: long, output: long>>"


def capture(spark, rows, established=()):
    told, every = anchors.captured(spark.createDataFrame(rows, READING), spark.createDataFrame(list(established), anchors.ANCHOR))
    return {r["reading_key"]: (r["window_key"], r["reason"]) for r in told.collect()}, [tuple(r) for r in every.collect()]


def greedy(points, spread=2.0):
    out, low = {}, None
    for p in sorted(set(points)):
        if low is None or p - low > spread:
            low = p
        out[p] = low
    return out


def test_new_clusters_are_spans_from_the_least(spark):
    draw = random.Random(2)
    rows = [(draw.choice("ab"), "weekly_all", None, f"{i}", float(draw.randrange(0, 400)) / draw.choice((1, 2))) for i in range(500)]
    told, every = capture(spark, rows)
    for account in "ab":
        want = greedy([r[4] for r in rows if r[0] == account])
        groups = {}
        for r in rows:
            if r[0] == account:
                groups.setdefault(told[r[3]][0], set()).add(want[r[4]])
        assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(want.values()))
    assert len(every) == len({a[3] for a in every})


def test_any_split_of_batches_keeps_one_anchor_for_each_window(spark):
    draw = random.Random(4)
    rows = [("a", "weekly_scoped", draw.choice(("x", "y")), f"{i}", 1000.0 * draw.randrange(6) + draw.choice((0.0, 0.5, 1.0))) for i in range(120)]
    whole, _ = capture(spark, rows)
    draw.shuffle(rows)
    told, known = {}, []
    for part in (rows[:40], rows[40:50], rows[50:]):
        found, after = capture(spark, part, known)
        assert set(known) <= set(after)  # what was captured never moves
        told, known = told | found, after
    pairs = lambda keys: {frozenset(k for k in keys if keys[k] == v) for v in keys.values()}
    assert pairs(told) == pairs(whole)
    assert capture(spark, rows, known)[1] == known or set(capture(spark, rows, known)[1]) == set(known)


def test_ambiguous_invalid_and_phases(spark):
    known = [("a", "weekly_all", "", "k1", 100.0, 100.0, 100.0, 100.0), ("a", "weekly_all", "", "k2", 103.0, 103.0, 103.0, None), ("b", "session", "", "k3", 7.0, 6.0, 8.0, None)]
    rows = [("a", "weekly_all", None, "two", 101.5), ("a", "weekly_all", None, "one", 99.0), ("a", "weekly_all", "s", "new", 604_950.0), ("b", "weekly_all", None, "first", 50.0), ("b", "session", None, "wide", 5.9), ("b", "session", None, "in", 6.0),
            ("a", "monthly", None, "kind", 1.0), ("a", "weekly_scoped", "", "scope", 1.0), ("a", "session", None, "nan", float("nan")), ("a", "session", None, "none", None), ("a", "session", None, "less", -1.0)]
    told, every = capture(spark, rows, known)
    assert told["two"] == (None, "ambiguous") and told["one"] == ("k1", None) and told["in"] == ("k3", None)
    assert told["wide"][0] not in (None, "k3") and told["new"][0] not in (None, "k1", "k2")
    assert [told[k][1] for k in ("kind", "scope", "nan", "none", "less")] == ["unknown_kind", "unknown_scope", "reset_invalid", "reset_invalid", "reset_invalid"]
    assert set(known) <= set(every)
    phases = {(a[0], a[4]): a[7] for a in every if a[1] == "weekly_all"}
    assert phases == {("a", 100.0): 100.0, ("a", 103.0): None, ("a", 604_950.0): 100.0, ("b", 50.0): 50.0}
    off = anchors.departures(spark.createDataFrame(every, anchors.ANCHOR)).collect()
    assert [(r["account"], r["reset_at"]) for r in off] == [("a", 604_950.0)]
    assert capture(spark, [], known) == ({}, known) or set(capture(spark, [], known)[1]) == set(known)


def window(account, start, first, peak, n, split=()):
    return (account, start, first, peak, n, n, n, [("m", t, k, k, k) for t, k in split])


def union(spark, a, b):
    found = anchors.published(spark.createDataFrame(a, WINDOW), spark.createDataFrame(b, WINDOW))
    columns = [c.split()[0] for c in WINDOW.split(", ")]
    columns[-1] = "split"
    rows = found.select("account", "start", "first_percent", "peak", "responses", "input", "output", "split", "held").collect()
    return sorted((tuple(r)[:7], [tuple(s) for s in r["split"]], r["held"]) for r in rows)


def test_published_windows_only_advance(spark):
    old = [window("a", 1, 0, 50, 9), window("a", 2, 0, 50, 9, [("t", 4)]), window("a", 3, 0, 50, 9, [("t", 4), (None, 2)]), window("a", 4, 0, 50, 9), window("a", 5, 1, 50, 9), window("b", 1, 0, 9, 9)]
    new = [window("a", 1, 0, 60, 9), window("a", 2, 0, 50, 10, [("t", 3)]), window("a", 3, 0, 50, 10, [("t", 5), (None, 2), ("u", 1)]), window("a", 4, 0, 50, 8), window("a", 5, 0, 70, 99), window("a", 6, 0, 1, 1)]
    got = {r[0][:2]: (r[0][3], r[0][4], r[2]) for r in union(spark, old, new)}
    assert got == {("a", 1): (60, 9, False), ("a", 2): (50, 9, True), ("a", 3): (50, 10, False), ("a", 4): (50, 9, False), ("a", 5): (50, 9, True), ("a", 6): (1, 1, False), ("b", 1): (9, 9, False)}
    assert union(spark, old, old) == sorted((w[:7], [tuple(s) for s in w[7]], False) for w in old)
    comparable = [w for w in old if w[:2] not in (("a", 2), ("a", 5))], [w for w in new if w[:2] not in (("a", 2), ("a", 5))]
    assert union(spark, *comparable) == union(spark, *comparable[::-1])
