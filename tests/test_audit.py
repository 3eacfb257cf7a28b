"""Diagnostics, windows, plans, merges and image headers, on cases that were calculated by hand."""

import base64
import json
import struct

from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import audit


def test_snapshots_repeat_fall_and_disagree(spark):
    rows = spark.createDataFrame([("f", 1, 10, 3, 2, 5), ("f", 2, None, 3, 2, 5), ("f", 3, 9, 3, 2, 6), ("f", 4, 9, None, None, None), ("g", 1, 1, 0, 0, 0)], "file string, i long, total long, a long, b long, w long")
    got = audit.snapshot_diagnostics(rows, "file", ["i"], "total", ["a", "b"], "w").orderBy("file").collect()
    assert [tuple(r) for r in got] == [("f", 1, 1, 1), ("g", 0, 0, 0)]


def test_a_pair_across_a_compaction_is_compacted_alone(spark):
    asked = spark.createDataFrame([("s", 1, 1, "m", 100), ("s", 2, 2, "m", 50), ("s", 4, 3, "x", 40), ("s", 6, 4, "m", 30), ("s", None, 5, "m", 1)], "stream string, t long, id long, model string, tokens long")
    marks = spark.createDataFrame([("s", 6), ("z", 3), ("s", None)], "stream string, t long")
    assert [tuple(r) for r in audit.prompt_growth(asked, marks, "stream", "t", "id", "model", "tokens").collect()] == [("s", 3, 1, 1, 1)]


def test_a_window_ends_where_the_next_opens_and_late_readings_are_counted(spark):
    clusters = spark.createDataFrame([(1, 5, 10, 30, 0, 60), (2, 20, 25, 90, 70, 80), (3, 80, 95, 99, 1, 5)], "cluster long, anchor long, first_t long, last_t long, first_percent long, last_percent long")
    opened = audit.opened(clusters)
    assert [(r["opens_at"], r["inferred"], r["overlaps"], r["no_drop"], r["next_t"]) for r in opened.orderBy("cluster").collect()] == [(5, True, False, False, 25), (25, False, True, True, 95), (95, False, False, False, None)]
    readings = spark.createDataFrame([(1, 25, 50), (1, 26, 60), (1, 30, 55), (3, 200, 9)], "cluster long, t long, percent long")
    assert sorted(tuple(r) for r in audit.late_readings(readings, opened).collect()) == [(1, 1, 2, 60), (3, 1, 0, None)]


def test_weekly_windows_are_chosen_else_the_longest(spark):
    of = lambda lengths: {r["minutes"]: r["chosen"] for r in audit.window_lengths(spark.createDataFrame([(m,) for m in lengths], "minutes long"), "minutes").collect()}
    assert of([300, 10080, 43200]) == {300: False, 10080: True, 43200: False}
    assert of([300, 600, None]) == {300: False, 600: True, None: False}
    assert of([]) == {}


def test_a_plan_holds_if_all_looks_from_the_last_before_agree(spark):
    windows = spark.createDataFrame([("early", 5, 8), ("tie", 10, 12), ("late", 35, 40), ("turned", 36, 30), ("none", None, 3)], "window string, start_t long, end_t long")
    looks = lambda *rows: spark.createDataFrame(rows, "t long, plan string, created long")
    got = lambda s: {r["window"]: (r["plan"], r["conflict"]) for r in audit.plans_of(windows, s).collect()}
    mixed = got(looks((10, "pro", 1), (20, "max", 1), (30, "max", 1)))
    assert mixed == {"early": (None, True), "tie": (None, True), "late": ("max", False), "turned": (None, False), "none": (None, mixed["none"][1])}
    assert got(looks((10, "pro", 1), (20, "pro", 6)))["early"] == (None, False)
    assert got(looks((10, "pro", 1), (20, "pro", 5)))["early"] == ("pro", False)
    assert got(looks((10, "pro", 1), (20, None, 1)))["late"] == (None, False)
    assert set(got(looks()).values()) == {(None, False)}


def test_merging_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (4, None)], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, "n"), (4, None)], "id long, v string")
    once = audit.reconciled(old, new, ["id"], ["v"])
    assert {tuple(r) for r in once.collect()} == {(1, "a", "kept"), (2, "c", "revised"), (3, "d", "new"), (None, "n", "same"), (4, None, "same")}
    twice = audit.reconciled(once, new, ["id"], ["v"])
    assert {tuple(r)[:2] for r in twice.collect()} == {tuple(r)[:2] for r in once.collect()} and not twice.where("state IN ('new', 'revised')").count()
    assert {tuple(r) for r in audit.table_diff(old, new, ["id"], ["v"]).collect()} == {(1, "removed"), (2, "changed"), (3, "added")}


def test_first_calendars_and_receipts_hold(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, "y", 5), (3, "z", 5)], "id long, day string, n long")
    captured = spark.createDataFrame([(1, "w"), (3, None)], "id long, day string")
    assert sorted((r["id"], r["day"]) for r in audit.frozen(rows, captured, "id", ["day"]).collect()) == [(1, "w"), (2, "y"), (3, None)]
    receipts = spark.createDataFrame([(1, "x", 5), (2, "q", 4), (3, "z", 6), (9, "x", 1)], "id long, day string, n long")
    assert sorted(tuple(r) for r in audit.receipt_failures(receipts, rows, "id", "n", "day").collect()) == [(2, "calendar"), (3, "decreased"), (9, "missing")]


def test_headers_name_the_size_of_an_image(spark):
    riff = b"RIFF\0\0\0\0WEBP"
    whole = {
        "png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480), "gif": b"GIF89a" + struct.pack("<HH", 300, 200),
        "bmp": b"BM" + bytes(16) + struct.pack("<ii", 70, -50), "extended": riff + b"VP8X" + bytes(8) + struct.pack("<I", 999)[:3] + struct.pack("<I", 499)[:3],
        "lossless": riff + b"VP8L" + bytes(5) + struct.pack("<I", (1919) | (1079 << 14)), "lossy": riff + b"VP8 " + bytes(10) + struct.pack("<HH", 320, 240),
        "jpeg": b"\xff\xd8\xff\xe0", "cut": b"\x89PNG\r\n\x1a\n\0", "other": b"hello there",
    }
    rows = [(k, base64.b64encode(v + bytes(40 if k not in ("cut", "other") else 0)).decode()) for k, v in whole.items()] + [("empty", ""), ("null", None)]
    got = {r["k"]: tuple(r["h"]) if r["h"] else None for r in spark.createDataFrame(rows, "k string, v string").select("k", scalar.image_header(F.col("v")).alias("h")).collect()}
    assert got == {"png": ("png", 640, 480), "gif": ("gif", 300, 200), "bmp": ("bmp", 70, 50), "extended": ("webp", 1000, 500), "lossless": ("webp", 1920, 1080), "lossy": ("webp", 320, 240), "jpeg": ("jpeg", None, None), "cut": None, "other": None, "empty": None, "null": None}


def test_claims_and_escapes(spark):
    body = base64.urlsafe_b64encode(json.dumps({"plan": "pro>?~", "a.b": "x"}).encode()).decode().rstrip("=")
    rows = spark.createDataFrame([(f"h.{body}.s",), (f"h.{body}",), ("a.!.c",), ("",), (None,)], "v string")
    assert [r[0] for r in rows.select(scalar.claim(F.col("v"), "plan")).collect()] == ["pro>?~", None, None, None, None]
    assert rows.select(scalar.claim(F.col("v"), "a.b")).first()[0] == "x"
    assert spark.range(1).select(scalar.escaped(F.lit("<a href=\"x\">'&amp;"))).first()[0] == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;amp;"
