"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a piecewise linear schedule over training time 0 to 1. Its integral
gives the source's share of the budget, and the running integral its cumulative demand.
The source's documents stand in a fixed pseudo-random order, pass after pass; the place of
a document in that order, in words, is inverted through the cumulative demand to the
training position at which the mix needs it. training_order() range-sorts by position.

Defined results: a null or wordless text has size 0 and takes 0 words at position null; a
null source is a source of its own, last in order; equal rows are interchangeable; an empty
table gives an empty result; repeated rows each get their own place; extra columns are ignored
by plan() and kept by mix(), whatever their names. Sources are rows of one window, so they are
thought to be thousands at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, stored

#: Knots (time, weight) of the schedules dealt to the sources in order, again and again.
#: Their integrals are 3, 1 and 2; the first falls, the second rises, the third is level.
SCHEDULES = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 2.0), (1.0, 2.0)))
#: Documents of a source whose running sums one window computes.
BUCKET_ROWS = 4096


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def _segments(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(t0, t1, w0, w1, integral before t0) of each stretch between two knots."""
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        if t1 <= t0 or min(w0, w1) < 0:
            raise ValueError("knots must ascend and weights must not be negative")
        out.append((t0, t1, w0, w1, done))
        done += (t1 - t0) * (w0 + w1) / 2
    if done <= 0:
        raise ValueError("a schedule must have weight")
    return out


def integral(schedule: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for t0, t1, w0, w1, _ in _segments(schedule))


def _invert(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which the schedule's running integral is share of the whole."""
    need = share * F.lit(integral(schedule))
    at: Column | None = None
    for t0, t1, w0, w1, before in reversed(_segments(schedule)):
        rest, slope = need - F.lit(before), (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = rest, in the form without cancellation
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        x = F.when(rest <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (F.lit(w0) + root))
        here = F.lit(t0) + F.least(x, F.lit(t1 - t0))
        at = here if at is None else F.when(rest < (t1 - t0) * (w0 + w1) / 2, here).otherwise(at)
    return at


def source_targets(sizes: DataFrame, budget: float = 1.5, cap: float = 2.0, schedules=SCHEDULES) -> DataFrame:
    """(source, source_size, n_rows, schedule, weight, target) from (source, size).

    Sources ascend by code point, null last. The budget is a multiple of all sizes. A
    target stops at cap times its source's size and the excess is shared again, by weight,
    among the others until none is above; that is one water level, found by sorting the
    sources by size for weight. Runs on one row for each source.
    """
    weights = F.array(*[F.lit(integral(s)) for s in schedules])
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = stats.withColumn("schedule", ((F.row_number().over(order) - 1) % len(schedules)).cast("int")).withColumn("weight", F.element_at(weights, F.col("schedule") + 1))
    everything = Window.partitionBy()
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = (
        ranked.withColumn("_budget", F.sum("source_size").over(everything) * budget)
        .withColumn("_full", F.sum(F.col("source_size") * cap).over(upto) - F.col("source_size") * cap)
        .withColumn("_weight", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("_open", F.col("weight") * (F.col("_budget") - F.col("_full")) / F.col("_weight") <= F.col("source_size") * cap)
        # those that are not open are at their cap; what they leave and who shares it:
        .withColumn("_rest", F.col("_budget") - F.coalesce(F.sum(F.when(~F.col("_open"), F.col("source_size") * cap)).over(everything), F.lit(0.0)))
        .withColumn("_sharing", F.sum(F.when(F.col("_open"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("_open"), F.col("weight") * F.col("_rest") / F.col("_sharing")).otherwise(F.col("source_size") * F.lit(cap))
    return shared.select("source", "source_size", "n_rows", "schedule", "weight", target.cast("double").alias("target"))


def plan(docs: DataFrame, budget: float = 1.5, cap: float = 2.0, schedules=SCHEDULES, whole: bool = False, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, passes.

    passes lists (pass, words, position), one for each time the mix takes the document:
    how many of its words and at which training time. Words up to the rounded target are
    taken; the document that crosses it gives its first words or, with whole, all of them
    if its middle lies before the target.

    The running sum of a source is a window over (source, bucket), 4,096 rows or so each,
    on top of the sums of the buckets, so a source with a third of all rows is spread.
    """
    return _plan(materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))), budget, cap, schedules, whole)


def _plan(sizes: DataFrame, budget: float, cap: float, schedules, whole: bool) -> DataFrame:
    """plan() of (doc_id, source, size); a column row is carried along."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    carried = [c for c in ("row",) if c in sizes.columns]
    targets = materialize(source_targets(sizes, budget, cap, schedules))
    rows = (
        sizes.withColumnRenamed("source", "_source").join(targets, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
        .withColumn("_key", key)
        .withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.ceil(F.col("n_rows") / BUCKET_ROWS) / F.lit(2**32)))
    )
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size", *carried).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_within", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn("_offset", F.col("_within") + F.col("_ahead"))
    limit = F.floor(F.col("target") + 0.5).cast("long")

    def at(number: Column) -> Column:
        start = F.col("_offset") + number * F.col("source_size")
        words = F.when(start * 2 + F.col("size") <= limit * 2, F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least(F.col("size"), limit - start))
        share = (start + F.col("size") / 2) / F.col("target")
        when = F.coalesce(*[F.when(F.col("schedule") == i, _invert(share, s)) for i, s in enumerate(schedules)])
        return F.struct(number.cast("int").alias("pass"), words.cast("long").alias("words"), F.least(when, F.lit(1.0)).alias("position"))

    last = F.greatest(F.ceil(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(1))
    passes = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce(last, F.lit(1)) - 1), at), lambda p: p["words"] > 0)
    return placed.select("doc_id", "source", "size", "source_size", "target", passes.alias("passes"), *carried)


def training_order(planned: DataFrame) -> DataFrame:
    """(doc_id, source, pass, words, position), range-sorted by training position."""
    each = planned.select("doc_id", "source", F.explode("passes").alias("p")).select("doc_id", "source", "p.*")
    return each.orderBy("position", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "pass")


def mix(docs: DataFrame, budget: float = 1.5, cap: float = 2.0, schedules=SCHEDULES, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that the mix takes, once for each pass, range-sorted by training position.

    Takes whole documents. The rows are numbered and written once, in the shared folder, and the plan is joined by
    number: rows that are equal each have their own places. A source's order hangs on doc_id, source and text alone.
    """
    names = docs.columns
    of = F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{source}`"), F.col(f"`{text}`"))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), of.alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(text).alias("size"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc")))
    planned = _plan(rows.select("row", "doc_id", "source", "size"), budget, cap, schedules, True)
    each = planned.select("row", "doc_id", F.explode("passes").alias("p")).select("row", "doc_id", F.col("p.pass").alias("pass"), F.col("p.position").alias("position"))
    placed = rows.select("row", "doc").join(each, "row").orderBy("position", "doc_id", "row", "pass")
    return placed.select(*(F.col("doc").getField(c).alias(c) for c in names))
