"""Rate-limit windows from readings: merge, cluster, boundaries, curves, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_quotes(quotes: DataFrame) -> DataFrame:
    """One row for each announced reset."""
    return quotes.groupBy("resets_at").agg(
        F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min("percent").alias("low"), F.max("percent").alias("high"),
        F.min_by("percent", F.struct("t", "response_id")).alias("first_percent"), F.max_by("percent", F.struct("t", "response_id")).alias("last_percent"),
    )


def chain_clusters(merged: DataFrame, gap: int = 3600) -> DataFrame:
    """Resets that follow one another within gap seconds are one window. Over merged resets, a small table."""
    order = Window.orderBy("resets_at")
    new = F.when(F.col("resets_at") - F.lag("resets_at").over(order) > gap, 1).otherwise(0)
    return merged.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(order)).groupBy("cluster").agg(F.min("resets_at").alias("reset_low"), F.max("resets_at").alias("reset_at"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), F.max("high").alias("peak"), F.sum("n").alias("n"))


def boundaries(clusters: DataFrame) -> DataFrame:
    """Live windows (peak above 0) in order of first reading; one ends where the next begins."""
    order = Window.orderBy("first_t", "cluster")
    return clusters.where("peak > 0").select("cluster", F.col("first_t").alias("start_t"), F.lead("first_t").over(order).alias("end_t"), "reset_at", "peak", (F.lead("first_t").over(order) > F.col("reset_at")).alias("gap_after"))


def as_of(rows: DataFrame, marks: DataFrame, keys: list[str], time: str, mark_time: str, value: str) -> DataFrame:
    """rows with the value of the latest mark at or before each one's time; none before the first.

    Union and last(): one exchange on the keys, no range join.
    """
    both = rows.withColumn("_kind", F.lit(1)).withColumn("_value", F.lit(None).cast(dict(marks.dtypes)[value])).unionByName(
        marks.select(*keys, F.col(mark_time).alias(time), F.lit(0).alias("_kind"), F.col(value).alias("_value")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_kind = 1").drop("_kind", "_value")


def in_intervals(rows: DataFrame, intervals: DataFrame, time: str, start: str, end: str, width: int) -> DataFrame:
    """rows joined with each interval [start, end) that holds their time, by buckets of width seconds."""
    cut = intervals.withColumn("_b", F.explode(F.sequence(F.expr(f"{start} div {width}"), F.expr(f"greatest({start}, {end} - 1) div {width}"))))
    return rows.withColumn("_b", F.expr(f"{time} div {width}")).join(cut, "_b").where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_b")


def in_windows(rows: DataFrame, windows: DataFrame, time: str, start: str, end: str, width: int = 86_400) -> DataFrame:
    """in_intervals() with windows of which some never end: the latest of those takes what is after its start."""
    closed = in_intervals(rows, windows.where(f"{end} is not null"), time, start, end, width)
    # one row at most: the open window that begins last
    open_ = windows.where(f"{end} is null").orderBy(F.desc(start)).limit(1)
    return closed.unionByName(rows.join(F.broadcast(open_), F.col(time) >= F.col(start)).select(*closed.columns))


def overlaps(windows: DataFrame, key: str, start: str, end: str, width: int = 86_400) -> DataFrame:
    """(a, b): pairs of windows [start, end) that share a moment, each once."""
    cut = windows.withColumn("_b", F.explode(F.sequence(F.expr(f"{start} div {width}"), F.expr(f"greatest({start}, {end} - 1) div {width}"))))
    side = lambda s: cut.select(F.col(key).alias(s), F.col(start).alias(f"{s}_start"), F.col(end).alias(f"{s}_end"), "_b")
    met = side("a").join(side("b"), "_b").where((F.col("a") < F.col("b")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    return met.select("a", "b").distinct()


def span_clusters(merged: DataFrame, spread: int = 2) -> DataFrame:
    """Resets within spread seconds of their cluster's least one; a cluster begins with the least that none holds.

    Chains break first where a gap exceeds spread; inside a chain, a few seconds long, one pass assigns the clusters.
    """
    order = Window.orderBy("resets_at")
    chains = merged.withColumn("_new", F.when(F.col("resets_at") - F.lag("resets_at").over(order) > spread, 1).otherwise(0)).withColumn("_chain", F.sum("_new").over(order))
    listed = chains.groupBy("_chain").agg(F.sort_array(F.collect_list(F.struct("resets_at", "n"))).alias("x"))
    begin = F.array(F.struct(F.get("x", F.lit(0))["resets_at"].alias("low"), F.lit(0).cast("long").alias("n"), F.get("x", F.lit(0))["resets_at"].alias("high")))

    def add(done: Column, at: Column) -> Column:
        last = F.element_at(done, -1)
        fits = at["resets_at"] - last["low"] <= spread
        grown = F.struct(last["low"].alias("low"), (last["n"] + at["n"]).alias("n"), at["resets_at"].alias("high"))
        fresh = F.struct(at["resets_at"].alias("low"), at["n"].alias("n"), at["resets_at"].alias("high"))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    return listed.select(F.explode(F.aggregate("x", begin, add)).alias("c")).select(F.col("c.low").alias("reset_low"), F.col("c.high").alias("reset_high"), "c.n")


def running(rows: DataFrame, keys: list[str], order: list[str], value: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def bucket_last(rows: DataFrame, keys: list[str], time: str, order: list[str], value: str, seconds: int = 900) -> DataFrame:
    return rows.groupBy(*keys, F.expr(f"({time} div {seconds}) * {seconds}").alias("bucket")).agg(F.max_by(value, F.struct(*order)).alias(value))


def numbered(rows: DataFrame, keys: list[str], time: str, order: list[str], width: int = 86_400) -> DataFrame:
    """rows with _i, their number from 0 in the order of their group, which begins with time, and _n, how many it has.

    Numbers are counted inside each width of time and added to the counts of the widths before, so a group with all
    rows is spread over as many tasks as it spans widths.
    """
    placed = rows.withColumn("_w", F.expr(f"{time} div {width}"))
    counts = placed.groupBy(*keys, "_w").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)
    starts = counts.select(*keys, "_w", F.coalesce(F.sum("_c").over(group.orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_c").over(group).alias("_n"))
    inside = placed.withColumn("_within", F.row_number().over(Window.partitionBy(*keys, "_w").orderBy(*order)).cast("long") - 1)
    names = {c: f"_k{i}" for i, c in enumerate([*keys, "_w"])}
    starts = starts.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return inside.join(starts, same).withColumn("_i", F.col("_within") + F.col("_ahead")).drop("_w", "_within", "_ahead", *names.values())


def downsample(rows: DataFrame, keys: list[str], time: str, order: list[str], most: int = 120) -> DataFrame:
    """Of each group, most rows at even places, the first and the last among them."""
    even = F.expr(f"_i = (ceil(_i * {most - 1} / _n) * _n) div {most - 1} AND ceil(_i * {most - 1} / _n) < {most - 1}")
    kept = numbered(rows, keys, time, order).where((F.col("_n") <= most) | even | (F.col("_i") == F.col("_n") - 1))
    return kept.withColumnsRenamed({"_i": "i", "_n": "n"})


def observation_span(readings: DataFrame, key: str) -> DataFrame:
    """First reading, earliest reading at the peak, last reading; whether the percent ever fell, or two of one time differ."""
    w = Window.partitionBy(key)
    seen = readings.withColumn("_peak", F.max("percent").over(w)).withColumn("_before", F.lag("percent").over(w.orderBy("t", "percent", "response_id"))).withColumn("_t", F.lag("t").over(w.orderBy("t", "percent", "response_id")))
    return seen.groupBy(key).agg(F.min("t").alias("first_t"), F.max("percent").alias("peak"), F.min(F.when(F.col("percent") == F.col("_peak"), F.col("t"))).alias("peak_t"), F.max("t").alias("last_t"), F.count_if((F.col("percent") < F.col("_before")) & (F.col("t") > F.col("_t"))).alias("falls"), F.count_if((F.col("percent") != F.col("_before")) & (F.col("t") == F.col("_t"))).alias("conflicts"))
