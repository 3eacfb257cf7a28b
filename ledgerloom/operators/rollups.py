"""Aggregates of the ledger: totals, ratios, groups, activity, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("input", "cached", "output", "reasoning")
IDLE_S = 1800


def ratio(part: str | Column, whole: str | Column) -> Column:
    """NULL, not 0, where there is nothing to divide by."""
    return F.try_divide(F.col(part) if isinstance(part, str) else part, F.col(whole) if isinstance(whole, str) else whole)


def rollup(ledger: DataFrame, *keys: str) -> DataFrame:
    """Responses, counts and the cache-hit ratio of each group; of everything without keys."""
    sums = [F.count("*").alias("responses"), *(F.sum(c).cast("long").alias(c) for c in COUNTS)]
    return ledger.groupBy(*keys).agg(*sums).withColumn("cache_hit", ratio("cached", "input"))


def totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("responses"), F.countDistinct("stream").alias("streams"), *(F.sum(c).cast("long").alias(c) for c in COUNTS), F.sum(F.col("input") - F.col("cached")).cast("long").alias("uncached"))


def sessions(ledger: DataFrame) -> DataFrame:
    """Each stream's counts, first and last second, and dominant model: most input, then lexically first."""
    by_model = ledger.groupBy("stream", "model").agg(F.count("*").alias("n"), F.sum("input").alias("i"), F.min("t").alias("a"), F.max("t").alias("b"))
    dominant = F.min_by("model", F.struct(-F.col("i"), F.col("model")))
    return by_model.groupBy("stream").agg(F.sum("n").alias("responses"), F.sum("i").cast("long").alias("input"), F.min("a").alias("first_t"), F.max("b").alias("last_t"), dominant.alias("model"))


def active_seconds(ledger: DataFrame, distinct: bool = False, idle: int = IDLE_S) -> DataFrame:
    """The sum of a stream's gaps of idle seconds at most; with distinct, over distinct times."""
    times = ledger.select("stream", "t")
    times = times.distinct() if distinct else times
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("stream").orderBy("t"))
    return times.withColumn("gap", gap).groupBy("stream").agg(F.coalesce(F.sum(F.when(F.col("gap").between(0, idle), F.col("gap"))), F.lit(0)).alias("active_s"))


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def monthly_sessions(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Of each month, the n streams most active and the n with most input, once each."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    marked = ledger.withColumn("month", month)
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("month", "stream").orderBy("t"))
    each = marked.withColumn("gap", gap).groupBy("month", "stream").agg(F.coalesce(F.sum(F.when(F.col("gap").between(0, IDLE_S), F.col("gap"))), F.lit(0)).alias("active_s"), F.sum("input").cast("long").alias("input"))
    ranks = [F.row_number().over(Window.partitionBy("month").orderBy(F.desc(c), "stream")) <= n for c in ("active_s", "input")]
    return each.select("*", ranks[0].alias("a"), ranks[1].alias("b")).where("a OR b").drop("a", "b")


def top_or_other(ledger: DataFrame, n: int, other: str = "other") -> DataFrame:
    """Responses and input of the n models with most input; the rest as one."""
    each = ledger.groupBy("model").agg(F.count("*").alias("responses"), F.sum("input").alias("input"))
    ranked = each.withColumn("r", F.row_number().over(Window.orderBy(F.desc("input"), "model")))
    return ranked.groupBy(F.when(F.col("r") <= n, F.col("model")).otherwise(other).alias("model")).agg(F.sum("responses").alias("responses"), F.sum("input").cast("long").alias("input"))


def hourly(ledger: DataFrame, category: str, seconds: int = 3600) -> DataFrame:
    return ledger.groupBy(F.expr(f"(t div {seconds}) * {seconds}").alias("bucket"), F.col(category).alias("category")).agg(F.count("*").alias("items"), F.sum("output").cast("long").alias("tokens"))


def in_view(series: DataFrame, low: int, high: int, seconds: int = 3600) -> DataFrame:
    """Tokens of each category in the buckets that overlap [low, high)."""
    return series.where((F.col("bucket") < high) & (F.col("bucket") + seconds > low)).groupBy("category").agg(F.sum("tokens").cast("long").alias("tokens"))


def in_view_of_all(series: DataFrame, inset: int, seconds: int = 3600) -> DataFrame:
    """in_view() of the whole range, less inset seconds at both ends; the range is a subquery of one row."""
    ends = lambda f: series.agg(f("bucket")).scalar()
    return series.where((F.col("bucket") < ends(F.max) - inset) & (F.col("bucket") + seconds > ends(F.min) + inset)).groupBy("category").agg(F.sum("tokens").cast("long").alias("tokens"))


def violations(days: DataFrame) -> DataFrame:
    """Plausibility rules of day rows, and how many break each."""
    rules = {"zero_responses": F.col("responses") <= 0, "cached_over_input": F.col("cached") > F.col("input"), "reasoning_over_output": F.col("reasoning") > F.col("output"), "input_bound": F.col("input") > 20_000_000_000, "before_start": F.col("day") < F.lit("2025-04-01").cast("date")}
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("broken")) for k, v in rules.items()])).alias("x")
    return days.select(named).groupBy(F.col("x.rule").alias("rule")).agg(F.count_if("x.broken").alias("n"))
