"""Prompts as ranges of one append-only chain of items: places, stable prefixes, resends, turns.

Every window has the stream among its keys, so one exchange by stream serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(items: DataFrame, stream: str, order: list[str], tokens: str, resets: Column) -> DataFrame:
    """items with segment (how many resets so far), and start and end: the tokens of its segment before and after it."""
    so_far = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(stream, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("segment", F.count_if(resets).over(so_far))
    return rows.withColumn("end", F.sum(tokens).over(inside).cast("long")).withColumn("start", F.col("end") - F.col(tokens))


def stable_prefix(requests: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """requests with stable: how much of the prompt was the previous request's. Two prompts of one segment are ranges from
    the same start, so they share the shorter; across a reset they share nothing."""
    before = Window.partitionBy(stream).orderBy(*order)
    shared = F.least(F.lag("end").over(before), F.col("end"))
    return requests.withColumn("stable", F.when(F.lag("segment").over(before) == F.col("segment"), shared).otherwise(0).cast("long"))


def divergence_leads(requests: DataFrame, key: str, cached: str = "cached", least: int = 20_000, most: int = 40) -> DataFrame:
    """The most requests whose stable prefix exceeds what was served from the cache by least tokens or more."""
    gap = F.col("stable") - F.col(cached)
    return requests.withColumn("gap", gap).where(F.col("gap") >= least).orderBy(F.desc("gap"), key).limit(most)


def resends(items: DataFrame, stream: str, order: list[str], request: Column) -> DataFrame:
    """placed items with resent: the later requests of their segment, each of which sends the item again."""
    after = Window.partitionBy(stream, "segment").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return items.withColumn("resent", F.count_if(request).over(after))


def turns(rows: DataFrame, stream: str, order: list[str], opener: Column) -> DataFrame:
    """rows with turn: how many openers stand up to and with the row."""
    return rows.withColumn("turn", F.count_if(opener).over(Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def runs(series: DataFrame, key: str, start: str, end: str, n: str, most_gap: int = 3600, least: int = 5) -> DataFrame:
    """(key, first, last, spans): stretches of spans with least rows or more and no gap above most_gap seconds between them."""
    along = Window.partitionBy(key).orderBy(start)
    thick = series.where(F.col(n) >= least)
    opens = thick.withColumn("opens", F.coalesce(F.col(start) - F.lag(end).over(along) > most_gap, F.lit(True)))
    numbered = opens.withColumn("run", F.count_if("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count("*").alias("spans")).drop("run")
