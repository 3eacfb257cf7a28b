"""Prompts compared by what stands in them.

A stream's items are an append-only log; a prompt is a range of it, from where its segment begins to the request. After a
compaction the history that replaces it is logged anew, so a prompt can hold the same items at another place of the log.
Each item has a prefix hash: the sum of its segment's items so far, each hashed with its place in the segment. Two prompts
share their first n items just if their nth prefix hashes are equal, so the length of their longest common prefix is found
by joining on (place, prefix hash), not by comparing items one by one, nor by comparing lengths alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chained(items: DataFrame, stream: str, order: list[str], resets: Column, content: Column, tokens: str) -> DataFrame:
    """items with segment, place (from 1) and upto (tokens) in it, and prefix, a hash of all content of the segment up to and with
    the item. A row that resets begins a segment and is no item itself."""
    so_far = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(stream, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("_reset", F.coalesce(resets, F.lit(False))).withColumn("segment", F.count_if("_reset").over(so_far)).withColumn("_content", content)
    rows = rows.withColumn("place", F.sum(F.when(F.col("_reset"), 0).otherwise(1).cast("long")).over(inside)).withColumn("upto", F.sum(F.when(F.col("_reset"), 0).otherwise(F.col(tokens)).cast("long")).over(inside))
    # two sums of hashes under the place: as decimals they cannot overflow, and an equal pair is no chance
    part = lambda salt: F.sum(F.when(~F.col("_reset"), F.xxhash64(F.lit(salt), "place", "_content")).cast("decimal(38)")).over(inside)
    return rows.withColumns({"_one": part(1), "_two": part(2)}).withColumn("prefix", F.when(~F.col("_reset"), F.concat_ws(".", F.col("_one").cast("string"), F.col("_two").cast("string")))).drop("_one", "_two", "_content", "_reset")


def stable_prefix(items: DataFrame, requests: DataFrame, stream: str, across: bool = False) -> DataFrame:
    """requests (stream, request, charged, segment, length) with stable_items and stable: how many items, and their tokens, its
    prompt shares from the start with that of the last charged request before it.

    items: of chained(). A prompt is the first length items of its segment. Only charged requests move what the next is
    compared with. request orders a stream's requests and is unique in it. A compaction makes a prompt that no cache has
    seen, so prompts of two segments share nothing; with across they share what is equal, as the texts that are sent do.
    """
    before = Window.partitionBy(stream).orderBy("request").rowsBetween(Window.unboundedPreceding, -1)
    asked = requests.withColumn("_base", F.last(F.when(F.col("charged"), F.struct("segment", "length")), ignorenulls=True).over(before))
    one = items.where("prefix is not null").select(stream, "segment", "place", "prefix", "upto")
    # of two segments, how far they run alike, once for each pair that a request compares
    pairs = asked.where("_base is not null AND length > 0 AND _base.length > 0").select(stream, F.col("segment").alias("a"), F.col("_base.segment").alias("b")).where(F.lit(across) & (F.col("a") != F.col("b"))).distinct()
    left = pairs.join(one.withColumnRenamed("segment", "a"), [stream, "a"])
    right = one.select(stream, F.col("segment").alias("b"), "place", "prefix")
    alike = left.join(right, [stream, "b", "place", "prefix"]).groupBy(stream, "a", "b").agg(F.max("place").alias("_alike"))
    alike = alike.select(stream, F.col("a").alias("segment"), F.col("b").alias("_other"), "_alike")
    met = asked.withColumn("_other", F.col("_base.segment")).join(alike, [stream, "segment", "_other"], "left").drop("_other")
    shorter = F.least("length", "_base.length")
    n = F.when(F.col("_base").isNull(), 0).when(F.col("segment") == F.col("_base.segment"), shorter).otherwise(F.least(shorter, F.coalesce("_alike", F.lit(0).cast("long"))))
    met = met.withColumn("stable_items", n.cast("long")).drop("_base", "_alike")
    ends = one.select(stream, "segment", F.col("place").alias("stable_items"), F.col("upto").alias("stable"))
    return met.join(ends, [stream, "segment", "stable_items"], "left").withColumn("stable", F.coalesce("stable", F.lit(0).cast("long")))
