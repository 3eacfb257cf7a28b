"""URL filters by a sort-merge range join (native DataFrame functions only).

A host's labels reversed, each with a dot, put a domain and all its subdomains into one
interval of keys; a rule's path and all that starts with it are an interval too. Points
and the two ends of each rule's interval are range-sorted as bytes. In that order an open
end puts a rule on the stack of active nested rules, a close end takes it off, and a point
reads the stack. Stacks come from each rule's own enclosing rules; every range of keys
sweeps by itself, after the stack that the ranges before it leave.

Two sweeps judge a table: hosts against rule hosts, then (active rule host, path) against
rule paths. The points are distinct hosts and distinct pairs, so a host with a third of
the rows is one point. The longest rule (host and path together, then host) wins.

Defined results: a null url, or one without "://", has host and path "" and no rule;
repeated urls are judged alike; equal rules count once, and of equal host and path block
wins; an empty table or rule list is allowed; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, partitions



def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end. Path: then up to "?" or "#"."""
    at = F.locate("://", url) if isinstance(url, str) else F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """com.example.www. for www.example.com: a rule's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")).cast("binary")


def _enclosing(rules: DataFrame) -> DataFrame:
    """(key, stack): the rule and all rules whose key is a prefix of its own, shortest first.

    Equi-joins every prefix of every rule's key; as many rows as the rules have bytes.
    """
    prefixes = rules.select("key", F.explode(F.sequence(F.lit(1), F.octet_length("key"))).alias("n")).select("key", F.expr("substring(key, 1, n)").alias("outer"))
    found = prefixes.join(rules.select(F.col("key").alias("outer")), "outer")
    return found.groupBy("key").agg(F.sort_array(F.collect_set("outer")).alias("stack"))


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, stack) for each distinct binary key of points: the keys of rules that are its prefixes."""
    stacks = _enclosing(rules.select("key").distinct())
    nothing = F.lit(None).cast("array<binary>")
    opened = stacks.select("key", F.lit(0).alias("kind"), "stack")
    closed = stacks.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("kind"), F.expr("slice(stack, 1, size(stack) - 1)").alias("stack"))
    events = points.select("key").distinct().select("key", F.lit(1).alias("kind"), nothing.alias("stack")).unionByName(opened).unionByName(closed)
    ranged = materialize(events.repartitionByRange(partitions(points.sparkSession), "key", "kind").withColumn("_range", F.spark_partition_id()))
    upto = Window.partitionBy("_range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = ranged.where("stack is not null").groupBy("_range").agg(F.max_by("stack", F.struct("key", "kind")).alias("stack"))
    # one row for each range, as many as there are shuffle partitions
    before = ranged.select("_range").distinct().join(left, "_range", "left")
    carried = before.select("_range", F.last("stack", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    swept = ranged.withColumn("_here", F.last("stack", ignorenulls=True).over(upto)).where("kind = 1")
    none = F.array().cast("array<binary>")
    return swept.join(carried, "_range").select("key", F.coalesce("_here", "_before", none).alias("stack"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages; rules are (verdict, host, path)."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        listed = [F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(r, ("verdict", "host", "path"), strict=True))) for r in rules]
        rules = spark.range(1).select(F.inline(F.array(*listed).cast("array<struct<verdict:string,host:string,path:string>>")))
    known = rules.groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")).agg(F.max("verdict").alias("verdict"))
    known = known.where("rule_host <> ''").withColumn("host_key", host_key(F.col("rule_host")))
    pair_key = lambda host, path: F.concat(host, F.unhex(F.lit("FE")), path.cast("binary"))
    known = known.withColumn("pair_key", pair_key(F.col("host_key"), F.col("rule_path")))
    host, path = host_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    asked = materialize(rows.select("host", "path").distinct().withColumn("key", host_key(F.col("host"))))
    hosts = sweep(asked, known.select(F.col("host_key").alias("key")))
    active = asked.join(hosts, "key").select("host", "path", F.explode("stack").alias("host_key")).withColumn("key", pair_key(F.col("host_key"), F.col("path")))
    paths = sweep(active, known.select(F.col("pair_key").alias("key"))).select("key", F.element_at(F.when(F.size("stack") > 0, F.col("stack")), -1).alias("pair_key"))
    hit = active.join(paths.where("pair_key is not null"), "key").join(known.select("pair_key", "rule_host", "rule_path", "verdict"), "pair_key")
    rule = F.concat("rule_host", "rule_path")
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.char_length(rule).alias("n"), F.char_length("rule_host").alias("h"), rule.alias("rule"), F.col("verdict").alias("verdict"))).alias("best"))
    # materialized, so that the join deals the rows out by itself and a common page is split
    return rows.join(materialize(best), ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
