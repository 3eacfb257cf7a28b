"""Typed views of the test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage ledger: one row for each response, with its prompt, output, tier, effort and request stamp."""
    k = F.get_json_object("props", "$.k").cast("long")
    cents = F.round(F.col("value") * 100).cast("long")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("response_id"), F.col("user_id").alias("stream"), F.col("event_type").alias("model"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.to_date("ts").alias("day"), k.alias("k"), cents.alias("output"),
    ).withColumn("input", F.col("output") * 10 + F.col("k") * 100)
    return rows.select(
        "*", F.expr("(input * (k % 10)) div 10").alias("cached"), F.expr("output div 3").alias("reasoning"),
        F.expr("CASE k % 5 WHEN 0 THEN 'default' WHEN 1 THEN 'Priority' WHEN 2 THEN 'flex' WHEN 3 THEN 'batch' END").alias("tier"),
        F.expr("CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END").alias("effort"),
        F.expr("CASE WHEN k % 6 > 0 THEN t - (k * 37) % 4000 + 100 END").alias("req"),
    )


USAGE_SQL = """e AS (SELECT event_id AS response_id, user_id AS stream, event_type AS model, epoch(date_trunc('second', ts))::BIGINT AS t, ts::DATE AS day,
  json_extract_string(props, '$.k')::BIGINT AS k, round(value * 100)::BIGINT AS output FROM events),
f AS (SELECT *, output * 10 + k * 100 AS input FROM e),
u AS (SELECT *, (input * (k % 10)) // 10 AS cached, output // 3 AS reasoning,
  CASE k % 5 WHEN 0 THEN 'default' WHEN 1 THEN 'Priority' WHEN 2 THEN 'flex' WHEN 3 THEN 'batch' END AS tier, CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS effort,
  CASE WHEN k % 6 > 0 THEN t - (k * 37) % 4000 + 100 END AS req FROM f)"""

WEEK = 604_800


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-limit readings: percent used and the reset that was announced, jittered by up to 2 s."""
    return usage(spark, sf_dir).where("model = 'view'").select(
        "response_id", "stream", "t", F.expr("k % 101").alias("percent"), F.expr(f"(t div {WEEK}) * {WEEK} + {WEEK} + k % 3").alias("resets_at")
    )


QUOTES_SQL = f"q AS (SELECT response_id, stream, t, k % 101 AS percent, (t // {WEEK}) * {WEEK} + {WEEK} + k % 3 AS resets_at FROM u WHERE model = 'view')"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of responses, in copies: response, copy, block number and counts."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("response"), F.col("l_suppkey").alias("copy"), F.col("l_linenumber").cast("long").alias("block"), F.col("l_quantity").cast("long").alias("output"), F.col("l_partkey").alias("prompt")
    )


BLOCKS_SQL = "b AS (SELECT l_orderkey AS response, l_suppkey AS copy, l_linenumber::BIGINT AS block, l_quantity::BIGINT AS output, l_partkey AS prompt FROM lineitem)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout log lines, (path, place, line), one file for each stream: a header, then a snapshot for each response. Some are
    states of context, some are written twice, some are cut off."""
    usage_ = lambda i, c, o, r, t: F.struct(i.alias("input_tokens"), c.alias("cached_input_tokens"), o.alias("output_tokens"), r.alias("reasoning_output_tokens"), t.alias("total_tokens"))
    zero, context = F.lit(0).cast("long"), F.col("k") % 7 == 0
    pick = lambda x: F.when(context, zero).otherwise(x)
    last = usage_(pick(F.col("input")), pick(F.col("cached")), pick(F.col("output")), pick(F.col("reasoning")), F.col("input") + F.col("output") + 1)
    whole = usage_(F.col("response_id"), zero, zero, zero, F.col("response_id"))
    stamp = F.concat(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    event = F.struct(stamp.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(last.alias("last_token_usage"), whole.alias("total_token_usage")).alias("info")).alias("payload"))
    path = F.concat(F.lit("rollout-"), F.col("stream").cast("string"), F.lit(".jsonl"))
    rows = usage(spark, sf_dir).withColumns({"path": path, "line": F.to_json(event)})
    rows = rows.withColumn("line", F.when(F.col("k") % 13 == 0, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line")))
    body = rows.select("path", F.explode(F.when(F.col("k") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), "t", "response_id", "line")
    head = F.to_json(F.struct(F.lit("2025-01-01T00:00:00Z").alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(F.col("path").alias("session_id"), F.col("path").alias("id")).alias("payload")))
    heads = rows.select("path").distinct().select("path", F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("copy")).alias("place"), head.alias("line"))
    return body.select("path", F.struct("t", F.col("response_id").alias("id"), "copy").alias("place"), "line").unionByName(heads)


#: The snapshots that are charged of log_lines().
LOGGED_SQL = "x AS (SELECT *, k % 13 <> 0 AS whole, k % 7 = 0 AS context, k % 11 = 0 AS twice FROM u)"


def _copy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, order = F.col("_n"), F.col("l_orderkey").cast("string")
    numbered = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_quantity")).cast("long")
    usage_ = F.struct(F.col("l_partkey").alias("input"), F.lit(0).cast("long").alias("cached"), F.col("l_quantity").cast("long").alias("output"))
    return table(spark, sf_dir, "lineitem").withColumn("_n", numbered).select(
        order.alias("response"), F.lit("s").alias("source"), n.alias("line"), F.lit("m").alias("model"), F.lit(False).alias("aborted"), F.lit(False).alias("truncated"), F.lit(True).alias("stable"),
        F.concat_ws("-", order, n.cast("string")).alias("record"), F.lit(None).cast("string").alias("parent"), F.when(F.col("l_orderkey") % 2 == 1, n).alias("index"), n.cast("double").alias("t"), usage_.alias("usage"),
    )


def captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of responses as two captures saw them: each misses some, and the later one has some that are changed."""
    every = _copy_blocks(spark, sf_dir)
    changed = F.when(F.col("usage.input") % 17 == 0, F.struct(F.col("usage.input").alias("input"), F.col("usage.cached").alias("cached"), (F.col("usage.output") + 1).alias("output"))).otherwise(F.col("usage"))
    return every.where("line % 3 <> 0"), every.where("line % 4 <> 1").withColumn("usage", changed)


def tree_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in five files whose parent links are chains as long as the files, with side ways: a parent is the record before
    or the third before. Every file's first tenth is copied from where it was forked."""
    rows = usage(spark, sf_dir).select(F.concat(F.lit("file-"), (F.col("response_id") % 5).cast("string")).alias("path"), F.expr("response_id div 5").alias("line"), F.col("t").cast("double").alias("t"), "k")
    up = F.col("line") - F.when(F.col("k") % 8 == 0, 3).otherwise(1)
    side = F.when(F.col("k") % 29 == 0, "turn").when(F.col("k") % 6 == 1, "input").when(F.col("k") % 53 == 2, "summary")
    return rows.select("path", "line", F.concat(F.lit("n"), F.col("line").cast("string")).alias("uuid"), F.when(up >= 0, F.concat(F.lit("n"), up.cast("string"))).alias("parent"), side.alias("side"), "t", F.lit(20).cast("long").alias("fork_end"))


TREE_SQL = """r AS (SELECT 'file-' || (response_id % 5) AS path, response_id // 5 AS line, (response_id // 5) - CASE WHEN k % 8 = 0 THEN 3 ELSE 1 END AS up,
  CASE WHEN k % 29 = 0 THEN 'turn' WHEN k % 6 = 1 THEN 'input' WHEN k % 53 = 2 THEN 'summary' END AS side, t::DOUBLE AS t FROM u)"""


#: The blocks of captures(), before they are missed or changed.
COPIES_SQL = "b AS (SELECT l_orderkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) AS n, l_partkey AS p, l_quantity::BIGINT AS q, l_partkey % 17 = 0 AS changed FROM lineitem)"


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout log lines, (path, place, line), one file for each stream: around each response's snapshot, some of a turn that
    opens, a prompt, a compaction, the answer, a tool's output that comes while it streams, and an abort."""
    item = lambda kind, role=None: F.struct(F.lit("response_item").alias("type"), F.struct(F.lit(kind).alias("type"), F.lit(role).cast("string").alias("role")).alias("payload"))
    event = lambda kind: F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("role")).alias("payload"))
    bare = lambda kind: F.struct(F.lit(kind).alias("type"), F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("role")).alias("payload"))
    steps = [
        ("k % 9 = 0", 30, bare("turn_context")), ("k % 4 <> 1", 20, item("message", "user")), ("k % 10 = 3", 15, bare("compacted")), ("k % 5 <> 2", 12, item("message", "assistant")),
        ("k % 6 = 1", 6, item("function_call_output")), ("k % 8 = 5", 5, event("turn_aborted")),
    ]
    stamp = lambda t: F.concat(F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    rows = usage(spark, sf_dir).withColumn("path", F.concat(F.lit("rollout-"), F.col("stream").cast("string"), F.lit(".jsonl")))
    around = F.filter(F.array(*(F.when(F.expr(c), F.struct(F.lit(i).alias("step"), F.to_json(F.struct(stamp(F.col("t") - back).alias("timestamp"), body["type"].alias("type"), body["payload"].alias("payload"))).alias("line"))) for i, (c, back, body) in enumerate(steps))), lambda x: x.isNotNull())
    body = rows.select("path", "t", "response_id", F.explode(around).alias("x")).select("path", F.struct("t", F.col("response_id").alias("id"), "x.step").alias("place"), "x.line")
    logged = log_lines(spark, sf_dir).select("path", F.struct("place.t", "place.id", (F.col("place.copy") + len(steps)).alias("step")).alias("place"), "line")
    return body.unionByName(logged)


#: The lines of timed_lines() by step, without what is cut off, and the events that they are.
TIMED_SQL = """l AS (SELECT u.stream, u.t AS stamp, u.response_id, s.step, u.t - s.back AS t, s.event, u.k FROM u, (VALUES (0, 30, 'turn'), (1, 20, 'input'), (2, 15, 'compact'), (3, 12, 'output'), (4, 6, 'input'), (5, 5, 'abort'), (6, 0, 'usage'), (7, 0, 'usage')) s(step, back, event)
  WHERE CASE s.step WHEN 0 THEN k % 9 = 0 WHEN 1 THEN k % 4 <> 1 WHEN 2 THEN k % 10 = 3 WHEN 3 THEN k % 5 <> 2 WHEN 4 THEN k % 6 = 1 WHEN 5 THEN k % 8 = 5 WHEN 6 THEN k % 13 <> 0 ELSE k % 13 <> 0 AND k % 11 = 0 END)"""
