"""Rollout logs: JSON Lines files of sessions, found, read by complete lines and parsed with damage counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalar

#: The counts of a usage record.
COUNTS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
_USAGE = f"struct<{', '.join(f'{c}: double' for c in COUNTS)}>"
LINE = (
    "timestamp string, type string, payload struct<type: string, role: string, session_id: string, id: string, parent_thread_id: string, timestamp: string, model: string, effort: string, "
    f"response_id: string, usage: {_USAGE}, info: struct<last_token_usage: {_USAGE}, total_token_usage: {_USAGE}>, thread_settings: struct<service_tier: string>>"
)


def found(spark: SparkSession, root: str) -> DataFrame:
    """(path, day, modified, size) of the log files below root; no content is read. day is of the path's folders
    YYYY/MM/DD, or of the file's name, else null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "rollout-*.jsonl").load(root)
    folders = F.regexp_extract("path", r"/(\d{4}/\d{2}/\d{2})/rollout-[^/]*$", 1)
    name = F.regexp_extract("path", r"/rollout-(\d{4}-\d{2}-\d{2})[^/]*$", 1)
    day = F.when(folders != "", F.replace(folders, F.lit("/"), F.lit("-"))).when(name != "", name)
    return files.select("path", day.alias("day"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def in_days(files: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """The files of days from since to until, both included, compared as text; a file without a day fails any bound."""
    good = F.lit(True)
    if since is not None:
        good &= F.col("day") >= since
    if until is not None:
        good &= F.col("day") <= until
    return files.where(good)


def lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, place, line) of the complete lines below root, place in file order. What follows a file's last line end is
    still being written and is left out."""
    return _complete(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "rollout-*.jsonl").option("lineSep", "\n").text(root))


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """lines() of these files alone."""
    return _complete(spark.read.option("lineSep", "\n").text(paths))


def _complete(read: DataFrame) -> DataFrame:
    rows = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"), F.col("value").alias("line"),
    )
    # with every line ended, the lines and their ends are the file
    sums = rows.groupBy("path").agg(F.sum(F.octet_length("line") + 1).alias("_read"), F.max("place").alias("_last"), F.first("size").alias("_size"))
    open_ = sums.where("_read > _size").select("path", F.col("_last").alias("place"))
    return rows.select("path", "place", "line").join(open_, ["path", "place"], "left_anti")


def _read(rows: DataFrame) -> DataFrame:
    """(path, place, timestamp, type, payload). A generator stands between, so that a line is parsed once and not again for
    each field or filter that the optimizer would move below."""
    once = rows.select("path", "place", F.explode(F.array(F.from_json("line", LINE))).alias("r"))
    return once.select("path", "place", "r.timestamp", "r.type", "r.payload")


def _usage(at: str) -> Column:
    return F.when(F.col(at).isNotNull(), F.struct(*(scalar.count_of(F.col(f"{at}.{c}")).alias(c) for c in COUNTS)))


def parse(rows: DataFrame) -> DataFrame:
    """(path, place, kind, t, and what the kind has) of the lines that are records of usage or tell of a session.

    kind is meta, context, settings, explicit or legacy. A line that is no record, or of another kind, gives no row; a
    field of the wrong type is null, and a count of the wrong type 0.
    """
    read = _read(rows)
    legacy = (F.col("type") == "event_msg") & (F.col("payload.type") == "token_count") & F.col("payload.info.last_token_usage").isNotNull()
    kind = (
        F.when(F.col("type") == "session_meta", "meta").when(F.col("type") == "turn_context", "context")
        .when((F.col("type") == "event_msg") & (F.col("payload.type") == "thread_settings_applied"), "settings")
        .when((F.col("type") == "token_usage_record") & F.col("payload.usage").isNotNull(), "explicit").when(legacy, "legacy")
    )
    usage = F.when(F.col("kind") == "explicit", _usage("payload.usage")).when(F.col("kind") == "legacy", _usage("payload.info.last_token_usage"))
    return read.withColumn("kind", kind).where("kind is not null").select(
        "path", "place", "kind", scalar.epoch_s(F.col("timestamp")).alias("t"), F.col("payload.session_id").alias("session"), F.col("payload.id").alias("thread"),
        F.col("payload.parent_thread_id").alias("parent"), F.col("payload.timestamp").alias("started"), F.col("payload.model").alias("model"), F.col("payload.effort").alias("effort"),
        F.col("payload.response_id").alias("response_id"), F.col("payload.thread_settings.service_tier").alias("tier"), usage.alias("usage"),
        F.when(F.col("kind") == "legacy", _usage("payload.info.total_token_usage")).alias("cumulative"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """(path, records, damaged, damaged_usage): lines with anything in them, those that are no JSON, and of these those
    that look like usage."""
    bad = F.try_parse_json("line").isNull()
    some = rows.where(F.trim("line") != "")
    return some.groupBy("path").agg(F.count("*").alias("records"), F.count_if(bad).alias("damaged"), F.count_if(bad & F.col("line").rlike("token_count|token_usage_record")).alias("damaged_usage"))


def headers(records: DataFrame) -> DataFrame:
    """(path, session, thread, parent, started) of every file: its first session_meta; without one the path stands for both."""
    first = F.min_by(F.struct("session", "thread", "parent", "started"), "place").alias("h")
    known = records.where("kind = 'meta'").groupBy("path").agg(first)
    return records.select("path").distinct().join(known, "path", "left").select(
        "path", F.coalesce("h.session", "path").alias("session"), F.coalesce("h.thread", "path").alias("thread"), F.col("h.parent").alias("parent"), F.coalesce("h.started", F.lit("")).alias("started")
    )


def carried(records: DataFrame) -> DataFrame:
    """The usage records with the model, effort and tier that held when they were written: model and effort of the last
    turn_context, an absent effort being none, and the tier of the last settings, an absent one being the default."""
    upto = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.last(F.when(F.col("kind") == "context", F.struct("model", "effort")), ignorenulls=True).over(upto)
    model = F.last(F.when(F.col("kind") == "context", F.col("model")), ignorenulls=True).over(upto)
    tier = F.last(F.when(F.col("kind") == "settings", F.coalesce("tier", F.lit("default"))), ignorenulls=True).over(upto)
    held = records.select("path", "place", "kind", "t", "response_id", "usage", "cumulative", model.alias("model"), turn["effort"].alias("effort"), tier.alias("tier"))
    return held.where("kind IN ('explicit', 'legacy')")


#: Items that a model gives out, beside those whose names end in _call.
OUTPUT_ITEMS = ("reasoning", "function_call", "custom_tool_call", "local_shell_call", "compaction")


def _side() -> Column:
    """input or output, of a response_item that is known to be either."""
    item, role = F.col("payload.type"), F.col("payload.role")
    message = F.when(role == "assistant", "output").when(role.isin("user", "developer", "system"), "input")
    return F.when(item == "message", message).when(item.endswith("_output") | (item == "agent_message"), "input").when(item.isin(*OUTPUT_ITEMS) | item.endswith("_call"), "output")


def events(rows: DataFrame) -> DataFrame:
    """(path, place, event, kind, t, response_id, usage, cumulative) of the lines that tell when a request went out.

    event is turn, input, output, compact, abort or usage; kind, of usage, is explicit or legacy.
    """
    read = _read(rows)
    legacy = (F.col("type") == "event_msg") & (F.col("payload.type") == "token_count") & F.col("payload.info.last_token_usage").isNotNull()
    kind = F.when((F.col("type") == "token_usage_record") & F.col("payload.usage").isNotNull(), "explicit").when(legacy, "legacy")
    event = (
        F.when(kind.isNotNull(), "usage").when(F.col("type") == "turn_context", "turn").when(F.col("type") == "world_state", "input").when(F.col("type") == "compacted", "compact")
        .when((F.col("type") == "event_msg") & (F.col("payload.type") == "turn_aborted"), "abort").when(F.col("type") == "response_item", _side())
    )
    usage = F.when(kind == "explicit", _usage("payload.usage")).when(kind == "legacy", _usage("payload.info.last_token_usage"))
    told = read.select("path", "place", event.alias("event"), kind.alias("kind"), scalar.epoch_s(F.col("timestamp")).alias("t"), F.col("payload.response_id").alias("response_id"), usage.alias("usage"), F.when(kind == "legacy", _usage("payload.info.total_token_usage")).alias("cumulative"))
    return told.where("event is not null")
