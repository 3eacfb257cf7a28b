"""Which months a shared report can hold: whole months, the newest that fit its budget together.

A month that breaks a rule or the budget by itself is left out whatever the others are. Of the rest the oldest go until the
report fits, which is to say that months stay while the running sums from the newest one on are within the budget: a window
over one row for each month of an account, and no loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The first day that a report can have, its most days and bytes, and the most input of a day.
EARLIEST, MAX_DAYS, MAX_BYTES, MAX_DAY_INPUT = "2025-04-01", 4000, 1_000_000, 20_000_000_000


def sized(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, bytes) of rows as they are written: JSON, and what parts one from the next."""
    body = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct(*body))) + 1).alias("bytes"))


def months_within(days: DataFrame, sessions: DataFrame, latest: str, envelope: int = 200, most_days: int = MAX_DAYS, most_bytes: int = MAX_BYTES, most_input: int = MAX_DAY_INPUT, earliest: str = EARLIEST) -> DataFrame:
    """(account, month, days, bytes, reason) of days (account, month, date, input, ...) and sessions (account, month, ...). reason is
    why a month is left out: rule, alone or budget; null if it stays. A month's own size has its days alone; the report's has
    sessions too, and envelope bytes around both."""
    keys = ["account", "month"]
    broken = F.coalesce(F.bool_or((F.col("date") < earliest) | (F.col("date") > latest) | (F.col("input") > most_input) | F.col("date").isNull() | F.col("input").isNull()), F.lit(False))
    each = sized(days, keys).withColumnsRenamed({"rows": "days", "bytes": "own"}).join(days.groupBy(*keys).agg(broken.alias("broken")), keys)
    each = each.join(sized(sessions, keys).select(*keys, F.col("bytes").alias("_more")), keys, "left").withColumn("bytes", F.col("own") + F.coalesce("_more", F.lit(0)))
    alone = F.when(F.col("broken"), "rule").when((F.col("days") > most_days) | (F.col("own") + envelope > most_bytes), "alone")
    judged = each.withColumn("_alone", alone)
    newest = Window.partitionBy("account", F.col("_alone").isNull()).orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = (F.sum("days").over(newest) > most_days) | (F.sum("bytes").over(newest) + envelope > most_bytes)
    return judged.withColumn("reason", F.coalesce("_alone", F.when(over, "budget"))).select(*keys, "days", "bytes", "reason")
