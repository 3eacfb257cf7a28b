"""Calls with their outputs, facts seen in copies, budgets and plausibility of what is shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def answered(events: DataFrame, file: str, call: str, order: list[str], is_call: Column, t: str = "t") -> DataFrame:
    """events with outcome: an output answers the last call of its id before it, unless that one is answered already.

    matched (with seconds), orphan (an output without an open call) for outputs; answered, open or replaced for calls.
    """
    along = Window.partitionBy(file, call).orderBy(*order)
    rows = events.withColumn("_call", is_call)
    before, after = F.lag("_call").over(along), F.lead("_call").over(along)
    of_call = F.when(after.isNull(), "open").when(after, "replaced").otherwise("answered")
    of_output = F.when(before, "matched").otherwise("orphan")
    seconds = F.when(~F.col("_call") & before, F.col(t) - F.lag(t).over(along))
    return rows.withColumns({"outcome": F.when(F.col("_call"), of_call).otherwise(of_output), "seconds": seconds}).drop("_call")


def single_pairs(events: DataFrame, keys: list[str], is_start: Column, t: str = "t") -> DataFrame:
    """(keys, starts, results, seconds, conflict): a start and a result pair where a key has exactly one of each."""
    counted = events.groupBy(*keys).agg(
        F.count_if(is_start).alias("starts"), F.count_if(~is_start).alias("results"),
        F.max(F.when(is_start, F.col(t))).alias("_s"), F.max(F.when(~is_start, F.col(t))).alias("_r"),
    )
    one = (F.col("starts") == 1) & (F.col("results") == 1)
    return counted.select(*keys, "starts", "results", F.when(one, F.col("_r") - F.col("_s")).alias("seconds"), ((F.col("starts") > 1) | (F.col("results") > 1)).alias("conflict"))


def unique_facts(facts: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row for each identity, the first by order with nulls last, and how many copies it has besides."""
    ranked = F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"o{i}"))])
    first = F.min_by(F.struct(*values), ranked).alias("first")
    return facts.groupBy(*keys).agg(first, (F.count("*") - 1).alias("copies")).select(*keys, *[F.col(f"first.{v}") for v in values], "copies")


def within_budget(rows: DataFrame, window: str, order: list[Column | str], each: int = 50, total: int = 1000) -> DataFrame:
    """Of each window its first rows by order, each at most; the oldest windows go until total are left.

    The running count is a window without keys, over one row for each window.
    """
    capped = rows.withColumn("rank", F.row_number().over(Window.partitionBy(window).orderBy(*order))).where(F.col("rank") <= each)
    sizes = rows.groupBy(F.col(window).alias("_w")).agg(F.least(F.count("*"), F.lit(each)).alias("n"))
    kept = sizes.withColumn("so_far", F.sum("n").over(Window.orderBy(F.desc("_w")))).where(F.col("so_far") <= total)
    return capped.join(kept.select("_w"), F.col(window).eqNullSafe(F.col("_w")), "left_semi")


def resolved(ledger: DataFrame, session: str, prefix: str) -> str:
    """The only session that begins with prefix; an error if there is none or more than one."""
    found = [r[0] for r in ledger.where(F.col(session).startswith(prefix)).select(session).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'several sessions begin' if found else 'no session begins'} with {prefix!r}")
    return found[0]


def broken_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule; a rule that is null for a row is not broken by it. One pass, no Python."""
    counts = rows.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])).alias("x")).select("x.*")


def session_rules(sessions: DataFrame, days: DataFrame) -> DataFrame:
    """How many sessions break each rule. sessions: (session, first_t, last_t, active_s); days: (day) that are reported. Equal sessions
    count once."""
    known = days.select(F.col("day").alias("_day")).distinct().withColumn("_known", F.lit(True))
    copies = sessions.groupBy("session", "first_t", "last_t", "active_s").count().withColumn("_copies", F.sum("count").over(Window.partitionBy("session")))
    rows = copies.withColumn("_of", F.to_date(F.timestamp_seconds("first_t"))).join(known, F.col("_of") == F.col("_day"), "left")
    span = F.col("last_t") - F.col("first_t")
    return broken_rules(rows, {
        "duplicate": F.col("_copies") > 1, "reversed": span < 0, "long_span": span > 400 * 86_400, "active_over_span": F.col("active_s") > span + 1,
        "active_bound": F.col("active_s") > 30 * 86_400, "day_missing": F.col("_known").isNull(),
    })


def latency_rules(groups: DataFrame, cap: int = 3600) -> DataFrame:
    """How many latency groups break each rule. groups: (n, median, p90)."""
    return broken_rules(groups, {"no_samples": F.col("n") < 1, "not_positive": F.col("median") <= 0, "median_over_p90": F.col("median") > F.col("p90"), "over_cap": F.col("p90") > cap})
