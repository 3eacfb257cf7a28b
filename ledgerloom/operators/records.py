"""Facts of single records, checks of reported costs, coverage of months and rules of shared windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.evidence import broken_rules

#: Recorded efforts, and the model of records that no model made.
EFFORTS = ("low", "medium", "high", "xhigh", "max", "none")
SYNTHETIC = "<synthetic>"


def excluded(model: Column, api_error: Column) -> Column:
    """Why a record is not charged: synthetic, api_error, or null if it is."""
    return F.when(model == SYNTHETIC, "synthetic").when(api_error, "api_error")


def partial(aborted: Column, truncated: Column) -> Column:
    return F.coalesce(aborted, F.lit(False)) | F.coalesce(truncated, F.lit(False))


def effort_of(own: Column, turn: Column) -> tuple[Column, Column]:
    """The effort of a record, and what is wrong with it: missing (recorded nowhere, or a name that is not known) or conflict (the record's own and
    its turn's are known and differ)."""
    known = lambda c: F.when(c.isin(*EFFORTS), c)
    a, b = known(own), known(turn)
    flaw = F.when(own.isNotNull() & a.isNull(), "missing").when(a != b, "conflict").when(a.isNull() & b.isNull(), "missing")
    return F.when(flaw.isNull(), F.coalesce(a, b)), flaw


def iterations(parts: Column, top: Column) -> tuple[Column, Column]:
    """How many iterations a response lists, and whether they agree with its own counts, which hold in any case: a single one, equal to
    them. Null for both where none are listed."""
    one = F.coalesce((F.size(parts) == 1) & F.get(parts, F.lit(0)).eqNullSafe(top), F.lit(False))
    return F.when(parts.isNotNull(), F.size(parts)), F.when(parts.isNotNull(), one)


def month_coverage(rows: DataFrame, failures: DataFrame, month: str) -> DataFrame:
    """(month, safe, reasons): every month of rows or of failures (month, reason); it is safe if nothing failed. A month has a few
    reasons, which are made distinct before they are listed."""
    listed = failures.select(month, "reason").distinct().groupBy(month).agg(F.sort_array(F.collect_list("reason")).alias("reasons"))
    every = rows.select(month).union(failures.select(month)).distinct().withColumnRenamed(month, "_month")
    found = every.join(listed, F.col("_month").eqNullSafe(F.col(month)), "left")
    return found.select(F.col("_month").alias(month), F.col("reasons").isNull().alias("safe"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def cost_checks(checks: DataFrame, ledger: DataFrame, keys: list[str], t: str, reported: str, cost: str) -> DataFrame:
    """checks with captured, what the ledger's rows of their keys cost up to their time, and rows, how many have no cost.

    Both sides go through one exchange by keys and one running sum, in place of a join by time. The sum of a key's time steps is
    made before, so rows of one key and time are one.
    """
    steps = ledger.groupBy(*keys, t).agg(F.sum(cost).alias("_cost"), F.count_if(F.col(cost).isNull()).alias("_none"))
    both = checks.withColumn("_check", F.lit(1)).unionByName(steps.withColumn("_check", F.lit(0)), allowMissingColumns=True)
    along = Window.partitionBy(*keys).orderBy(t, "_check").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.withColumns({"captured": F.coalesce(F.sum("_cost").over(along), F.lit(0)), "unpriced": F.coalesce(F.sum("_none").over(along), F.lit(0))})
    return summed.where("_check = 1").select(*checks.columns, "captured", "unpriced", (F.col(reported) - F.col("captured")).alias("difference"))


def window_rules(windows: DataFrame, splits: DataFrame, earliest: int, latest: int) -> DataFrame:
    """How many shared windows, or parts of them, break each rule.

    windows: (start, first_percent, peak, input, cached, output, responses); splits: (start, model, tier, input, cached, written, output,
    responses), parts of the window that starts then.
    """
    counts = ("responses", "input", "cached", "output")
    w = windows.withColumn("_copies", F.row_number().over(Window.partitionBy("start").orderBy("peak")))
    unanswered = (F.col("input") + F.col("output") != 0) & (F.col("responses") == 0)
    whole = broken_rules(w, {
        "window_duplicate": F.col("_copies") > 1, "window_before": F.col("start") < earliest, "window_future": F.col("start") > latest,
        "window_first_peak": F.col("first_percent") > F.col("peak"), "window_cached": F.col("cached") > F.col("input"), "window_no_responses": unanswered,
    })
    p = splits.withColumn("_copies", F.row_number().over(Window.partitionBy("start", "model", "tier").orderBy("input")))
    parts = broken_rules(p, {
        "split_duplicate": F.col("_copies") > 1, "split_cached": F.col("cached") > F.col("input"),
        "split_cache_write": F.col("written") > F.greatest(F.col("input") - F.col("cached"), F.lit(0)), "split_no_responses": unanswered,
    })
    sums = splits.groupBy(F.col("start").alias("_start")).agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    totals = broken_rules(windows.join(sums, F.col("start") == F.col("_start")), {f"split_{c}_total": F.col(f"_{c}") > F.col(c) for c in counts})
    return whole.unionByName(parts).unionByName(totals)
