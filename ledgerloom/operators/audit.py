"""Diagnostics of ledgers and windows: what is counted and shown beside the figures, and what keeps a plan from being named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_order(t: str, *keys: str) -> list[Column]:
    """The total order of rows: by time, those without one last, then by keys."""
    return [F.asc_nulls_last(t), *[F.col(k) for k in keys]]


def snapshot_diagnostics(rows: DataFrame, file: str, order: list[str], total: str, parts: list[str], whole: str) -> DataFrame:
    """For each file: repeats (a snapshot equal to the one before), decreases (a cumulative total below the last one recorded)
    and violations (a whole that is not the sum of its parts; nothing counts as 0)."""
    along = Window.partitionBy(file).orderBy(*order)
    state = F.struct(*parts, whole)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    flags = rows.withColumns({
        "_repeat": F.lag(state).over(along).eqNullSafe(state), "_fell": F.col(total) < F.last(total, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
        "_wrong": zero(whole) != sum((zero(p) for p in parts), F.lit(0)),
    })
    return flags.groupBy(file).agg(F.count_if("_repeat").alias("repeats"), F.count_if("_fell").alias("decreases"), F.count_if("_wrong").alias("violations"))


def prompt_growth(requests: DataFrame, compactions: DataFrame, stream: str, t: str, key: str, model: str, tokens: str) -> DataFrame:
    """For each stream, its pairs of consecutive requests: compacted (a compaction after the first, up to the second), else
    model_changed, else shrunk. Rows without a time are in no pair. One exchange by stream."""
    asked = requests.where(F.col(t).isNotNull()).select(F.col(stream), F.col(t), F.struct(F.lit(1).alias("kind"), F.col(key)).alias("_at"), F.struct(F.col(t).alias("t"), F.col(model).alias("model"), F.col(tokens).alias("tokens")).alias("_r"))
    both = asked.unionByName(compactions.where(F.col(t).isNotNull()).select(stream, t, F.struct(F.lit(0).alias("kind"), F.lit(None).cast(dict(requests.dtypes)[key]).alias(key)).alias("_at")), allowMissingColumns=True)
    along = Window.partitionBy(stream).orderBy(t, "_at")
    rows = both.withColumns({"_p": F.last("_r", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)), "_c": F.max(F.when(F.col("_r").isNull(), F.col(t))).over(along.rowsBetween(Window.unboundedPreceding, 0))})
    pairs = rows.where("_r is not null and _p is not null")
    compacted = F.coalesce(F.col("_c") > F.col("_p.t"), F.lit(False))
    changed = ~F.col("_r.model").eqNullSafe(F.col("_p.model"))
    return pairs.groupBy(stream).agg(F.count("*").alias("pairs"), F.count_if(compacted).alias("compacted"), F.count_if(~compacted & changed).alias("model_changed"), F.count_if(~compacted & ~changed & (F.col("_r.tokens") < F.col("_p.tokens"))).alias("shrunk"))


def window_lengths(quotes: DataFrame, minutes: str, weekly: int = 10_080) -> DataFrame:
    """(minutes, n, chosen): how many readings each length of window has; weekly is chosen if there is one, else the longest."""
    counted = quotes.groupBy(minutes).agg(F.count("*").alias("n"))
    # one row for each length of window
    everywhere = Window.partitionBy()
    target = F.when(F.max(F.col(minutes) == weekly).over(everywhere), weekly).otherwise(F.max(minutes).over(everywhere))
    return counted.withColumn("chosen", F.coalesce(F.col(minutes) == target, F.lit(False)))


def opened(clusters: DataFrame) -> DataFrame:
    """clusters with opens_at, whether it is inferred (the oldest: its anchor or first reading, whichever is earlier), overlaps (begins
    before the one before it was last read), no_drop (begins no lower than that one ended) and next_t, where the next opens.

    clusters: (cluster, anchor, first_t, last_t, first_percent, last_percent), a small table at any size of the ledger.
    """
    order = Window.orderBy(*time_order("first_t", "cluster"))
    oldest = F.row_number().over(order) == 1
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = clusters.withColumns({
        "opens_at": F.when(oldest, F.least("anchor", "first_t")).otherwise(F.col("first_t")), "inferred": oldest,
        "overlaps": flag(F.lag("last_t").over(order) > F.col("first_t")), "no_drop": flag(F.col("first_percent") >= F.lag("last_percent").over(order)),
    })
    return rows.withColumn("next_t", F.lead("opens_at").over(order))


def late_readings(readings: DataFrame, windows: DataFrame, tolerance: int = 0) -> DataFrame:
    """For each window, how many of its readings (cluster, t, percent) came after its successor opened, and their peak: they are counted,
    not drawn. windows: of opened()."""
    late = F.coalesce(F.col("t") > F.col("next_t") + tolerance, F.lit(False))
    return readings.join(windows.select("cluster", "next_t"), "cluster").groupBy("cluster").agg(F.count_if(~late).alias("drawn"), F.count_if(late).alias("late"), F.max(F.when(late, F.col("percent"))).alias("late_peak"))


def plans_of(windows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """windows (window, start_t, end_t) with plan, null if unknown, and conflict.

    A plan is known if the latest snapshot before the start and all from it on agree on one, and the last snapshot's subscription
    began by then. snapshots: (t, plan, created). What all later snapshots agree on is found once for each snapshot, so a window looks
    at one of them. Both are small tables: one row for each window, and each look at the account.
    """
    onward = Window.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    agreed = F.struct(F.min("plan").over(onward).alias("low"), F.max("plan").over(onward).alias("high"), F.max(F.col("plan").isNull()).over(onward).alias("gap"), F.first("created").over(Window.orderBy(F.desc("t"), F.desc("created"))).alias("created"))
    seen = snapshots.where("t is not null").select("t", F.lit(1).alias("_kind"), agreed.alias("_s"))
    both = windows.withColumns({"t": F.col("start_t"), "_kind": F.lit(0)}).unionByName(seen, allowMissingColumns=True)
    order = Window.orderBy(F.asc_nulls_last("t"), "_kind")
    before, first = F.last("_s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.first("_s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = both.withColumn("_a", F.coalesce(before, first)).where("_kind = 0")
    known = (F.col("start_t") <= F.col("end_t")) & (F.col("_a.low") == F.col("_a.high")) & ~F.col("_a.gap") & (F.col("_a.created") <= F.col("start_t"))
    return rows.select(*windows.columns, F.when(known, F.col("_a.low")).alias("plan"), F.coalesce(F.col("_a.low") != F.col("_a.high"), F.lit(False)).alias("conflict"))


def reconciled(retained: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values, state): all rows of either side. same, revised (incoming's values), new, or kept (gone from incoming).

    Merging a second time changes nothing: all rows are then same or kept. Keys may be null, and are unique on each side.
    """
    side = lambda df, s: df.select(*[F.col(k).alias(f"{s}_{k}") for k in keys], F.struct(*values).alias(s))
    joined = side(retained, "_a").join(side(incoming, "_b"), [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys], "full_outer")
    state = F.when(F.col("_b").isNull(), "kept").when(F.col("_a").isNull(), "new").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("revised")
    return joined.select(*[F.coalesce(f"_b_{k}", f"_a_{k}").alias(k) for k in keys], *[F.when(F.col("_b").isNull(), F.col(f"_a.{v}")).otherwise(F.col(f"_b.{v}")).alias(v) for v in values], state.alias("state"))


def frozen(rows: DataFrame, captured: DataFrame, key: str, calendar: list[str]) -> DataFrame:
    """rows with the calendar that was captured first for their key; theirs where none was. captured has one row a key."""
    first = captured.select(F.col(key).alias("_key"), F.struct(*calendar).alias("_first"))
    return rows.join(first, F.col(key) == F.col("_key"), "left").withColumns({c: F.when(F.col("_first").isNotNull(), F.col(f"_first.{c}")).otherwise(F.col(c)) for c in calendar}).drop("_key", "_first")


def receipt_failures(receipts: DataFrame, rows: DataFrame, key: str, count: str, calendar: str) -> DataFrame:
    """(key, reason): receipts that rows no longer bear out: missing, decreased, or under another calendar."""
    now = rows.select(F.col(key).alias("_key"), F.col(count).alias("_count"), F.col(calendar).alias("_calendar"))
    reason = F.when(F.col("_key").isNull(), "missing").when(F.col("_count") < F.col(count), "decreased").when(~F.col("_calendar").eqNullSafe(F.col(calendar)), "calendar")
    return receipts.join(now, F.col(key) == F.col("_key"), "left").select(key, reason.alias("reason")).where("reason is not null")


def counters(long: DataFrame, name: str, value: str, twice: list[str]) -> DataFrame:
    """Counters by name: summed, but the largest of those in twice, which more than one reader sees."""
    return long.groupBy(name).agg(F.when(F.col(name).isin(twice), F.max(value)).otherwise(F.sum(value)).cast("long").alias(value))


def turn_profile(items: DataFrame, session: str, turn: str, category: str, tokens: str, most: int = 120) -> DataFrame:
    """Tokens by turn and category of each session, for the first turns that it has; items before the first turn are in none."""
    summed = items.where(F.col(turn) >= 0).groupBy(session, turn, category).agg(F.sum(tokens).cast("long").alias(tokens))
    return summed.withColumn("_n", F.dense_rank().over(Window.partitionBy(session).orderBy(turn))).where(F.col("_n") <= most).drop("_n")


def own_and_replayed(events: DataFrame, files: DataFrame, file: str, t: str) -> DataFrame:
    """(own, replayed): events inside the opening burst of a file that has a parent are its parent's. files: (file, burst_end), null for no
    burst."""
    inside = F.coalesce(F.col(t) <= F.col("burst_end"), F.lit(False))
    return events.join(files.select(file, "burst_end"), file, "left").agg(F.count_if(~inside).alias("own"), F.count_if(inside).alias("replayed"))


def searches_on_next(records: DataFrame, stream: str, order: list[str], charged: Column, search: Column) -> DataFrame:
    """The charged records with searches: how many searches of their stream came since the charged one before."""
    rows = records.withColumns({"_charged": F.coalesce(charged, F.lit(False)), "_search": F.coalesce(search, F.lit(False))})
    along = Window.partitionBy(stream).orderBy(*order)
    so_far = F.count_if("_search").over(along.rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("_n", so_far).where("_charged")
    return kept.withColumn("searches", F.col("_n") - F.coalesce(F.lag("_n").over(along), F.lit(0))).drop("_charged", "_search", "_n")


def first_cached(ledger: DataFrame, file: str, order: list[str], cached: str) -> DataFrame:
    """(files, with_cached): how many files have charged rows, and in how many the first of them was served from the cache."""
    firsts = ledger.groupBy(file).agg(F.min_by(cached, F.struct(*order)).alias("_c"))
    return firsts.agg(F.count("*").alias("files"), F.count_if(F.col("_c") > 0).alias("with_cached"))


def table_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): rows of two tables that were added, removed or changed."""
    change = F.when(F.col("state") == "kept", "removed").when(F.col("state") == "new", "added").otherwise("changed")
    return reconciled(old, new, keys, values).where("state <> 'same'").select(*keys, change.alias("change"))


def legend(groups: DataFrame, value: str, least: float = 0.0005) -> DataFrame:
    """groups with the share of all that they have, without those below least. groups is an aggregate, one row a legend entry."""
    return groups.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy())).where(F.col("share") >= least)


def renumbered(turns: DataFrame, stream: str, start: str, key: str) -> DataFrame:
    """turns with turn: their place in their stream by start, those without one last, then by key; a turn that several copies open counts
    once."""
    once = turns.groupBy(stream, key).agg(F.min(start).alias(start))
    return once.withColumn("turn", F.row_number().over(Window.partitionBy(stream).orderBy(*time_order(start, key))).cast("long") - 1)


def images(rows: DataFrame, *keys: str) -> DataFrame:
    """Images by keys: count, bounds of their tokens, how many have no bound, and bytes. rows: (lo, hi, bytes)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("images"), F.sum("lo").cast("long").alias("lo"), F.sum("hi").cast("long").alias("hi"), F.count_if(F.col("hi").isNull()).alias("unknown"), F.sum("bytes").cast("long").alias("bytes"))
