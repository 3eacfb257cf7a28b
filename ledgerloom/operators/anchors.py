"""Durable anchors of rate-limit resets, and published windows that only advance.

An anchor is a captured cluster of announced resets: its identity, its key, the reset that it stands for, and the span of
resets that it was captured with. None of that ever moves. A reading belongs to the one anchor of its account, kind and
scope into whose span, widened to the tolerance, its reset fits; where two anchors fit, it belongs to none. The readings
that no anchor takes make new clusters, each from its least reset as far as the tolerance goes, and these are captured.

Nothing is collected: readings meet anchors by second-wide buckets, and the starts of new clusters are found by doubling the
steps from a chain's least reset, over distinct resets, keyed by account, kind and scope.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import cut

#: The kinds of windows, the one that has scopes, the one that follows a weekly grid, and the week.
KINDS, SCOPED, GRID, WEEK_S = ("session", "weekly_all", "weekly_scoped"), "weekly_scoped", "weekly_all", 604_800
#: Seconds by which the resets of one window may be apart.
TOLERANCE_S = 2.0
IDENTITY = ["account", "kind", "scope"]
ANCHOR = "account string, kind string, scope string, window_key string, reset_at double, min_reset double, max_reset double, grid_phase double"


def checked(readings: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """readings (account, kind, scope, reading_key, resets_at, ...) with reason, why a reading tells of no window, or null."""
    bad = F.col("resets_at").isNull() | F.isnan("resets_at") | (F.col("resets_at") < 0) | (F.abs("resets_at") == F.lit(float("inf")))
    unscoped = (F.col("kind") == SCOPED) & F.coalesce(F.col("scope") == "", F.lit(True))
    reason = F.when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "unknown_kind").when(unscoped, "unknown_scope").when(bad, "reset_invalid")
    return readings.withColumn("reason", reason).withColumn("scope", F.when(F.col("kind") == SCOPED, F.col("scope")).otherwise(F.lit("")))


def fitted(readings: DataFrame, anchors: DataFrame, tolerance: float = TOLERANCE_S) -> DataFrame:
    """checked readings with window_key, that of the one anchor which fits, and fits, how many do."""
    low, high = F.col("max_reset") - tolerance, F.col("min_reset") + tolerance
    spans = anchors.select(*IDENTITY, F.col("window_key").alias("_key"), low.alias("_low"), high.alias("_high"), F.explode(F.sequence(F.floor(low), F.floor(high))).alias("_second"))
    resets = readings.where("reason is null").select(*IDENTITY, "resets_at").distinct().withColumn("_second", F.floor("resets_at"))
    met = resets.join(spans, [*IDENTITY, "_second"]).where((F.col("resets_at") >= F.col("_low")) & (F.col("resets_at") <= F.col("_high")))
    found = met.groupBy(*IDENTITY, "resets_at").agg(F.count("*").alias("fits"), F.min("_key").alias("_key"))
    return readings.join(found, [*IDENTITY, "resets_at"], "left").withColumn("fits", F.coalesce("fits", F.lit(0).cast("long"))).withColumn("window_key", F.when((F.col("fits") == 1) & F.col("reason").isNull(), F.col("_key"))).drop("_key")


def span_starts(points: DataFrame, keys: list[str], at: str, spread: float) -> DataFrame:
    """(keys, at) of the points at which clusters begin: the least, and from each the least that is more than spread beyond it."""
    rows = points.select(*keys, F.col(at).alias("at")).distinct().withColumn("_after", F.lead("at").over(Window.partitionBy(*keys).orderBy("at")))
    along = Window.partitionBy(*keys).orderBy("at")
    rows = rows.withColumn("to", F.expr(f"last(_after) OVER (PARTITION BY {', '.join(keys)} ORDER BY at RANGE BETWEEN CURRENT ROW AND {float(spread)}D FOLLOWING)"))
    begins = F.lag("at").over(along).isNull() | (F.col("at") - F.lag("at").over(along) > spread)
    rows = rows.withColumn("_begins", begins)
    # a gap begins a chain anew, whichever way leads there, so ways end at gaps
    gaps = rows.where("_begins").select(*keys, F.col("at").alias("to"), F.lit(True).alias("_gap"))
    steps = cut(rows.select(*keys, "at", "to").join(gaps, [*keys, "to"], "left").where("to is not null AND _gap is null").select(*keys, "at", "to"))
    starts = cut(rows.where("_begins").select(*keys, "at"))
    while not steps.isEmpty():
        starts = cut(starts.unionByName(starts.join(steps, [*keys, "at"]).select(*keys, F.col("to").alias("at"))).distinct())
        onward = steps.select(*keys, F.col("at").alias("to"), F.col("to").alias("_then"))
        steps = cut(steps.join(onward, [*keys, "to"]).select(*keys, "at", F.col("_then").alias("to")))
    return starts.withColumnRenamed("at", at)


def captured(readings: DataFrame, established: DataFrame, tolerance: float = TOLERANCE_S, kinds: tuple[str, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """(readings with window_key and reason, all anchors). Established anchors come back as they were.

    reason is why a reading has no window: unknown_kind, unknown_scope, reset_invalid, or ambiguous. A new anchor stands for the median
    of its readings' resets, halves up. An account's weekly grid has the phase of its first established weekly anchor, else of its
    first new one.
    """
    asked = fitted(checked(readings, kinds), established, tolerance)
    told = cut(asked.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("fits") > 1), "ambiguous").otherwise(F.col("reason"))).drop("fits"))
    loose = told.where("reason is null AND window_key is null")
    starts = span_starts(loose, IDENTITY, "resets_at", tolerance).withColumnRenamed("resets_at", "_start")
    points = loose.select(*IDENTITY, "resets_at").distinct()
    both = points.withColumn("_start", F.lit(None).cast("double")).unionByName(starts.select(*IDENTITY, F.col("_start").alias("resets_at"), "_start"))
    upto = Window.partitionBy(*IDENTITY).orderBy("resets_at", F.col("_start").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("_at", F.last("_start", ignorenulls=True).over(upto)).where("_start is null").select(*IDENTITY, "resets_at", "_at")
    clusters = loose.join(placed, [*IDENTITY, "resets_at"]).groupBy(*IDENTITY, "_at").agg(F.floor(F.percentile("resets_at", 0.5) + 0.5).cast("double").alias("reset_at"), F.min("resets_at").alias("min_reset"), F.max("resets_at").alias("max_reset"))
    clusters = cut(clusters.withColumn("window_key", F.sha2(F.to_json(F.struct(*IDENTITY, "reset_at", "min_reset")), 256)))
    own = clusters.select(*IDENTITY, F.col("_at"), F.col("window_key").alias("_new"))
    named = told.join(placed, [*IDENTITY, "resets_at"], "left").join(own, [*IDENTITY, "_at"], "left")
    named = named.withColumn("window_key", F.coalesce("window_key", F.when(F.col("reason").isNull(), F.col("_new")))).drop("_at", "_new")

    names = [c.split()[0] for c in ANCHOR.split(", ")]
    fresh = clusters.withColumn("grid_phase", F.lit(None).cast("double")).select(names)
    every = established.select(names).withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    first = F.min_by(F.coalesce("grid_phase", "reset_at"), F.struct("_new", F.col("grid_phase").isNull().alias("unset"), "reset_at"))
    phases = every.where(F.col("kind") == GRID).groupBy("account").agg(first.alias("_phase"))
    anchors = every.join(phases, "account", "left").withColumn("grid_phase", F.coalesce("grid_phase", F.when((F.col("kind") == GRID) & (F.col("_new") == 1), F.col("_phase"))))
    return named, anchors.select(names)


def departures(anchors: DataFrame, phase_tolerance: float = TOLERANCE_S) -> DataFrame:
    """The weekly anchors whose resets are off their account's grid."""
    off = F.pmod(F.col("reset_at") - F.col("grid_phase"), F.lit(float(WEEK_S)))
    return anchors.where((F.col("kind") == GRID) & (F.least(off, WEEK_S - off) > phase_tolerance))


COUNTS = ("responses", "input", "output")


def advances(new: str, old: str) -> Column:
    """Whether a window, a struct column, is the other with as much or more of everything: begun alike, no peak or count less,
    and no part of the split less or gone."""
    grown = F.coalesce((F.col(f"{new}.first_percent") == F.col(f"{old}.first_percent")) & (F.col(f"{new}.peak") >= F.col(f"{old}.peak")), F.lit(False))
    for c in COUNTS:
        grown &= F.coalesce(F.col(f"{new}.{c}") >= F.col(f"{old}.{c}"), F.lit(False))
    part = lambda s: F.get(F.filter(f"{new}.split", lambda x: (x["model"] == s["model"]) & x["tier"].eqNullSafe(s["tier"])), F.lit(0))
    whole = lambda s: F.coalesce(reduce(and_, (part(s)[c] >= s[c] for c in COUNTS)), F.lit(False))
    return grown & F.forall(f"{old}.split", whole)


def published(retained: DataFrame, built: DataFrame) -> DataFrame:
    """The union of two versions of published windows by (account, start): a window gives way to another only if that advances
    it, and none is ever left out. held tells of those that were not given way to though they differ."""
    keys = ["account", "start"]
    a, b = (df.select(*keys, F.struct(*[c for c in df.columns if c not in (*keys, "held")]).alias(name)) for df, name in ((retained, "a"), (built, "b")))
    met = a.join(b, keys, "full_outer")
    forward, back = F.coalesce(advances("b", "a"), F.lit(False)), F.coalesce(advances("a", "b"), F.lit(False))
    row = F.when(F.col("a").isNull() | (F.col("b").isNotNull() & forward), F.col("b")).otherwise(F.col("a"))
    return met.select(*keys, row.alias("w"), (F.col("a").isNotNull() & F.col("b").isNotNull() & ~forward & ~back).alias("held")).select(*keys, "w.*", "held")
