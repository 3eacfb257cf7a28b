"""List-price valuation of responses by model, tier and prompt length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalar

#: Invented rates in millionths of a unit for each token, of prompts up to LONG_FROM tokens and above: model, tier, then
#: input, cached, cache write, output, and the same four for long prompts. Without a cached or a write rate that of input holds.
PRICES = (
    ("view", "standard", 5, 1, 6, 20, 10, 2, 12, 30), ("view", "fast", 10, 2, None, 40, 20, 4, None, 60), ("view", "flex", 2, None, None, 10, None, None, None, None),
    ("click", "standard", 4, 1, None, 16, None, None, None, None), ("click", "fast", 8, 2, None, 32, None, None, None, None), ("click", "flex", 2, 1, None, 8, None, None, None, None),
    ("signup", "standard", 3, 1, 4, 12, None, None, None, None), ("signup", "flex", 1, 1, None, 6, None, None, None, None),
    ("purchase", "standard", 6, 1, None, 24, 12, None, None, 36), ("purchase", "fast", 12, 3, None, 48, None, None, None, None),
)
NAMES = ("model", "tier", "rate_in", "rate_cached", "rate_write", "rate_out", "long_in", "long_cached", "long_write", "long_out")
LONG_FROM = 100_000


def values(rows: tuple = PRICES) -> str:
    """The price rows as SQL."""
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join(f"({', '.join(map(cell, row))})" for row in rows)


def prices(spark: SparkSession, rows: tuple = PRICES) -> DataFrame:
    """The price rows as a local relation, whose size the planner knows."""
    bad = [row for row in rows if any(x is not None and not (isinstance(x, int | float) and 0 <= x < float("inf")) for x in row[2:]) or row[2] is None or row[5] is None]
    if bad:
        raise ValueError(f"rates must be finite and not negative, and input and output have one: {bad[0]}")
    if {r[0] for r in rows} - {r[0] for r in rows if r[1] == "standard"}:
        raise ValueError("every model needs standard rates")
    return spark.sql(f"SELECT model, tier, {', '.join(f'CAST({n} AS BIGINT) AS {n}' for n in NAMES[2:])} FROM {values(rows)} AS t({', '.join(NAMES)})")


def _by_model(table: DataFrame) -> DataFrame:
    """(model, tiers, long): the rates of each tier of a model, and whether any has long-prompt rates."""
    rates = F.struct(*NAMES[2:])
    return table.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("tier", rates))).alias("_tiers"), F.max(F.col("long_in").isNotNull()).alias("_long"))


def priced(ledger: DataFrame, table: DataFrame, long_from: int = LONG_FROM) -> DataFrame:
    """ledger with micros, micros_high and the reason for none: model, tier or long_context.

    A model's name is taken as it is, then without a date at its end. A null tier counts as standard, and as fast in
    micros_high where the model has fast rates. Above long_from a model with long rates in any tier has the long row
    alone. Cached tokens are input at most, and writes what is left of it. The price table is joined by a broadcast that
    the planner chooses by its known size; the ledger is not moved.
    """
    models = _by_model(table)
    plain = scalar.model_name(F.col("model"))
    exact, dated = F.lower(F.trim("model")), F.regexp_replace(plain, scalar.DATED, "")
    one, two = models.select(F.col("model").alias("_one"), F.struct("_tiers", "_long").alias("_a")), models.select(F.col("model").alias("_two"), F.struct("_tiers", "_long").alias("_b"))
    rows = ledger.join(one, exact == F.col("_one"), "left").join(two, dated == F.col("_two"), "left").withColumn("_m", F.coalesce("_a", "_b"))
    count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) if c in ledger.columns else F.lit(0)
    inp, out = count("input"), count("output")
    cached = F.least(count("cached"), inp)
    writes = F.least(count("written"), inp - cached)
    is_long = F.col("_m._long") & (inp > long_from)

    def cost(rates: Column) -> tuple[Column, Column]:
        part = lambda kind: F.when(is_long, rates[f"long_{kind}"]).otherwise(rates[f"rate_{kind}"])
        full = part("in")
        micros = (inp - cached - writes) * full + cached * F.coalesce(part("cached"), full) + writes * F.coalesce(part("write"), full) + out * part("out")
        why = F.when(F.col("_m").isNull(), "model").when(rates.isNull(), "tier").when(is_long & rates["long_in"].isNull(), "long_context")
        return F.when(why.isNull(), micros), why

    own = F.try_element_at(F.col("_m._tiers"), scalar.tier_name(F.col("tier")))
    micros, why = cost(own)
    fast, fast_why = cost(F.try_element_at(F.col("_m._tiers"), F.lit("fast")))
    high = F.when(F.col("tier").isNull() & fast_why.isNull(), F.greatest(fast, micros)).otherwise(micros)
    return rows.withColumns({"reason": why, "micros": micros, "micros_high": high}).drop("_one", "_two", "_a", "_b", "_m")
