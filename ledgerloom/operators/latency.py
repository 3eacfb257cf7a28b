"""Response times: accepted samples, groups, and a pace line by quantile regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .limits import numbered

LONGEST_S = 3600
#: The pace line's quantile; responses that it needs and takes; distinct values that a column of counts needs.
PACE, FIT_LEAST, FIT_ROWS, FIT_DISTINCT = 0.1, 40, 4000, 10


def samples(ledger: DataFrame) -> DataFrame:
    """ledger with the seconds that each response took, and why a row is no sample.

    A response starts with its own request, and not before the latest end before it in its stream. That end alone is
    no start: it would time the wait between two responses.
    """
    before = F.max("t").over(Window.partitionBy("stream").orderBy("t", "response_id").rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(F.col("req").isNotNull(), F.greatest("req", F.coalesce(before, "req")))
    timed = ledger.withColumn("seconds", F.col("t") - start)
    return timed.withColumn("reason", F.when(F.col("seconds").isNull(), "no_start").when(F.col("seconds") <= 0, "not_positive").when(F.col("seconds") > LONGEST_S, "too_long"))


def summary(timed: DataFrame, *keys: str) -> DataFrame:
    """n, total, median and 90th percentile, exact and interpolated."""
    return timed.where("reason is null").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.percentile("seconds", 0.5).alias("median"), F.percentile("seconds", 0.9).alias("p90"))


def _pinball(y: np.ndarray, x: np.ndarray, q: float) -> np.ndarray:
    """The coefficients, none negative, of the q-quantile of y on the columns of x.

    Newton steps on the pinball loss with its corner rounded over a width that shrinks; coefficients that stand at 0 and
    would fall stay out of a step, and a step is cut short at the bound.
    """
    b = np.zeros(x.shape[1])
    b[0] = max(float(np.quantile(y, q)), 0.0)
    spread = max(float(np.median(np.abs(y - np.median(y)))), 1e-3)
    for width in spread * np.geomspace(1.0, 1e-3, 12):
        loss = lambda c, w=width: float((q * (y - x @ c) + w * np.logaddexp(0.0, (x @ c - y) / w)).sum())
        now = loss(b)
        for _ in range(30):
            below = 1 / (1 + np.exp(np.clip((y - x @ b) / width, -60, 60)))
            slope = x.T @ (below - q)
            free = (b > 0) | (slope < 0)
            if not free.any():
                break
            part = x[:, free]
            curve = part.T @ (part * (below * (1 - below) / width)[:, None])
            curve[np.diag_indices_from(curve)] += 1e-9 * max(float(np.trace(curve)), 1e-9)
            step = np.zeros_like(b)
            step[free] = -np.linalg.solve(curve, slope[free])
            for size in 0.5 ** np.arange(24):
                moved = np.maximum(b + size * step, 0.0)
                then = loss(moved)
                if then < now - 1e-12 * abs(now):
                    break
            else:
                break
            gain, b, now = now - then, moved, then
            if gain < 1e-10 * abs(now):
                break
    return b


def pace(seconds: np.ndarray, output: np.ndarray, uncached: np.ndarray, q: float = PACE) -> tuple[float, float, float]:
    """(overhead, seconds for an output token, seconds for an uncached one) under a share q of the responses; none is
    negative. A column of fewer than FIT_DISTINCT values counts for nothing."""
    counts = [output, uncached]
    used = [k for k, c in enumerate(counts) if len(np.unique(c)) >= FIT_DISTINCT]
    scale = [max(float(np.mean(np.abs(counts[k]))), 1.0) for k in used]
    found = _pinball(seconds, np.column_stack([np.ones(len(seconds)), *(counts[k] / s for k, s in zip(used, scale, strict=True))]), q)
    rates = [0.0, 0.0]
    for k, s, value in zip(used, scale, found[1:], strict=True):
        rates[k] = float(value) / s
    return float(found[0]), rates[0], rates[1]


def evenly(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Of each group, most rows at even places of the order at most; with _n, how many the group has."""
    return numbered(rows, keys, "t", order).where((F.col("_n") <= most) | F.expr(f"_i = (ceil(_i * {most} / _n) * _n) div {most}"))


def pace_lines(timed: DataFrame, *keys: str) -> DataFrame:
    """The pace of each group with FIT_LEAST samples or more, on FIT_ROWS even ones in time order at most."""
    picked = evenly(timed.where("reason is null"), [*keys], ["t", "response_id"], FIT_ROWS).where(F.col("_n") >= FIT_LEAST)
    rows = picked.select(*keys, "seconds", "output", F.greatest(F.lit(0), F.col("input") - F.col("cached")).alias("uncached"))
    names = [*keys, "n", "overhead", "per_output", "per_uncached"]

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, len(part), *pace(*(part[c].to_numpy(float) for c in ("seconds", "output", "uncached"))))], columns=names)

    kinds = dict(timed.dtypes)
    return rows.groupBy(*keys).applyInPandas(fit, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long", "overhead double", "per_output double", "per_uncached double"]))


def above_pace(timed: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """Each group's samples, output and seconds, and the seconds above its pace line; without a line those are null.

    (keys, n, output, total, above, above_share, median_above)
    """
    good = timed.where("reason is null").withColumn("uncached", F.greatest(F.lit(0), F.col("input") - F.col("cached")))
    placed = good.join(lines.select(*keys, "overhead", "per_output", "per_uncached"), [*keys], "left")
    over: Column = F.greatest(F.lit(0.0), F.col("seconds") - (F.col("overhead") + F.col("per_output") * F.col("output") + F.col("per_uncached") * F.col("uncached")))
    placed = placed.withColumn("above", F.when(F.col("overhead").isNotNull(), over))
    sums = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("output").alias("output"), F.sum("seconds").alias("total"), F.sum("above").alias("above"), F.percentile("above", 0.5).alias("median_above"))
    return sums.withColumn("above_share", F.try_divide("above", "total"))


def tool_times(calls: DataFrame, most: int = 50, longest: int = 2 * 3600) -> DataFrame:
    """The most tools by total seconds, from calls (tool, start_t, end_t): n, total, median, p90."""
    seconds = F.col("end_t") - F.col("start_t")
    good = calls.withColumn("seconds", seconds).where((F.col("seconds") > 0) & (F.col("seconds") <= longest))
    each = good.groupBy("tool").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.percentile("seconds", 0.5).alias("median"), F.percentile("seconds", 0.9).alias("p90"))
    return each.orderBy(F.desc("total"), "tool").limit(most)


def turn_times(turns: DataFrame, timed: DataFrame, longest: int = 2 * 3600) -> DataFrame:
    """(stream, turn, turn_s, model_share) from turns (stream, turn, start_t) and timed rows with turn: a turn lasts from
    its start to its last response's end, and the model's share is what responses took of it, all of it at most."""
    ends = timed.groupBy("stream", "turn").agg(F.max("t").alias("end_t"), F.sum(F.when(F.col("reason").isNull(), F.col("seconds"))).alias("model_s"))
    joined = turns.join(ends, ["stream", "turn"]).withColumn("turn_s", F.col("end_t") - F.col("start_t"))
    good = joined.where((F.col("turn_s") > 0) & (F.col("turn_s") <= longest))
    return good.select("stream", "turn", "turn_s", F.try_divide(F.least("turn_s", F.coalesce("model_s", F.lit(0))), "turn_s").alias("model_share"))
