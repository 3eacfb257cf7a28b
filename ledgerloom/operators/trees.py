"""State that records inherit down their parent links, not in file order.

Each record sets or passes on each part of the state. A record's part is what the nearest of itself and its ancestors
sets. Ways up the tree double: a record that still lacks a part takes what the record at the end of its way has and goes
on from that one's end, so a chain of any depth takes as many joins as its depth has binary digits, and a record that has
all parts, or has reached its root, is joined no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ledger import cut


def parents(records: DataFrame) -> DataFrame:
    """records with up, the line of the parent: the last record of that id that stands before in the file. A parent that is
    absent or stands later is none, so links never go round."""
    own = records.where("parent is not null").select("path", "line", F.col("parent").alias("uuid"))
    there = records.where("uuid is not null").select("path", "uuid", F.col("line").alias("_up"))
    # of one id's lines and the lines that ask for it, the last before each; not all pairs
    rows = own.select("path", "uuid", "line", F.lit(None).cast("long").alias("_up")).unionByName(there.select("path", "uuid", F.col("_up").alias("line"), "_up"))
    before = Window.partitionBy("path", "uuid").orderBy("line", F.col("_up").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("up", F.last("_up", ignorenulls=True).over(before)).where("_up is null AND up is not null").select("path", "line", "up")
    return records.join(found, ["path", "line"], "left")


def inherited(records: DataFrame, parts: dict[str, tuple[str, str]]) -> DataFrame:
    """records with a column for each part: the value at the nearest of a record and its ancestors that sets it.

    records: (path, line, uuid, parent, ...), lines unique in a file. parts: name to (whether a record sets it, the value),
    as SQL; a value that is set may be null.
    """
    linked = cut(parents(records))
    flags, values = {n: f"_set_{n}" for n in parts}, {n: f"_value_{n}" for n in parts}
    some = linked.select("path", "line", "up", *(F.coalesce(F.expr(c), F.lit(False)).alias(flags[n]) for n, (c, _) in parts.items()), *(F.expr(v).alias(values[n]) for n, (_, v) in parts.items()))
    whole = F.lit(True)
    for n in parts:
        whole &= F.col(flags[n])
    now = cut(some.withColumn("up", F.when(~whole, F.col("up"))))
    while not now.where("up is not null").isEmpty():
        ends = now.select("path", F.col("line").alias("up"), F.col("up").alias("_then"), *(F.col(c).alias(f"{c}_") for c in (*flags.values(), *values.values())))
        met = now.where("up is not null").join(ends, ["path", "up"])
        for n in parts:
            met = met.withColumn(values[n], F.when(F.col(flags[n]), F.col(values[n])).otherwise(F.col(f"{values[n]}_"))).withColumn(flags[n], F.col(flags[n]) | F.col(f"{flags[n]}_"))
        met = met.select("path", "line", F.when(~whole, F.col("_then")).alias("up"), *flags.values(), *values.values())
        now = cut(now.where("up is null").unionByName(met))
    told = now.select("path", "line", *(F.when(F.col(flags[n]), F.col(values[n])).alias(n) for n in parts))
    return linked.drop("up").join(told, ["path", "line"])


def request_state(records: DataFrame) -> DataFrame:
    """records (path, line, uuid, parent, side, t, fork_end) with what a response that answers them starts from: anchor, the
    later of the last prompt's and the last summary's stamp, and turn, the number of the turn in its file.

    side is turn, input, summary or null. Up to and with fork_end, the line at which a file's inherited beginning ends, a
    record opens no turn and is no anchor; fork_end itself clears all, and so does what stands above it.
    """
    copied = F.coalesce(F.col("line") <= F.col("fork_end"), F.lit(False))
    opens = F.coalesce((F.col("side") == "turn") & ~copied, F.lit(False))
    upto = Window.partitionBy("path").orderBy("line")
    rows = records.withColumn("_opens", opens).withColumn("_turn", (F.sum(opens.cast("long")).over(upto) - 1)).withColumn("_ends", F.coalesce(F.col("line") == F.col("fork_end"), F.lit(False)))
    rows = rows.withColumn("_prompt", F.coalesce(F.col("side").isin("turn", "input") & ~copied, F.lit(False)))
    parts = {
        "anchor": ("_prompt OR _ends", "CASE WHEN NOT _ends THEN t END"), "compact": ("side = 'summary' OR _ends", "CASE WHEN NOT _ends THEN t END"), "turn": ("_opens OR _ends", "CASE WHEN NOT _ends THEN _turn END"),
    }
    held = inherited(rows, parts).drop("_opens", "_turn", "_ends", "_prompt")
    return held.withColumn("anchor", F.when(F.col("anchor").isNotNull(), F.greatest("anchor", "compact")))
