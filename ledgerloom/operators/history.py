"""Copies of one response as two captures saw them, merged so that nothing retained is lost.

A copy is one source's view of a response: its blocks in durable order, the revisions of blocks that were recorded
differently later, and the terminal block, whose usage the copy is charged. Merging keeps every retained block, places
new ones by the records that both captures have, lets the terminal only advance, and marks a copy in conflict for good
once anything it had recorded came back changed.

The order of a merge has a closed form, so it is a sort and no loop: a new block stands right before the first retained
record that follows it in the incoming copy; without one, after the last retained record that precedes it; without
either, where its index or time puts it. New blocks of the same place keep their incoming order.

Copies are joined by (response, source); a copy's blocks are one row's array, and all of its expressions are built-ins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is recorded of a block, and so what a revision can differ in. Its line in a file is none of that.
EVIDENCE = ("record", "parent", "index", "t", "usage")
BLOCK = "struct<record: string, parent: string, index: bigint, t: double, usage: struct<input: bigint, cached: bigint, output: bigint>>"
COPY = f"response string, source string, model string, aborted boolean, truncated boolean, stable boolean, blocks array<{BLOCK}>, revisions array<{BLOCK}>, terminal string, conflict boolean"


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def copies(blocks: DataFrame) -> DataFrame:
    """COPY from rows (response, source, line, model, aborted, truncated, stable, and EVIDENCE): a first capture.

    The last block with a usage is the terminal. Model is the last block's that has one; a copy is aborted or truncated
    if any block is, and stable if all are.
    """
    rows = blocks.withColumn("block", F.struct(*EVIDENCE).cast(BLOCK))
    each = rows.groupBy("response", "source").agg(
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("line"))).alias("model"), F.coalesce(F.bool_or("aborted"), F.lit(False)).alias("aborted"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"), F.coalesce(F.bool_and("stable"), F.lit(True)).alias("stable"),
        F.sort_array(F.collect_list(F.struct("line", "block"))).getField("block").alias("blocks"),
    )
    last = F.try_element_at(F.filter("blocks", lambda b: b["usage"].isNotNull()), F.lit(-1))["record"]
    return each.withColumns({"revisions": F.array().cast(f"array<{BLOCK}>"), "terminal": last, "conflict": F.lit(False)})


def _same_identity(one: Column, other: Column) -> Column:
    """A block is known by its index where it has one, else by its record; a record that is the same is the same block."""
    return F.coalesce(one["index"] == other["index"], F.lit(False)) | (one["record"] == other["record"])


def _later(block: Column, terminal: Column) -> Column:
    """Whether a block, with its place in the incoming copy, comes after the terminal."""
    by_index = block["index"] > terminal["index"]
    by_place = block["at"] > terminal["at"]
    return terminal["record"].isNull() | F.coalesce(by_index, by_place, block["t"] > terminal["t"], F.lit(False))


def merged(retained: DataFrame, incoming: DataFrame) -> DataFrame:
    """The union of two tables of copies, COPY again. Incoming copies that are not stable tell nothing; retained copies
    that are absent from incoming stay; a second merge of the same incoming changes nothing."""
    old = retained.select("response", "source", F.struct("*").alias("o"))
    new = incoming.where("stable").select("response", "source", F.struct("*").alias("n"))
    both = old.join(new, ["response", "source"], "full_outer")
    one_side = both.where("o is null OR n is null").select(F.coalesce("o", "n").alias("x")).select("x.*")

    met = both.where("o is not null AND n is not null").select("response", "source", "o", "n")
    met = met.withColumn("seen", F.transform("n.blocks", lambda b, i: F.struct(b.alias("block"), i.alias("at"), F.array_position(F.transform("o.blocks", lambda r: r["record"]), b["record"]).alias("pos"))))
    # what a seen block is a copy of: a retained block, or an earlier one of the incoming copy that is new
    known = lambda x: _first(F.filter("o.blocks", lambda r: _same_identity(x["block"], r)))
    met = met.withColumn("seen", F.transform("seen", lambda x: F.struct(x["block"].alias("block"), x["at"].alias("at"), x["pos"].alias("pos"), known(x).alias("known"))))
    earlier = lambda x: _first(F.filter("seen", lambda y: (y["at"] < x["at"]) & y["known"].isNull() & _same_identity(x["block"], y["block"])))["block"]
    met = met.withColumn("seen", F.transform("seen", lambda x: F.struct(x["block"].alias("block"), x["at"].alias("at"), x["pos"].alias("pos"), F.coalesce(x["known"], earlier(x)).alias("known"))))
    met = met.withColumn("fresh", F.filter("seen", lambda x: x["known"].isNull()))
    met = met.withColumn("changed", F.transform(F.filter("seen", lambda x: x["known"].isNotNull() & ~x["known"].eqNullSafe(x["block"])), lambda x: x["block"]))

    # a block's place among the retained: (pos, side, at), side 0 before the retained block at pos, 1 itself, 2 after it
    following = lambda x: F.array_min(F.transform(F.filter("seen", lambda y: (y["at"] > x["at"]) & (y["pos"] > 0)), lambda y: F.struct(y["at"], y["pos"].alias("pos"))))["pos"]
    preceding = lambda x: F.array_max(F.transform(F.filter("seen", lambda y: (y["at"] < x["at"]) & (y["pos"] > 0)), lambda y: F.struct(y["at"], y["pos"].alias("pos"))))["pos"]
    key = lambda pos, side, at: F.struct(pos.cast("long").alias("pos"), side.alias("side"), at.cast("long").alias("at"))
    first = _first(F.col("fresh"))["block"]
    before = lambda r: F.coalesce(first["index"] < r["index"], (first["t"] < r["t"]) & (first["index"].isNull() | r["index"].isNull()), F.lit(False))
    alone = F.array_min(F.transform("o.blocks", lambda r, i: F.when(before(r), i + 1)))
    met = met.withColumn("alone", F.coalesce(alone, F.size("o.blocks") + 1))
    place = lambda x: F.coalesce(
        F.when(following(x).isNotNull(), key(following(x), F.lit(0), x["at"])), F.when(preceding(x).isNotNull(), key(preceding(x), F.lit(2), x["at"])), key(F.col("alone"), F.lit(0), x["at"])
    )
    put = F.transform("fresh", lambda x: F.struct(place(x).alias("key"), x["block"].alias("block")))
    stay = F.transform("o.blocks", lambda r, i: F.struct(key(i + 1, F.lit(1), F.lit(0)).alias("key"), r.alias("block")))
    met = met.withColumn("blocks", F.transform(F.array_sort(F.concat(stay, put)), lambda x: x["block"]))

    mark = lambda b, at: F.struct(b["record"].alias("record"), b["index"].alias("index"), b["t"].alias("t"), at.cast("int").alias("at"))
    kept = _first(F.filter("o.blocks", lambda r: r["record"] == F.col("o.terminal")))
    there = _first(F.filter("seen", lambda x: x["block"]["record"] == F.col("o.terminal")))["at"]
    candidates = F.filter("fresh", lambda x: x["block"]["usage"].isNotNull())
    last = F.aggregate(candidates, mark(kept, there), lambda t, x: F.when(_later(mark(x["block"], x["at"]), t), mark(x["block"], x["at"])).otherwise(t))
    met = met.withColumn("last", last["record"]).withColumn("advanced", ~F.col("last").eqNullSafe(F.col("o.terminal")))
    differs = (F.size("changed") > 0) | ~F.col("o.model").eqNullSafe(F.col("n.model"))
    union = met.select(
        "response", "source", F.when(F.col("advanced"), F.col("n.model")).otherwise(F.col("o.model")).alias("model"), (F.col("o.aborted") | F.col("n.aborted")).alias("aborted"),
        (F.col("o.truncated") | F.col("n.truncated")).alias("truncated"), F.lit(True).alias("stable"), "blocks", F.array_union("o.revisions", "changed").alias("revisions"),
        F.col("last").alias("terminal"), (F.col("o.conflict") | differs).alias("conflict"),
    )
    return one_side.select(union.columns).unionByName(union)


def charged(copies_: DataFrame) -> DataFrame:
    """(response, source, usage, partial, blocks, conflict): the whole usage tuple of each copy's terminal block."""
    last = _first(F.filter("blocks", lambda b: b["record"] == F.col("terminal")))["usage"]
    return copies_.select("response", "source", last.alias("usage"), (F.col("aborted") | F.col("truncated")).alias("partial"), F.size("blocks").alias("blocks"), "conflict")
