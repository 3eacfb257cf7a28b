"""What makes one canonical ledger of overlapping records: dedup, collapse, owners, lineage, replay."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_response(records: DataFrame, scope: str, response: str, order: list[str]) -> DataFrame:
    """Of records with one response id in a scope, the first in order; null ids are never merged."""
    nth = F.row_number().over(Window.partitionBy(scope, response).orderBy(*order))
    return records.withColumn("_n", F.when(F.col(response).isNull(), 1).otherwise(nth)).where("_n = 1").drop("_n")


def is_context_snapshot(input_: str = "input", output: str = "output", total: str = "total"):
    """Neither input nor output but a total: a state, not a response."""
    return (F.col(input_) == 0) & (F.col(output) == 0) & (F.col(total) > 0)


def collapse_repeats(records: DataFrame, stream: str, order: list[str], state: list[str]) -> DataFrame:
    """Without records whose state equals their immediate predecessor's in the stream."""
    before = F.lag(F.struct(*state)).over(Window.partitionBy(stream).orderBy(*order))
    return records.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct(*state))).drop("_before")


def terminal_blocks(blocks: DataFrame) -> DataFrame:
    """A copy's last block gives its counts; conflict tells prompts that differ inside the copy."""
    last = F.max(F.struct("block", "output")).alias("last")
    each = blocks.groupBy("response", "copy").agg(last, F.coalesce(F.min("prompt") != F.max("prompt"), F.lit(False)).alias("conflict"))
    return each.select("response", "copy", "last.output", "last.block", "conflict")


def owners(copies: DataFrame, rank: list) -> DataFrame:
    """The one copy of a response that is charged, first by rank (expressions, least first), and how many there are."""
    own = F.struct(*(c for c in copies.columns if c != "response"))
    chosen = copies.groupBy("response").agg(F.min_by(own, F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)))).alias("own"), F.count("*").alias("copies"))
    return chosen.select("response", "own.*", "copies")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the folder of spark.checkpoint.dir; a local session without one gets its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerloom"))
    return df.checkpoint(eager=True)


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, distance) along parent links, the shortest distance where there are cycles.

    Paths double: ways of up to n steps joined with themselves give those of up to 2 n, so a chain of any depth takes
    as many joins as its depth has binary digits.
    """
    known = cut(nodes.select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).cast("long").alias("distance")).where("ancestor is not null AND ancestor <> node").distinct())
    mark = None
    while True:
        state = known.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", "ancestor", "distance")).alias("x")).first()
        if state == mark or not state["n"]:
            return known
        mark = state
        onward = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_then"), F.col("distance").alias("_more"))
        longer = known.join(onward, "ancestor").select("node", F.col("_then").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance")).where("node <> ancestor")
        known = cut(known.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))


def families(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root, status) of all threads in parent links: the thread without a known parent from which a thread comes;
    conflict where a family has more than one, cycle where it has none."""
    chain = ancestors(links, child, parent)
    every = links.select(F.col(child).alias("node")).unionByName(links.select(F.col(parent).alias("node"))).where("node is not null").distinct()
    roots = every.join(links.where(f"{parent} is not null AND {parent} <> {child}").select(F.col(child).alias("node")), "node", "left_anti").select(F.col("node").alias("root"))
    reached = chain.join(roots, F.col("ancestor") == F.col("root")).select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root")).groupBy("node").agg(F.min("root").alias("root"), F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "cycle").when(F.col("n") > 1, "conflict").otherwise("ok")
    return every.join(reached, "node", "left").select("node", "root", status.alias("status"))


def leading_replay(children: DataFrame, histories: DataFrame) -> DataFrame:
    """(child, n): the longest prefix of a child's states that runs unbroken in an ancestor's history.

    children: (child, pos from 1, state); histories: (child, ancestor, pos, state). Only places of an ancestor's history
    with the child's first state begin a run, and places after them are joined by (child, ancestor, place): rows grow with the
    number of such beginnings times the child's length.
    """
    first = children.where("pos = 1").select("child", "state")
    begins = histories.join(first, ["child", "state"]).select("child", "ancestor", (F.col("pos") - 1).alias("offset"))
    asked = begins.join(children, "child").withColumn("there", F.col("pos") + F.col("offset"))
    past = histories.select("child", "ancestor", F.col("pos").alias("there"), F.col("state").alias("_state"))
    met = asked.join(past, ["child", "ancestor", "there"], "left").withColumn("_miss", F.when(F.col("state").eqNullSafe(F.col("_state")), None).otherwise(F.col("pos")))
    runs = met.groupBy("child", "ancestor", "offset").agg(F.coalesce(F.min("_miss") - 1, F.max("pos")).alias("n"))
    return runs.groupBy("child").agg(F.max("n").alias("n"))


def replayed_prefix(matches: DataFrame, least: int = 2) -> DataFrame:
    """(child, n, inherited, ambiguous) from (child, n): a run of least states or more is inherited; a single one tells
    nothing and is ambiguous."""
    return matches.select("child", "n", F.when(F.col("n") >= least, F.col("n")).otherwise(0).alias("inherited"), (F.col("n") < least).alias("ambiguous"))


def carry_forward(records: DataFrame, stream: str, order: list[str], column: str) -> DataFrame:
    """The last known value of a column; before the first, the first, marked inferred."""
    w = Window.partitionBy(stream).orderBy(*order)
    known = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = F.first(column, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return records.withColumn("_known", known).withColumn(f"{column}_carried", F.coalesce("_known", later)).withColumn(f"{column}_inferred", F.col("_known").isNull() & later.isNotNull()).drop("_known")


def opening_burst(records: DataFrame, stream: str, time: str, order: list[str], gap: float) -> DataFrame:
    """Marks the records before a stream's first gap above gap, measured from the running maximum."""
    w = Window.partitionBy(stream).orderBy(*order)
    most = F.max(time).over(w.rowsBetween(Window.unboundedPreceding, -1))
    broken = F.sum(F.when(F.col(time) - F.col("_most") > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return records.withColumn("_most", most).withColumn("in_burst", broken == 0).drop("_most")
