"""The canonical ledger of rollout records: which usage records are charged, and what the others were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import ledger
from ledgerloom.sources import rollout


def _is_context() -> Column:
    return (F.col("usage.input_tokens") == 0) & (F.col("usage.output_tokens") == 0) & (F.col("usage.total_tokens") > 0)


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("place")).cast("long"))


def judged(records: DataFrame) -> DataFrame:
    """The usage records of rollout.parse() with what became of each:
    (path, session, place, kind, t, response_id, model, effort, tier, usage, fate, replayed).

    fate is charged, repeat, context, cross_file, inherited or sidecar. A file with any explicit record is charged by
    those alone, each response id once in a session, in the files' order of start. Of other files' snapshots, equal
    neighbours count once, and states of context not at all. What of these begins a file as an unbroken run of an
    ancestor's snapshots is inherited from two records on; a single one is charged and marked replayed.
    """
    records = ledger.cut(records)  # lines are parsed once, whatever branches need them
    files = ledger.cut(rollout.headers(records))
    usage = rollout.carried(records).join(files, "path")
    by_file = Window.partitionBy("path")
    usage = ledger.cut(usage.withColumn("_explicit", F.max(F.col("kind") == "explicit").over(by_file)))
    sidecar = usage.where("_explicit AND kind = 'legacy'").withColumn("fate", F.lit("sidecar"))

    told = usage.where("kind = 'explicit'").withColumn("_context", _is_context())
    nth = F.row_number().over(Window.partitionBy("path", "response_id").orderBy("place"))
    inside = told.withColumn("_in_file", F.when(F.col("response_id").isNull() | F.col("_context"), 1).otherwise(nth))
    fresh = (F.col("_in_file") == 1) & ~F.col("_context") & F.col("response_id").isNotNull()
    across = F.row_number().over(Window.partitionBy("session", "response_id", fresh).orderBy("started", "path", "place"))
    explicit = inside.withColumn("_n", F.when(fresh, across).otherwise(1)).withColumn("fate", F.when(F.col("_context"), "context").when(F.col("_in_file") > 1, "repeat").when(F.col("_n") > 1, "cross_file").otherwise("charged"))

    state = F.to_json(F.struct("usage", "cumulative"))
    order = Window.partitionBy("path").orderBy("place")
    legacy = usage.where("NOT _explicit").withColumn("state", state).withColumn("_before", F.lag("state").over(order))
    legacy = legacy.withColumn("fate", F.when(F.col("state").eqNullSafe(F.col("_before")), "repeat").when(_is_context(), "context"))
    states = ledger.cut(_numbered(legacy.where("fate is null")))
    matches = ledger.cut(ledger.leading_replay(*_histories(files, states)).withColumnRenamed("child", "path"))
    kept = states.join(matches, "path", "left")
    here = F.col("pos") <= F.coalesce("n", F.lit(0))
    kept = kept.withColumn("fate", F.when(here & (F.col("n") >= 2), "inherited").otherwise("charged")).withColumn("replayed", here & (F.col("n") == 1))

    names = ["path", "session", "place", "kind", "t", "response_id", "model", "effort", "tier", "usage", "fate"]
    shown = lambda df, replayed=F.lit(False): df.select(*names, replayed.alias("replayed"))
    return shown(sidecar).unionByName(shown(explicit)).unionByName(shown(legacy.where("fate is not null"))).unionByName(shown(kept, F.coalesce("replayed", F.lit(False))))


def _histories(files: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states of files with a declared parent, and those of their ancestors in the session, for leading_replay()."""
    node = lambda thread: F.to_json(F.struct("session", F.col(thread).alias("thread")))
    threads = files.groupBy("session", "thread").agg(F.min_by(F.struct("path", "parent"), F.struct("started", "path")).alias("of")).select("session", "thread", "of.path", "of.parent")
    links = threads.select(node("thread").alias("node"), F.when(F.col("parent").isNotNull(), node("parent")).alias("parent"))
    chain = ledger.ancestors(links, "node", "parent")  # materialized
    own = files.select("path", node("thread").alias("node"))
    first = threads.select(F.col("path").alias("ancestor_path"), node("thread").alias("ancestor"))
    pairs = ledger.cut(own.join(chain, "node").join(first, "ancestor").where("path <> ancestor_path").select(F.col("path").alias("child"), F.col("ancestor_path").alias("path")).distinct())
    children = states.join(pairs.select(F.col("child").alias("path")).distinct(), "path", "left_semi").select(F.col("path").alias("child"), "pos", "state")
    past = pairs.join(states.select("path", "pos", "state"), "path").select("child", F.col("path").alias("ancestor"), "pos", "state")
    return children, past


def counters(rows: DataFrame) -> DataFrame:
    """(counter, n) of judged(): responses, legacy_repeat, context_snapshots, cross_file_response_id, inherited, ambiguous,
    files_explicit, files_legacy, and the charged input, cached, output and reasoning."""
    count = F.col("usage")
    charged = F.col("fate") == "charged"
    sums = {
        "responses": F.count_if(charged), "legacy_repeat": F.count_if((F.col("fate") == "repeat") & (F.col("kind") == "legacy")), "context_snapshots": F.count_if(F.col("fate") == "context"),
        "cross_file_response_id": F.count_if(F.col("fate") == "cross_file"), "inherited": F.count_if(F.col("fate") == "inherited"), "ambiguous": F.count_if("replayed"),
        "files_explicit": F.count_distinct(F.when(F.col("kind") == "explicit", F.col("path"))), "files_legacy": F.count_distinct(F.when((F.col("kind") == "legacy") & (F.col("fate") != "sidecar"), F.col("path"))),
        **{k: F.coalesce(F.sum(F.when(charged, count[v])), F.lit(0)) for k, v in {"input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens", "reasoning": "reasoning_output_tokens"}.items()},
    }
    one = rows.agg(*(v.cast("long").alias(k) for k, v in sums.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("counter"), F.col(k).alias("n")) for k in sums))).alias("x")).select("x.*")
