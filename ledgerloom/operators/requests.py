"""When the request behind each usage record of a rollout log went out.

The log stamps records when they are written, so a request starts with the last thing that its prompt took: an input
item, an opened turn, or a compaction that rebuilt the prompt. That start holds as of the response's first output item,
since a tool may answer while the response still streams. What it is frozen at is cleared by the usage record that ends a
response, and by a turn that opens or is aborted; a repeated state or a state of context ends nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def request_starts(events: DataFrame) -> DataFrame:
    """The usage records of rollout.events(), without repeated response ids, with req, when their requests went out, and
    ends, whether they are charged calls and end a response."""
    by_file = Window.partitionBy("path").orderBy("place")
    upto, before = by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_file.rowsBetween(Window.unboundedPreceding, -1)
    told, legacy = F.col("kind") == "explicit", F.col("kind") == "legacy"
    rows = events.withColumn("_state", F.when(legacy, F.to_json(F.struct("usage", "cumulative"))))
    rows = rows.withColumn("_last", F.last("_state", ignorenulls=True).over(before))
    rows = rows.withColumn("_nth", F.when(told & F.col("response_id").isNotNull(), F.row_number().over(Window.partitionBy("path", "kind", "response_id").orderBy("place"))).otherwise(1))
    context = (F.col("usage.input_tokens") == 0) & (F.col("usage.output_tokens") == 0) & (F.col("usage.total_tokens") > 0)
    rows = rows.withColumn("ends", F.coalesce(F.when(told, (F.col("_nth") == 1) & ~context).when(legacy, ~F.col("_state").eqNullSafe(F.col("_last")) & ~context), F.lit(False)))
    clears = F.col("ends") | F.col("event").isin("turn", "abort")
    stamp = lambda *events_: F.last(F.when(F.col("event").isin(*events_), F.struct("t")), ignorenulls=True).over(upto)["t"]
    rows = rows.withColumns({"_response": F.coalesce(F.sum(clears.cast("long")).over(before), F.lit(0)), "_input": stamp("turn", "input"), "_compact": stamp("compact")})
    rows = rows.withColumn("_start", F.greatest("_input", "_compact"))  # skips a null
    within = Window.partitionBy("path", "_response").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frozen = F.first(F.when(F.col("event") == "output", F.struct("_start")), ignorenulls=True).over(within)
    req = F.when(frozen.isNotNull(), frozen["_start"]).otherwise(F.col("_input"))
    return rows.withColumn("req", req).where("event = 'usage' AND _nth = 1").select("path", "place", "kind", "t", "response_id", "usage", "ends", "req")
