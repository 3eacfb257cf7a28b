"""Late evidence in a stream: the terminal block of each response, which only advances.

A response's state is its terminal block, the records that it is made of, and how often it changed. A block of a higher index
advances the terminal; a lower one that comes later is counted as late and rolls nothing back; a record that comes again says
nothing, unless it says something else, which is a conflict for good. Whatever order blocks arrive in, the terminal, the number
of blocks and the conflict are those of terminals(), the same in batch.

The state needs a state store of column families, spark.sql.streaming.stateStore.providerClass with RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "response string, terminal long, output long, blocks long, conflict boolean, late long, change long"


def terminals(blocks: DataFrame) -> DataFrame:
    """(response, terminal, output, blocks, conflict) of blocks (response, record, index, output). Of blocks that share an index
    the one with the largest output counts."""
    each = blocks.groupBy("response", "record").agg(F.max(F.struct("index", "output")).alias("last"), F.count_distinct("index", "output").alias("n"))
    return each.groupBy("response").agg(F.max("last").alias("last"), F.count("*").alias("blocks"), (F.max("n") > 1).alias("conflict")).select("response", F.col("last.index").alias("terminal"), "last.output", "blocks", "conflict")


class _Terminal(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "terminal long, output long, blocks long, conflict boolean, late long, change long")
        self.seen = handle.getMapState("seen", "record string", "index long, output long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        terminal, output, blocks, conflict, late, change = self.last.get() if self.last.exists() else (-1, -1, 0, False, 0, 0)
        before = (terminal, output, blocks, conflict, late)
        for part in rows:
            for record, index, size in zip(part["record"], part["index"].astype(int), part["output"].astype(int), strict=True):
                own = (int(index), int(size))
                if self.seen.containsKey((record,)):
                    if tuple(self.seen.getValue((record,))) == own:
                        continue
                    conflict = True
                else:
                    blocks += 1
                    self.seen.updateValue((record,), own)
                if own > (terminal, output):
                    terminal, output = own
                elif index < terminal:
                    late += 1
        if (terminal, output, blocks, conflict, late) == before:
            return
        self.last.update((int(terminal), int(output), int(blocks), bool(conflict), int(late), int(change) + 1))
        yield pd.DataFrame({"response": [key[0]], "terminal": [terminal], "output": [output], "blocks": [blocks], "conflict": [conflict], "late": [late], "change": [change + 1]})

    def close(self) -> None:
        pass


def latest_evidence(blocks: DataFrame) -> DataFrame:
    """A stream of what changed: the whole state of each response that blocks of a batch tell anything new of. Of a response's
    rows the one with the largest change is its state."""
    rows = blocks.select(F.col("response").cast("string").alias("response"), F.col("record").cast("string").alias("record"), F.col("index").cast("long").alias("index"), F.col("output").cast("long").alias("output"))
    return rows.groupBy("response").transformWithStateInPandas(_Terminal(), outputStructType=OUT, outputMode="Update", timeMode="None")
