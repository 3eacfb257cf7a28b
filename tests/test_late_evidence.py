"""Streams of blocks in any order of arrival, with a restart, against the same in batch."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import evidence

BLOCK = "response string, record string, index long, output long"


def blocks(seed):
    draw, rows = random.Random(seed), []
    for n in range(30):
        for i in range(draw.randrange(1, 6)):
            row = (f"r{n}", f"r{n}-{i}", i, draw.randrange(100))
            rows += [row] * draw.choice((1, 1, 2))
            if draw.random() < 0.1:
                rows.append((*row[:3], row[3] + 1))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_is_the_batch_whatever_arrives_first(spark, tmp_path, seed):
    rows, source, sink, state = blocks(seed), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", evidence.STORE)
    try:
        for k in range(3):  # each a run of its own, from the checkpoint of the one before
            spark.createDataFrame(rows[k::3], BLOCK).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(BLOCK).option("maxFilesPerTrigger", 1).parquet(source)
            put = lambda df, n: df.write.mode("append").parquet(sink)
            evidence.latest_evidence(stream).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider) if provider else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    whole = spark.read.parquet(sink)
    told = whole.groupBy("response").agg(F.max_by(F.struct("terminal", "output", "blocks", "conflict"), "change").alias("x")).select("response", "x.*")
    want = evidence.terminals(spark.createDataFrame(rows, BLOCK))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect()))
    assert whole.agg(F.sum("late")).first()[0] > 0
    # a terminal never goes back
    assert whole.alias("a").join(whole.alias("b"), "response").where("a.change < b.change AND a.terminal > b.terminal").count() == 0
