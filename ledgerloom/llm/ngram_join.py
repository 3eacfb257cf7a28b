"""N-gram Jaccard join by parity sketches.

A document's distinct k-word shingles are hashed; each falls into a block, and a block is
the XOR of its shingles' hashes. A shingle that only one of two documents has changes one
block, so the number of blocks that differ is at most the symmetric difference, which a
Jaccard similarity bounds by the sizes. Blocks are fixed for each band of sizes; two
documents that link then agree in one of the first bound + 1 filled blocks of each, in any
order that is the same for all. Those are the rows that are joined. Nodes that agree are
screened by parity sketches of a few bits for each shingle, whose Hamming distance bounds the symmetric
difference from below too, and verified by their shingles.

The order puts blocks made of common shingles last. How common shingles are is counted over all
rows, in a table of fixed size that each task fills and that is summed on the executors; the count
changes which blocks are tried, never the result.

Defined results: texts that are null or have no word have no shingles, n_shingles 0, and
link with nothing; a text of fewer words than k is one shingle; repeated rows and equal
texts are one class; a null doc_id takes part and is never the smallest unless alone; an
empty table gives an empty result; extra columns are ignored.

Sets of different content share a 64-bit name, or a document has too few filled blocks,
with a probability under 1e-10 for each document; else links are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions
from .near import Shingler, bounded, crowded, digest, link, mix, sketch

#: Counters of the table in which shingles are counted, and how many rows of it are summed at once. A shingle is common
#: if its counter has twice the mean and COMMON_IN more: in about one document of a thousand, at any size of the corpus.
COUNTERS, SLICES, COMMON_IN = 1 << 19, 64, 8
#: A sketch has 2 << 10 bits at least.
SKETCH_LEAST = 10


def most_apart(n: int, other: int, percent: int) -> int:
    """The largest symmetric difference of sets of n and other that are percent alike."""
    return (n + other) * (100 - percent) // (100 + percent)


def bands(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, bound): the bands of sizes in which a set of n looks for partners, and how many blocks may differ.

    Band z is for pairs whose smaller set has 2**z to 2**(z + 1) - 1 shingles.
    """
    z = n.bit_length() - 1
    found = [(z, most_apart(n, n * 100 // percent, percent))]
    if z and n * percent <= 100 * ((1 << z) - 1):  # or as the larger one of a pair
        found.append((z - 1, most_apart(n, (1 << z) - 1, percent)))
    return found


def n_blocks(band: int) -> int:
    """Enough for more filled blocks than may differ; small sets get a block for each shingle."""
    return 1 << (band if band >= 7 else 16)


def counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)) & np.uint64(COUNTERS - 1)


def signatures(shingles: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The blocks by which a set is joined, as 64-bit numbers; common tells for each counter whether its shingles are."""
    out = [np.zeros(0, dtype=np.uint64)]
    often = common[counter(shingles)]
    for band, bound in bands(len(shingles), percent):
        if not bound:  # only equal sets, which are one node
            continue
        block = (shingles >> np.uint64(16)) & np.uint64(n_blocks(band) - 1)
        order = np.argsort(block, kind="stable")
        block = block[order]
        starts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1])
        value = np.bitwise_xor.reduceat(shingles[order], starts)
        late = np.logical_and.reduceat(often[order], starts)
        chosen = np.argsort(late, kind="stable")[: bound + 1]
        out.append(mix(value[chosen] + block[starts][chosen] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)))
    return np.concatenate(out)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def features(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, sketch) for each row; node names the shingle set. Of equal sets that one
    task sees, the first alone has a sketch. And a row for each task with counts alone, how many sets have shingles
    of each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(k), set()
        counts, waiting, size = np.zeros(COUNTERS, dtype=np.int64), [], 0
        for batch in batches:
            sizes, names, sketches = [], [], []
            for t in batch["text"]:
                s = shingler.shingles(t.as_py())
                sizes.append(len(s))
                names.append(node := digest(s))
                if node in seen or not len(s):
                    sketches.append(None)
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                sketches.append(sketch(s, SKETCH_LEAST))
                waiting.append(counter(s).astype(np.int64))
                size += len(s)
                if size > 500_000:
                    counts += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
                    waiting, size = [], 0
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.nulls(len(names), pa.binary())], FEATURES)
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
        if seen:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, kind) for kind in (*[pa.int64()] * 4, pa.list_(pa.int64()))), pa.array([counts.astype(np.uint32).tobytes()])], FEATURES)

    rows = _rows(docs, doc_id, text).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, sketch array<long>, counts binary")


FEATURES = ["doc_id", "text_hash", "n_shingles", "node", "sketch", "counts"]


def common_counters(tables: DataFrame) -> np.ndarray:
    """Which counters are common, from the tables (counts) of all tasks, summed in two steps on the executors."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for x in batch["counts"]:
                total += np.frombuffer(x.as_py(), dtype=np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(total, SLICES)])], ["slice", "counts"])

    def added(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in part["counts"])
        return pa.table({"slice": part["slice"][:1], "counts": pa.array([total.tobytes()])})

    narrow = tables.coalesce(max(1, round(tables.rdd.getNumPartitions() ** 0.5)))
    rows = narrow.mapInArrow(summed, "slice int, counts binary").groupBy("slice").applyInArrow(added, "slice int, counts binary").orderBy("slice").collect()
    counts = np.concatenate([np.frombuffer(r["counts"], dtype=np.int64) for r in rows]) if rows else np.zeros(COUNTERS, dtype=np.int64)
    return counts > 2 * counts.mean() + COMMON_IN


def signature_rows(docs: DataFrame, k: int, percent: int, common: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(sig, node). Of equal sets that one task sees, the first alone gives rows."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, often = Shingler(k), set(), np.unpackbits(shared.value).astype(bool)
        sigs, nodes, waiting = [], [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], ["sig", "node"])
            sigs.clear(), nodes.clear()
            return out

        for batch in batches:
            for t in batch["text"]:
                s = shingler.shingles(t.as_py())
                if not len(s) or (node := digest(s)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                sigs.append(signatures(s, often, percent))
                nodes.append(np.full(len(sigs[-1]), node, dtype=np.int64))
                waiting += len(sigs[-1])
                if waiting > 200_000:
                    yield flush()
                    waiting = 0
        if sigs:
            yield flush()

    return _rows(docs, doc_id, text).select("text").mapInArrow(run, "sig long, node long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, shingles) of the wanted (doc_id, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            for t, node in zip(batch["text"], batch["node"], strict=True):
                s = shingler.shingles(t.as_py())
                if digest(s) == node.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["node", "shingles"])

    rows = _rows(docs, doc_id, text).join(wanted.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "node")
    return rows.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _placed(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The features of docs, and (node, component_id, kept) of each node; kept is the row that stays of a component."""
    if not 50 <= percent <= 100:
        raise ValueError("bands of sizes hold partners of 50 to 100 percent")
    every = materialize(features(docs, k, doc_id, text))
    rows = every.where("n_shingles is not null").select("doc_id", "text_hash", "n_shingles", "node")
    nodes = materialize(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(_row()).alias("first_row")))
    common = common_counters(every.where("counts is not null").select("counts"))
    members = crowded(signature_rows(docs, k, percent, common, doc_id, text), 2 * partitions(docs.sparkSession))
    sketches = every.where("sketch is not null").select("node", "n_shingles", "sketch")
    info = materialize(sketches.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    fetch = lambda asked: shingle_sets(docs, bounded(nodes.join(asked, "node").select(F.col("first_id").alias("doc_id"), "node")), k, doc_id, text)
    parts = link(members, fetch, info, percent)
    linked = materialize(nodes.join(parts, "node"))
    first = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.min("first_row").alias("kept"))
    found = linked.select("node", "component").join(bounded(materialize(first)), "component").select("node", F.col("component_id").alias("_id"), F.col("kept").alias("_kept"))
    placed = nodes.join(found, "node", "left").select("node", F.when(F.col("_kept").isNull(), F.col("first_id")).otherwise(F.col("_id")).alias("component_id"), F.coalesce("_kept", "first_row").alias("kept"))
    return rows, materialize(placed)


def _row() -> Column:
    """What tells rows apart, in the order in which they stay: rows without a doc_id come last."""
    return F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    rows, placed = _placed(docs, k, percent, doc_id, text)
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("n_shingles > 0").join(placed, "node").select("doc_id", "n_shingles", "component_id").unionByName(none)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those whose component has a row of smaller doc_id, then text hash. Rows
    equal in both are told apart by nothing and stay or go together."""
    rows, placed = _placed(docs, k, percent, doc_id, text)
    gone = rows.where("n_shingles > 0").join(placed, "node").where(~_row().eqNullSafe(F.col("kept"))).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, docs[doc_id].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[text]) == gone["_hash"]), "left_anti")
