"""MinHash near-dedup by a multi-index Hamming join.

A document's distinct k-word shingles have SYMBOLS minima under as many hashes; b bits of each are its signature. Two
sets of Jaccard similarity s differ in a symbol with probability 1 - s at most, so signatures of a link are seldom more
than DISTANCE symbols apart. A signature is split into CHUNKS: by the pigeonhole principle, two that are DISTANCE apart
agree, in some chunk, in all but DISTANCE // CHUNKS symbols. Those errors are enumerated, a key for each choice of
symbols to leave out, so every pair under the threshold shares a key. The keys are joined; nodes that share one are
screened by parity sketches, which lose no link, and verified by their whole shingle sets.

Keys are made by the executors from one stored row for each distinct set. A key's bucket is found by an aggregate that
tasks combine before the exchange, so a key of any number of nodes is one row for a task; its nodes are then joined to
it, and a bucket of more than near.CHUNK nodes is dealt into chunks.

Defined results: texts that are null or have no word have no shingles, n_shingles 0, and link with nothing; a text of
fewer words than k is one shingle; repeated rows and equal texts are one class; a null doc_id takes part and is never
the smallest unless alone; an empty table gives an empty result; extra columns are ignored by minhash_join() and kept,
whatever their names, by keep_smallest().

A link of exactly the least similarity is missed with the probability of missed(): 3 in a million at 85 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, stored
from .near import Shingler, bounded, digest, link, mix, shared, sketch
from .ngram_join import SKETCH_LEAST, shingle_sets

#: Symbols of a signature, bits of each, chunks, and symbols in which two signatures may differ.
SYMBOLS, BITS, CHUNKS, DISTANCE = 32, 16, 8, 15
#: Shingles that are hashed at once. Bounds memory only.
AT_ONCE = 8192
#: An odd multiplier for each symbol, by a rule: the splitmix sequence.
_HASHES = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def missed(percent: int, distance: int = DISTANCE, symbols: int = SYMBOLS) -> float:
    """The probability that signatures of sets of this similarity are more than distance apart."""
    apart = 1 - percent / 100
    return sum(comb(symbols, d) * apart**d * (1 - apart) ** (symbols - d) for d in range(distance + 1, symbols + 1))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima under each hash."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), AT_ONCE):
        np.minimum(low, (shingles[at : at + AT_ONCE, None] * _HASHES).min(axis=0), out=low)
    return (mix(low) & np.uint64((1 << BITS) - 1)).astype(np.int32)


def keys(signature: Column, chunks: int = CHUNKS, distance: int = DISTANCE, symbols: int = SYMBOLS) -> Column:
    """The keys that two signatures share one of if they are distance apart at most: each chunk without each choice of
    distance // chunks symbols."""
    out, errors = [], distance // chunks
    for c in range(chunks):
        here = range(c * symbols // chunks, (c + 1) * symbols // chunks)
        if errors >= len(here):
            raise ValueError("a chunk must have more symbols than errors")
        for left in combinations(here, len(here) - errors):
            out.append(F.xxhash64(F.lit(len(out)), *(F.get(signature, F.lit(i)) for i in left)))
    return F.array(*out)


def features(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, sketch, signature) for each row; node names the shingle set. Of equal sets
    that one task sees, the first alone has a sketch and a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(k), set()
        for batch in batches:
            sizes, names, sketches, signs = [], [], [], []
            for t in batch["text"]:
                s = shingler.shingles(t.as_py())
                sizes.append(len(s))
                names.append(node := digest(s))
                new = len(s) > 0 and node not in seen
                if new:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(node)
                sketches.append(sketch(s, SKETCH_LEAST) if new else None)
                signs.append(signature(s) if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int32()))],
                ["doc_id", "text_hash", "n_shingles", "node", "sketch", "signature"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, sketch array<long>, signature array<int>")


def _placed(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The features of docs, and (node, component_id, kept) of each node; kept is the row that stays of a component."""
    if not 50 <= percent <= 100:
        raise ValueError("signatures tell sets apart that are 50 to 100 percent alike")
    every = stored(features(docs, k, doc_id, text))
    rows = every.select("doc_id", "text_hash", "n_shingles", "node")
    nodes = materialize(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(_row()).alias("first_row")))
    signed = every.where("signature is not null").select("node", "signature").dropDuplicates(["node"])
    members = shared(signed.select(F.explode(keys(F.col("signature"))).alias("sig"), "node"))
    sketches = every.where("sketch is not null").select("node", "n_shingles", "sketch")
    info = materialize(sketches.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    fetch = lambda asked: shingle_sets(docs, bounded(nodes.join(asked, "node").select(F.col("first_id").alias("doc_id"), "node")), k, doc_id, text)
    linked = materialize(nodes.join(link(members, fetch, info, percent), "node"))
    first = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.min("first_row").alias("kept"))
    found = linked.select("node", "component").join(bounded(materialize(first)), "component").select("node", F.col("component_id").alias("_id"), F.col("kept").alias("_kept"))
    placed = nodes.join(found, "node", "left").select("node", F.when(F.col("_kept").isNull(), F.col("first_id")).otherwise(F.col("_id")).alias("component_id"), F.coalesce("_kept", "first_row").alias("kept"))
    return rows, materialize(placed)


def _row() -> Column:
    """What tells rows apart, in the order in which they stay: rows without a doc_id come last."""
    return F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")


def minhash_join(docs: DataFrame, k: int = 5, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    rows, placed = _placed(docs, k, percent, doc_id, text)
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    told = rows.where("n_shingles > 0").join(placed, "node").select("doc_id", "n_shingles", "component_id").unionByName(none)
    return told.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_smallest(docs: DataFrame, k: int = 5, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those whose component has a row of smaller doc_id, then text hash. Rows equal in both
    are told apart by nothing and stay or go together."""
    rows, placed = _placed(docs, k, percent, doc_id, text)
    gone = rows.where("n_shingles > 0").join(placed, "node").where(~_row().eqNullSafe(F.col("kept"))).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    packed = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.struct("*").alias("row"))
    stays = packed.alias("d").join(gone.alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.hash") == F.col("g.hash")), "left_anti")
    return stays.select("row.*")
