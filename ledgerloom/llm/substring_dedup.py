"""Substring dedup by MinHash banding of content-defined paragraphs.

Paragraphs are cut where the words themselves say so, whatever lines they stand in. A band is a
random order of 5-word shingles; in each band the first of every SEEDS shingles in a row, their
MinHash, is a seed. A paragraph is SPAN words around a seed and stands for its bag of 3-word
shingles. Paragraphs at the same seed share a bucket; parity sketches screen them, exact Jaccard
similarity of the bags verifies links, and components of the links are the clusters. Of each
cluster the occurrence first in (doc_id, place) stays and all others are removals; removals that
overlap or adjoin are one span. Equal texts are one text; of their documents the first stays.

Any PASSAGE equal words in a row hold a whole paragraph, so they are always found. Two stretches
of SEEDS shingles that are alike to a degree share a band's MinHash with that probability; tune()
takes as many bands as make it high. A span may begin and end up to SPAN - 1 words inside the
passage that is repeated.

Defined results: null and empty texts, and those of fewer words than SPAN, have no paragraphs;
rows equal in doc_id and text are one document; repeats within one text alone are not reported;
a null doc_id comes first; an empty table gives an empty result; extra columns are ignored by
repeats() and kept by without_repeats().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, partitions
from .near import AT_ONCE, CHUNK, SETS_CHUNK, Shingler, bounded, buckets, crowded, joined, link, mix

#: Words of a passage that is always found, words of a paragraph, how many of them stand before its seed, and shingles
#: of which the first is a seed. PASSAGE words hold SEEDS paragraphs, so the one at their seed is among them.
PASSAGE, SPAN, BEFORE = 50, 25, 10
SEEDS = PASSAGE - SPAN + 1
#: Lengths of the shingles that are seeds, and of those that a paragraph is compared by; how many of these it has.
SEED_WORDS, PART_WORDS = 5, 3
PARTS = SPAN - PART_WORDS + 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def tune(similarity: float, recall: float = 0.9) -> int:
    """The fewest bands by which stretches of the similarity share a MinHash with the recall."""
    bands = 1
    while 1 - (1 - similarity) ** bands < recall:
        bands += 1
    return bands


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends, in characters of text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    blank = np.concatenate([[True], _BLANK[raw], [True]])
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    if len(raw) != len(text):
        turns = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[turns]
    return turns[::2], turns[1::2]


class Cutter:
    """Cuts texts into paragraphs."""

    def __init__(self, bands: int):
        self.words = Shingler(SEED_WORDS)
        self.orders = [np.uint64(0)] + [mix(np.array([b], dtype=np.uint64))[0] for b in range(1, bands)]

    def hashes(self, text: str) -> np.ndarray:
        words = self.words.words(text)
        return self.words.hashes(words) if len(words) >= SPAN else np.zeros(0, dtype=np.uint64)

    def bags(self, texts: list[str]) -> np.ndarray:
        """The bags of paragraphs, PARTS elements each: a shingle's second place in a paragraph is an element of its own."""
        h = self.words.hashes(self.words.words(" ".join(texts))).reshape(-1, SPAN)
        parts = joined(h.ravel(), PART_WORDS)
        parts = np.sort(np.lib.stride_tricks.sliding_window_view(parts, PARTS)[::SPAN], axis=1)
        again = np.zeros(parts.shape, dtype=np.uint64)
        for k in range(1, PARTS):
            again[:, k] = np.where(parts[:, k] == parts[:, k - 1], again[:, k - 1] + np.uint64(1), 0)
        return np.where(again > 0, mix(parts + again), parts)

    def cut(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, name, first word) of each paragraph. The lower half of a name is a parity sketch of the bag."""
        h = self.hashes(text)
        if not len(h):
            return (np.zeros(0, dtype=np.int64),) * 3
        seeds, parts = joined(h, SEED_WORDS)[BEFORE : len(h) - SPAN + BEFORE + 1], joined(h, PART_WORDS)
        chosen, width = np.zeros(len(seeds), dtype=bool), min(SEEDS, len(seeds))
        for order in self.orders:
            views = np.lib.stride_tricks.sliding_window_view(mix(seeds ^ order) if order else seeds, width)
            chosen[views.argmin(axis=1) + np.arange(len(views))] = True
        at = np.flatnonzero(chosen)
        sums, odd = np.zeros(len(parts) + 1, dtype=np.uint64), np.zeros(len(parts) + 1, dtype=np.uint64)
        np.cumsum(mix(parts ^ np.uint64(0x5BD1E995)), out=sums[1:])
        np.bitwise_xor.accumulate(np.uint64(1) << (parts & np.uint64(31)), out=odd[1:])
        names = mix(sums[at + PARTS] - sums[at]) & np.uint64(0xFFFFFFFF00000000) | odd[at + PARTS] ^ odd[at]
        return mix(seeds[at]).view(np.int64), names.view(np.int64), at


def paragraphs(docs: DataFrame, bands: int, text: str = "text") -> DataFrame:
    """(sig, node, name, at, span, more) of each paragraph: name is of the text, node of the bag, at is the first word, and
    span holds the first character and the number of characters, in 32 bits each. more lists at and span of the other
    places of the paragraph in the text, one after the other. Of equal texts that one task sees, the first alone gives rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = Cutter(bands), set()
        out, names, more, size = [], [], {}, 0

        def told() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            name = pa.array(np.repeat(np.array(names, dtype=np.int64), [len(x[0]) for x in out]))
            others = pa.array([more.get(i) for i in range(len(name))] if more else pa.nulls(len(name)), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*columns[:2], name, *columns[2:], others], ["sig", "node", "name", "at", "span", "more"])

        for batch in batches:
            for name, t in zip(batch["name"].to_pylist(), batch["text"], strict=True):
                if name in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                t = t.as_py() or ""
                sig, node, at = cutter.cut(t)
                if not len(at):
                    continue
                starts, ends = places(t)
                span = starts[at] << 32 | ends[at + SPAN - 1] - starts[at]
                if len(np.unique(sig)) < len(sig):
                    own: dict[tuple[int, int], int] = {}
                    for i, key in enumerate(zip(sig.tolist(), node.tolist(), strict=True)):
                        if key in own:
                            more.setdefault(size + own[key], []).extend((int(at[i]), int(span[i])))
                        else:
                            own[key] = len(own)
                    _, first = np.unique(np.stack([sig, node]), axis=1, return_index=True)
                    first.sort()
                    sig, node, at, span = sig[first], node[first], at[first], span[first]
                out.append((sig, node, at, span))
                names.append(name)
                size += len(at)
                if size > 100_000:
                    yield told()
                    out, names, more, size = [], [], {}, 0
        if out:
            yield told()

    return docs.select(F.xxhash64(text).alias("name"), F.col(text).alias("text")).mapInArrow(run, "sig long, node long, name long, at long, span long, more array<long>")


def bags(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(node, n_shingles, sketch) of the wanted (name, span, node); the sketch is the bag itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = cutter.bags(part["paragraph"].to_pylist()).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * PARTS), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(np.full(len(found), PARTS)), flat], ["node", "n_shingles", "sketch"])

    # the names alone choose the texts, so that only those are moved
    some = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("name")).join(bounded(wanted.select("name").distinct()), "name", "left_semi")
    start, length = _places(F.col("span"))
    rows = some.dropDuplicates(["name"]).join(wanted, "name").select("node", F.substring("text", start + 1, length).alias("paragraph"))
    return rows.mapInArrow(run, "node long, n_shingles long, sketch array<long>")


def _places(span: Column) -> tuple[Column, Column]:
    return F.shiftright(span, 32).cast("int"), span.bitwiseAND(F.lit(2**32 - 1)).cast("int")


def hopeful(members: DataFrame, percent: int) -> DataFrame:
    """The members without those whose sketch allows no link in their bucket. Members of large buckets all stay."""
    most = 2 * PARTS * (100 - percent) // (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in buckets(batches, ("sig",)):
            sig, node, many = (table[c].to_numpy() for c in ("sig", "node", "many"))
            bits, keep = node.view(np.uint64) & np.uint64(0xFFFFFFFF), many > CHUNK
            ends = np.append(np.flatnonzero(sig[1:] != sig[:-1]) + 1, len(sig))
            starts = np.append(0, ends[:-1])
            pair = starts[ends - starts == 2]  # most buckets
            keep[pair] = keep[pair + 1] = np.bitwise_count(bits[pair] ^ bits[pair + 1]) <= most
            for start, stop in zip(starts.tolist(), ends.tolist(), strict=True):
                if stop - start == 2 or keep[start]:
                    continue
                x, step = bits[start:stop], max(1, AT_ONCE // (stop - start))
                for at in range(0, len(x), step):
                    some = x[at : at + step]
                    keep[start + at : start + at + len(some)] = (np.bitwise_count(some[:, None] ^ x[None]) <= most).sum(axis=1) > 1
            yield from table.filter(pa.array(keep)).to_batches()

    dealt = members.repartition(partitions(members.sparkSession), "sig").sortWithinPartitions("sig")
    return dealt.mapInArrow(run, members.schema)


def narrowed(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members, with buckets of more than SETS_CHUNK nodes dealt anew: such a bucket holds a passage that is common in unlike
    surroundings. Nodes that link share one of the rarest elements of each, as counted in the bucket, so many that fewer
    are left than a link must share; those are the new buckets."""
    large = materialize(members.where(F.col("many") > SETS_CHUNK).select("sig", "node"))
    if large.isEmpty():
        return members
    each = large.join(sets, "node").select("sig", "node", "n_shingles", F.explode("sketch").alias("e"))
    counts = materialize(each.groupBy("sig", "e").agg(F.count("*").alias("n")))
    rank = F.row_number().over(Window.partitionBy("sig", "node").orderBy("n", "e"))
    least = F.ceil(F.col("n_shingles") * percent / 100)
    chosen = each.join(counts, ["sig", "e"]).withColumn("_rank", rank).where(F.col("_rank") <= F.col("n_shingles") - least + 1)
    dealt = crowded(chosen.select(F.xxhash64("sig", "e").alias("sig"), "node"), partitions(members.sparkSession))
    return members.where(F.col("many") <= SETS_CHUNK).unionByName(dealt)


def repeats(docs: DataFrame, percent: int = 75, bands: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The passages that more than one document has, near copies included:
    (doc_id, start, stop, n_words, cluster_doc, cluster_start, cluster_size, removed), and name, that of the text.

    start and stop are characters of the text; cluster_doc and cluster_start name the place that stays, and cluster_size
    counts the documents' occurrences. A document whose text a document before it has is one passage; the passages
    inside it are told of the first alone.
    """
    parts = partitions(docs.sparkSession)
    bucket = Window.partitionBy("sig")
    every = paragraphs(docs, bands or tune(percent / 100), text).repartition(2 * parts, "sig")
    shared = every.withColumns({"_low": F.min("name").over(bucket), "_high": F.max("name").over(bucket)}).where("_low <> _high")
    shared = materialize(shared.select("sig", "node", "name", "at", "span", "more"))
    members = materialize(hopeful(crowded(shared.select("sig", "node"), parts), percent))
    nodes = shared.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("name", "span")).alias("one"))
    sets = materialize(bags(docs, materialize(nodes.select("one.name", "one.span", "node")), text))
    linked = link(narrowed(members, sets, percent), None, sets, percent, SETS_CHUNK)

    keys = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("name")).where("name is not null").distinct()
    texts = materialize(keys.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    named = shared.join(bounded(linked), "node", "left").select(F.coalesce("component", "node").alias("cluster"), "name", "at", "span", "more")
    named = named.join(bounded(texts), "name")
    first = F.min(F.struct("doc_id", "name", "at", "span")).alias("first")
    clusters = named.groupBy("cluster").agg(first, F.min("name").alias("_low"), F.max("name").alias("_high"), F.sum(F.col("copies") * (1 + F.coalesce(F.size("more"), F.lit(0)) / 2)).cast("long").alias("size"))
    clusters = materialize(clusters.where("_low <> _high").select("cluster", "first", "size"))
    # a paragraph that overlaps the one that stays is part of it
    stays = (F.col("name") == F.col("first.name")) & (F.abs(F.col("at") - F.col("first.at")) < SPAN)
    others = F.transform(F.sequence(F.lit(0), F.size("more") - 2, F.lit(2)), lambda i: F.struct(F.get("more", i).alias("at"), F.get("more", i + 1).alias("span")))
    each = F.concat(F.array(F.struct("at", "span")), F.when(F.col("more").isNull(), F.array().cast("array<struct<at:bigint,span:bigint>>")).otherwise(others))
    found = named.join(clusters, "cluster").withColumn("_at", F.explode(each)).select("name", "doc_id", "first", "size", "_at.at", "_at.span")
    hits = found.select("name", "doc_id", "at", "span", "size", (~stays).alias("removed"), F.col("first.doc_id").alias("cluster_doc"), F.col("first.span").alias("_first"))
    hits = hits.groupBy("name", "doc_id", "at", "span").agg(F.max(F.struct("removed", "size", "cluster_doc", "_first")).alias("of")).select("name", "doc_id", "at", "span", "of.*")

    again = bounded(materialize(texts.where("copies > 1").select("name", F.col("doc_id").alias("cluster_doc"), F.col("copies").alias("cluster_size"))))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("name")).join(again, "name")
    whole = rows.select(
        "doc_id", F.lit(0).cast("long").alias("start"), F.char_length("_text").cast("long").alias("stop"), F.when(F.col("cluster_size") > 1, F.regexp_count("_text", F.lit(WORD))).cast("long").alias("n_words"),
        "cluster_doc", F.lit(0).cast("long").alias("cluster_start"), "cluster_size", (~F.col("doc_id").eqNullSafe(F.col("cluster_doc"))).alias("removed"), "name",
    ).where(F.col("n_words") >= SPAN)
    return _spans(hits).unionByName(whole.distinct())


def _spans(hits: DataFrame) -> DataFrame:
    """Paragraphs of one text that overlap or adjoin, and are of the same document's clusters, as one row."""
    start, length = (c.cast("long") for c in _places(F.col("span")))
    key = Window.partitionBy("name", "removed", "cluster_doc").orderBy("at")
    rows = hits.withColumn("_new", F.coalesce(F.col("at") - F.lag("at").over(key) > SPAN, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(key))
    spans = rows.groupBy("name", "doc_id", "removed", "cluster_doc", "_run").agg(
        F.min(start).alias("start"), F.max(start + length).alias("stop"), (F.max("at") - F.min("at") + SPAN).alias("n_words"),
        F.shiftright(F.min_by("_first", "at"), 32).alias("cluster_start"), F.max("size").alias("cluster_size"),
    )
    return spans.select("doc_id", "start", "stop", "n_words", "cluster_doc", "cluster_start", "cluster_size", "removed", "name")


def _cut(text: str | None, gone: list | None) -> str | None:
    """text without the spans; lines of which nothing is left go with their ends."""
    if text is None or not gone:
        return text
    out, start = [], 0
    for line in text.split("\n"):
        kept, at = "", 0
        for a, b in sorted((max(x["start"] - start, 0), min(x["stop"] - start, len(line))) for x in gone if x["start"] <= start + len(line) and x["stop"] >= start):
            if b >= a:
                kept, at = kept + line[at : max(a, at)], max(at, b)
        kept += line[at:]
        if kept.strip() or not line.strip():
            out.append(kept)
        start += len(line) + 1
    return "\n".join(out)


def without_repeats(docs: DataFrame, percent: int = 75, bands: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed passages cut out of text, line ends included where a line is empty then."""
    found = repeats(docs, percent, bands, doc_id, text).where("removed")
    gone = found.groupBy("doc_id", "name").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    of = lambda c: F.col("row").getField(c)
    rows = rows.withColumns({"_id": of(doc_id).cast("long"), "_name": F.xxhash64(of(text))})
    placed = rows.join(gone, (F.col("_name") == F.col("name")) & F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    cut: Column = F.udf(_cut, "string")(of(text), F.col("gone"))
    return placed.select(*(cut.alias(c) if c == text else of(c).alias(c) for c in docs.columns))
