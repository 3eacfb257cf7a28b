"""Phrase collocation mining.

Texts are cut into pieces at punctuation and line ends, pieces into words. All phrases of 1 to max_n words are exploded
into rows (lang, phrase, f), counted within a task and then hash-aggregated by language. Candidates are cut everywhere,
each cut joined to the counts of its prefix and suffix and scored in decimals; those that a one-word extension always
contains are anti-joined away; a window ranks the rest.

A phrase has at least min_count occurrences only if each of its words and each pair of neighbours has, so longer phrases
are exploded only where those may have: words first, then pairs, then the rest, a pass over the texts each. What is
frequent is told by a filter of FILTER_BITS bits, a size that does not depend on the data. A bit that is set by chance
gives a row more, which the counts then drop; with a filter that is full, all phrases are exploded. So results are exact
at any size. Counts within a task are of whole words, not of hashes.

Defined results: a null text is empty; a null lang is `und`, like the lang of that name; repeated rows count again; doc_id is not
looked at; ties in score and count are ordered by the phrase's UTF-8 bytes; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .near import joined, mix

#: Where pieces end: marks, and LF to CR; and what becomes of these bytes and of A-Z. Words end at a space or tab too.
ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER_BLANK = bytes(32 if b in ENDS or b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.array([2 if b in ENDS else 1 if b in b" \t" else 0 for b in range(256)], dtype=np.uint8)
#: Bits of the filter that tells what may be frequent; the words of a chunk that a task counts at once, and rows that go out together. Bound memory only.
FILTER_BITS, CHUNK_WORDS, SLICE_ROWS = 1 << 26, 1_500_000, 50_000
#: How often a phrase stands where chance would put it once, in thousandths; exact, as products may pass 64 bits.
SCORE = "(cast(1000 * a as decimal(19)) * cast(n as decimal(19))) div (cast(l as decimal(19)) * cast(r as decimal(19)))"
#: Parts of a language whose best phrases are found before those of the whole.
RANK_PARTS = 64


class Chunk:
    """The words of some texts: ids by language and word, the pieces that they stand in, and the words' hashes."""

    def __init__(self):
        self.known: dict[bytes, dict[bytes, int]] = {}
        self.words: list[bytes] = []
        self.langs: list[bytes] = []
        self.hashes: list[int] = []
        self.ids, self.pieces, self.size, self.last = [], [], 0, 0

    def add(self, lang: bytes, text: bytes) -> None:
        found = text.translate(_LOWER_BLANK).split(b" ")
        found = list(filter(None, found))
        if not found:
            return
        known = self.known.setdefault(lang, {})
        ids = list(map(known.get, found))
        if None in ids:
            seed = xxhash.xxh3_64_intdigest(lang)
            for i, x in enumerate(ids):
                if x is None:
                    word = found[i]
                    if (x := known.get(word)) is None:
                        x = known[word] = len(self.words)
                        self.words.append(word)
                        self.langs.append(lang)
                        self.hashes.append(xxhash.xxh3_64_intdigest(word, seed))
                    ids[i] = x
        kind = _KIND[np.frombuffer(text, dtype=np.uint8)]
        starts = np.flatnonzero((kind == 0) & (np.concatenate([[1], kind[:-1]]) != 0))
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.ids.append(np.array(ids, dtype=np.int64))
        self.pieces.append(piece + self.last)
        self.last += int(piece[-1]) + 1
        self.size += len(ids)

    def counted(self, least: int, most: int, filters: list[np.ndarray]) -> Iterator[tuple[list[bytes], list[bytes], list[int]]]:
        """(langs, phrases, counts) of phrases of least to most words, all whose words and pairs may be frequent, in slices."""
        if not self.size:
            return
        ids, piece, hashes = np.concatenate(self.ids), np.concatenate(self.pieces), np.array(self.hashes, dtype=np.uint64)
        if least == 1:
            many = np.bincount(ids, minlength=len(self.words))
            for k in range(0, len(many), SLICE_ROWS):
                yield self.langs[k : k + SLICE_ROWS], self.words[k : k + SLICE_ROWS], many[k : k + SLICE_ROWS].tolist()
            return
        pair_ok = piece[1:] == piece[:-1]
        if filters:
            word_ok = may_have(filters[0], mix(hashes))[ids]
            pair_ok &= word_ok[1:] & word_ok[:-1]
        at = np.flatnonzero(pair_ok)
        if len(filters) > 1:
            at = at[may_have(filters[1], pair_hash(hashes[ids[at]], hashes[ids[at + 1]]))]
            pair_ok = np.zeros(len(pair_ok), dtype=bool)
            pair_ok[at] = True
        name = ids  # of the phrase that begins at each place of at, told by whole words
        for n in range(2, most + 1):
            if n > 2:
                stay = at + n - 2 < len(pair_ok)
                stay[stay] = pair_ok[at[stay] + n - 2]
                at, name = at[stay], name[stay]
            else:
                name = ids[at]
            if not len(at):
                break
            _, first, name, many = np.unique(name * len(self.words) + ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
            for k in range(0, len(first), SLICE_ROWS) if n >= least else ():
                rows, words = ids[at[first[k : k + SLICE_ROWS]][:, None] + np.arange(n)].tolist(), self.words
                yield [self.langs[r[0]] for r in rows], [b" ".join([words[i] for i in r]) for r in rows], many[k : k + SLICE_ROWS].tolist()


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one * np.uint64(0x9E3779B97F4A7C15) + two * np.uint64(0xC2B2AE3D27D4EB4F))


def may_have(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def exploded(docs: DataFrame, least: int, most: int, filters: list, lang: str, text: str) -> DataFrame:
    """(lang, phrase, f) of phrases of least to most words, counted for each chunk of a task."""
    sent = [docs.sparkSession.sparkContext.broadcast(x) for x in filters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, chunk = [x.value for x in sent], Chunk()

        def flush() -> Iterator[pa.RecordBatch]:
            for langs, phrases, counts in chunk.counted(least, most, told):
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.binary()).cast(pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for one, t in zip(batch["lang"], batch["text"], strict=True):
                chunk.add(one.as_py(), t.as_py())
                if chunk.size >= CHUNK_WORDS:
                    yield from flush()
                    chunk = Chunk()
        yield from flush()

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).cast("binary").alias("lang"), F.col(text).cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "lang string, phrase string, f long")


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def filter_of(frequent: DataFrame) -> np.ndarray:
    """The filter that has the words or pairs of words, (lang, phrase). At most FILTER_BITS / 64 numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch["lang"], batch["phrase"], strict=True):
                seed = xxhash.xxh3_64_intdigest(lang.as_py())
                hashes.append([xxhash.xxh3_64_intdigest(w, seed) for w in phrase.as_py().split(b" ")])
            table = np.array(hashes, dtype=np.uint64).reshape(len(hashes), -1)
            if not len(table):
                continue
            slot = (mix(table[:, 0]) if table.shape[1] == 1 else pair_hash(table[:, 0], table[:, 1])) & np.uint64(FILTER_BITS - 1)
            bits = (np.uint64(1) << (slot & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int32)), pa.array(bits)], ["slot", "bits"])

    marks = frequent.select(F.col("lang").cast("binary").alias("lang"), F.col("phrase").cast("binary").alias("phrase")).mapInArrow(run, "slot int, bits long")
    table = marks.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    out[table["slot"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def _part(words: str, begin: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(F.col(words), F.lit(begin) if isinstance(begin, int) else begin, length), " ")


def collocations(docs: DataFrame, max_n: int = 5, min_count: int = 100, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to max_n words."""
    if max_n < 2:
        raise ValueError("phrases have two words or more")
    words = stored(counts(exploded(docs, 1, 1, [], lang, text)))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = [words.where(F.col("f") >= min_count)]
    filters = [filter_of(often[0])]
    for least, most in ((2, 2), (3, max_n)):
        if least <= max_n:
            often.append(stored(counts(exploded(docs, least, most, filters, lang, text)).where(F.col("f") >= min_count)))
            if least == 2 and max_n > 2:
                filters.append(filter_of(often[1]))
    phrases = often[1] if max_n == 2 else often[1].unionByName(often[2])
    every = often[0].unionByName(phrases)

    parts = phrases.withColumn("w", F.split("phrase", " "))
    size = F.size("w")
    cut = parts.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part("w", 1, F.col("k")).alias("first"), _part("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    one, two = (every.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)) for name, count in (("first", "l"), ("rest", "r")))
    scored = cut.join(one, ["lang", "first"]).join(two, ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("score", F.expr(SCORE))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("low"))

    longer = parts.where(size > 2).select("lang", "f", F.explode(F.array(_part("w", 1, size - 1), _part("w", 2, size - 1))).alias("phrase"))
    inside = longer.withColumnRenamed("f", "a").distinct()
    left = lowest.join(inside, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    some = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
