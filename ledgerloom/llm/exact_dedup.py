"""Exact dedup by content-defined chunk recipes (native DataFrame functions only).

A text is cut where its own content says so: after sentences whose hash meets a mask. Equal
passages give equal chunks, but for the first and last of them. Chunks are deduplicated by their bytes, which verifies that one identifier stands for one chunk;
a text is then its ordered list of identifiers, about 8 bytes for each KB, and only these
lists are grouped and joined. A long text moves at most once, in distinct chunks.

Defined results: a null text counts as empty; empty texts are one group; of rows with the
same doc_id and equal texts exactly one is kept; a null doc_id is smaller than any other;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialize
from .near import bounded

#: Pieces end with sentences and lines; a stretch of 1,024 characters without a mark of one is a piece.
PIECE = r"[^.!?\n]{0,1023}[.!?\n]+|[^.!?\n]{1,1024}"
#: A chunk ends after one of so many pieces, as the piece's hash says.
ONE_OF = 8


def normalized(text: str | Column) -> Column:
    return ascii_lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def chunks(text: Column) -> Column:
    """The text in chunks. Whether a chunk ends after a piece depends on the piece alone, so equal passages are cut alike
    wherever they stand, from the first cut in them on."""

    def cut(pieces: Column) -> Column:
        n = F.size(pieces)
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        ends = F.filter(places, lambda i: (F.pmod(F.xxhash64(F.get(pieces, i - 1)), F.lit(ONE_OF)) == 0) | (i == n))

        def join(found: Column) -> Column:
            begin = lambda k: F.coalesce(F.get(found, k - 1), F.lit(0))
            return F.transform(found, lambda end, k: F.array_join(F.slice(pieces, begin(k) + 1, end - begin(k)), ""))

        return let(ends, join)

    return let(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), cut)


def chunk_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_hash, chunk, n_refs): every distinct chunk once, compared by its bytes."""
    each = docs.select(F.explode(chunks(normalized(text))).alias("chunk"))
    return each.groupBy(F.xxhash64("chunk").alias("chunk_hash"), "chunk").agg(F.count("*").alias("n_refs"))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_sha256, recipe): recipe is the ordered list of verified identifiers.

    The identifier is a chunk's 64-bit hash where the store has one chunk of that hash;
    for the others, n * n / 2**65 of n distinct chunks, it carries the chunk's SHA-256 too.
    """
    ambiguous = chunk_store(docs, text).groupBy("chunk_hash").agg(F.count("*").alias("n")).where("n > 1")
    listed = ambiguous.agg(F.collect_set("chunk_hash").alias("hashes")).scalar()
    identify = lambda c: F.struct(F.xxhash64(c).alias("h"), F.when(F.array_contains(F.col("_ambiguous"), F.xxhash64(c)), F.sha2(c, 256)).alias("s"))
    return (
        docs.select(F.col(doc_id).alias("doc_id"), normalized(text).alias("_text"), listed.alias("_ambiguous"))
        .select("doc_id", F.sha2("_text", 256).alias("text_sha256"), F.transform(chunks(F.col("_text")), identify).alias("recipe"))
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Groups are rows with equal recipes; the largest doc_id stays. Pre-aggregation before
    the exchange makes a group of any size a few rows for each task.
    """
    same_row = Window.partitionBy("doc_id", "text_sha256").orderBy("doc_id")
    rows = materialize(recipes(docs, doc_id, text).withColumn("_nth", F.row_number().over(same_row)))
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # materialized, so that the join deals the rows out by itself and a large group is split
    return rows.join(materialize(groups), "recipe").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"), "text_sha256"
    )


def keep_first_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their own columns, whatever their names.

    Only (doc_id, text_sha256) of the rows that go is joined; rows that repeat a kept one
    whole are told apart by their number, so one of them stays.
    """
    gone = materialize(exact_dedup(docs, doc_id, text).where(~F.col("kept")).groupBy(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).agg(F.max(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("repeated")))
    gone = bounded(gone)
    packed = docs.select(F.col(doc_id).alias("id"), F.sha2(normalized(text), 256).alias("sha"), F.struct("*").alias("row"))
    hit = packed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left")
    single = hit.where(F.col("gone_sha").isNull())
    again = hit.where("repeated").withColumn("nth", F.row_number().over(Window.partitionBy("gone_id", "gone_sha").orderBy("sha"))).where("nth = 1")
    return single.select("row.*").unionByName(again.select("row.*"))
