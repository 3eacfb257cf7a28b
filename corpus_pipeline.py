"""The corpus pipeline: documents to token digests, one operator a stage.

Every stage works on all rows that the one before kept. A run writes each stage's rows as
Parquet in a new folder in the one that spark.checkpoint.dir names and reads them again; the result
is lazy and reads the last of them, so the caller removes the folder.

Defined results: null texts and texts without a letter go in the first stage; of equal rows one
stays in the second; ties and extra columns are as the stages' operators say, and extra columns are kept up to
the last stage, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import shared_folder
from ledgerloom.llm.exact_dedup import keep_first_copies
from ledgerloom.llm.language_id import keep_known
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.ngram_join import keep_one
from ledgerloom.llm.sentencepiece_codec import digest


#: Rows that go to Python together: texts can be long, and batches of the usual 10,000 take up much of an executor.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no language."""
    _small_batches(spark)
    return keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return keep_first_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest doc_id."""
    _small_batches(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, again for each pass, in training order."""
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    import public_tokenizers

    _small_batches(spark)

    return digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: The language, the sketches and the tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
