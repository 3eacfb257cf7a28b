"""Incremental extraction: only files that are new or changed are read again.

A store is a folder of two tables, both in versions that are written once and never changed. `records` has what extraction
read, by version; `manifest` has a row for each file that is known: its stat key, the hash of its beginning, the version
that holds its records, and whether the file is gone. An update writes a new version of each; the newest manifest is the
state, so a run that dies half-way leaves the last state as it was.

A file that grows or is replaced while it is read is unstable: it is read once more, and if it still moves it keeps the
facts that an earlier version has of it. A file that is gone is archived, never dropped. Facts are keyed by session and
thread, so a file that was moved stays one file. All of it is joins of the listing with the manifest; contents of files
that did not change are not opened.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.ledger import cut
from ledgerloom.sources import rollout

#: Bytes of a file's beginning whose hash tells a file that grew from one that was rewritten.
PREFIX_BYTES = 65_536
MANIFEST = "path string, day string, modified timestamp, size long, prefix string, session string, thread string, extractor string, version long, archived boolean"


class Update(NamedTuple):
    read: list[str]  # paths whose contents were read
    unstable: list[str]
    archived: int  # files that are known and gone
    version: int


def _newest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest version of a table; none before the first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"{schema}, at long")
    every = spark.read.schema(f"{schema}, at long").parquet(path)
    newest = every.agg(F.max("at")).first()[0]
    return every.where(F.col("at") == F.lit(newest))


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """The known files."""
    return _newest(spark, f"{store}/manifest", MANIFEST).drop("at")


def changed(listing: DataFrame, known: DataFrame, extractor: str) -> DataFrame:
    """The files of listing, (path, day, modified, size), that known has not as they are, or not by this extractor."""
    same = known.where(F.col("extractor") == extractor).select("path", "modified", "size")
    return listing.join(same, ["path", "modified", "size"], "left_anti")


def rewritten(spark: SparkSession, store: str, paths: list[str]) -> DataFrame:
    """(path, rewritten) of files whose stat key is known: whether they begin otherwise than they did. Opens the files."""
    now = spark.read.format("binaryFile").load(paths).select("path", F.sha2(F.substring("content", 1, PREFIX_BYTES), 256).alias("now"))
    return now.join(manifest(spark, store).select("path", "prefix"), "path").select("path", (F.col("now") != F.col("prefix")).alias("rewritten"))


def update(spark: SparkSession, root: str, store: str, extractor: str, parse: Callable[[DataFrame], DataFrame] = rollout.parse, list_files: Callable[[], DataFrame] | None = None) -> Update:
    """Brings the store up to date with the logs below root.

    parse makes records of (path, place, line); its columns must stay the same for an extractor. Paths of changed files come to the
    driver, where Spark lists files anyway; their contents do not.
    """
    listing = list_files or (lambda: rollout.found(spark, root))
    before, known = cut(listing()), cut(manifest(spark, store))
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    want = [r["path"] for r in changed(before, known, extractor).select("path").collect()]
    good, unstable, read = None, want, []
    for attempt in range(2):
        if not unstable:
            break
        if attempt:
            before = cut(listing().join(before.select("path").where(F.col("path").isin(unstable)), "path", "left_semi").unionByName(before.where(~F.col("path").isin(unstable))))
        read += unstable
        table = f"{store}/records/at={version}/part={attempt}"
        parse(rollout.lines_of(spark, unstable)).write.mode("overwrite").parquet(table)
        after = listing()
        still = before.where(F.col("path").isin(unstable)).join(after.select("path", "modified", "size"), ["path", "modified", "size"], "left_anti")
        moved = [r["path"] for r in still.select("path").collect()]
        done = [p for p in unstable if p not in set(moved)]
        if done:
            facts = before.where(F.col("path").isin(done)).join(_facts(spark, table, done), "path")
            rows = facts.withColumns({"extractor": F.lit(extractor), "version": F.lit(version).cast("long"), "archived": F.lit(False)})
            good = rows if good is None else good.unionByName(rows)
        unstable = moved
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    fresh = (good if good is not None else spark.createDataFrame([], MANIFEST)).select(columns)
    # of one session and thread the newest reading; a file that was moved takes its old row's place
    moved_in = fresh.where("session is not null").select("session", "thread").distinct()
    rest = known.join(fresh.select("path"), "path", "left_anti").join(moved_in, ["session", "thread"], "left_anti")
    there = listing().select("path", F.lit(True).alias("there"))
    state = cut(rest.drop("archived").join(there, "path", "left").withColumn("archived", F.col("there").isNull()).select(columns).unionByName(fresh))
    state.coalesce(1 + state.rdd.getNumPartitions() // 32).write.mode("overwrite").parquet(f"{store}/manifest/at={version}")
    return Update(sorted(set(read)), sorted(unstable), state.where("archived").count(), version)


def _facts(spark: SparkSession, table: str, paths: list[str]) -> DataFrame:
    """(path, prefix, session, thread) of files that were just read."""
    begin = spark.read.format("binaryFile").load(paths).select("path", F.sha2(F.substring("content", 1, PREFIX_BYTES), 256).alias("prefix"))
    heads = rollout.headers(spark.read.parquet(table)).select("path", "session", "thread")
    return begin.join(heads, "path", "left").withColumns({"session": F.coalesce("session", "path"), "thread": F.coalesce("thread", "path")})


def records(spark: SparkSession, store: str, archived: bool = True) -> DataFrame:
    """The records of every known file, each from the version that the manifest names; without those of files that are gone,
    if archived is false."""
    files = manifest(spark, store)
    if not archived:
        files = files.where(~F.col("archived"))
    wanted = files.select("path", F.col("version").alias("at"))
    return spark.read.option("basePath", f"{store}/records").parquet(f"{store}/records").drop("part").join(F.broadcast(wanted) if wanted.count() <= 500_000 else wanted, ["path", "at"], "left_semi").drop("at")


def statistics(spark: SparkSession, store: str) -> DataFrame:
    """(extractor, files, archived, bytes, sessions) of what is known."""
    return manifest(spark, store).groupBy("extractor").agg(F.count("*").alias("files"), F.count_if("archived").alias("archived"), F.sum("size").alias("bytes"), F.count_distinct("session").alias("sessions"))
