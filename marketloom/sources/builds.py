"""Builds by chunk that resume: a chunk counts as done when its marker is published, never because its files exist.

Layout below a folder: data/chunk=.../ has the rows, chunks/<number>.json the markers with the chunk's number of rows. A job that is
broken off leaves chunks without markers; the next run replaces whatever they hold. Readers see marked chunks only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources import files

#: Chunks of a build; bounds the markers and what the driver lists.
MOST_CHUNKS = 10_000


def chunked(rows: DataFrame, by: str, chunks: int) -> DataFrame:
    """Adds chunk, the rows' share of the build by a checksum of the column `by`; nulls are in chunk 0."""
    if not 1 <= chunks <= MOST_CHUNKS:
        raise ValueError(f"a build has 1 to {MOST_CHUNKS} chunks")
    return rows.withColumn("chunk", F.coalesce(F.pmod(F.crc32(F.col(by).cast("string")), F.lit(chunks)), F.lit(0)).cast("int"))


def markers(spark: SparkSession, folder: str) -> dict[int, int]:
    """Rows of each chunk that is done."""
    return {int(n.removesuffix(".json")): files.read_json(spark, f"{folder}/chunks/{n}")["rows"] for n in files.names(spark, f"{folder}/chunks") if n[0] != "."}


def _counts(spark: SparkSession, folder: str, chunks: list[int]) -> dict[int, int]:
    """Rows of the chunks' files, by their footers and folder names only."""
    if not chunks or not files.exists(spark, f"{folder}/data"):
        return {}
    there = [f"{folder}/data/chunk={c}" for c in chunks if files.exists(spark, f"{folder}/data/chunk={c}")]
    if not there:
        return {}
    rows = spark.read.option("basePath", f"{folder}/data").schema("chunk int").parquet(*there)
    return {r.chunk: r["count"] for r in rows.groupBy("chunk").count().collect()}


def damaged(spark: SparkSession, folder: str) -> list[int]:
    """Chunks whose files have not the number of rows that their marker names."""
    done = markers(spark, folder)
    counts = _counts(spark, folder, list(done))
    return sorted(c for c, n in done.items() if counts.get(c, 0) != n)


def build(rows: DataFrame, folder: str, chunks: int, step: int = 1, after: Callable[[list[int]], None] | None = None) -> list[int]:
    """Writes the chunks of rows(chunk, ...) that are not done, `step` chunks a job, and returns them.

    Each job overwrites its own partitions only; then the markers follow, one a chunk, empty chunks included. Rows of a chunk number
    outside 0 ... chunks - 1 raise a ValueError. `after` is called with the chunks of each job (progress, tests).
    """
    spark = rows.sparkSession
    done = markers(spark, folder)
    for c in damaged(spark, folder):
        files.delete(spark, f"{folder}/chunks/{c}.json")
        done.pop(c)
    missing = [c for c in range(chunks) if c not in done]
    for i in range(0, len(missing), step):
        some = missing[i : i + step]
        for c in some:
            files.delete(spark, f"{folder}/data/chunk={c}")  # what a broken job left
        part = rows.where(F.col("chunk").isin(some))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{folder}/data")
        counts = _counts(spark, folder, some)
        for c in some:
            files.publish_json(spark, f"{folder}/chunks/{c}.json", {"chunk": c, "rows": counts.get(c, 0)})
        if after:
            after(some)
    return missing


def built(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all chunks that are done; the scan lists these partitions only. schema: with chunk."""
    done = sorted(c for c, n in markers(spark, folder).items() if n)
    rows = spark.read.schema(schema).parquet(f"{folder}/data") if done else spark.createDataFrame([], schema)
    return rows.where(F.col("chunk").isin(done)) if done else rows
