"""Delimited text: CSV tables with a declared schema, and what in them can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.staging import shared_folder, staged

__all__ = ["read_csv", "read_with_rejects", "shared_folder", "staged"]

_CORRUPT = "_corrupt"


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of CSV files with a header, by the names of the schema; unreadable cells are null, rows without a required column are left out."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path)
    return rows.na.drop(subset=list(required)) if required else rows


def read_with_rejects(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), **options) -> tuple[DataFrame, DataFrame]:
    """Rows of delimited files with a header, and the records that are none: (rows, rejects).

    A record is rejected if a cell can't be read as its column's type, if it has too few or too many cells, or if a required column is
    empty; rejects have record, reason (`malformed`, or `missing` and the columns) and file. Text is never turned into null silently, and
    every record of the files is in one of the two. The header must have the schema's names in its order, else reading raises an error.
    """
    read = spark.read.schema(f"{schema}, {_CORRUPT} string").option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
    # parsed once, with all columns: what is malformed must not depend on the columns that are used later
    rows = staged(read.option("columnPruning", False).options(**options).csv(path).withColumn("_file", F.col("_metadata.file_name")), "parsed")
    names = [c for c in rows.columns if c not in (_CORRUPT, "_file")]
    absent = F.array_compact(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), c) for c in required))) if required else F.array().cast("array<string>")
    reason = F.when(F.col(_CORRUPT).isNotNull(), "malformed").when(F.size(absent) > 0, F.concat(F.lit("missing "), F.array_join(absent, ", ")))
    marked = rows.withColumn("_reason", reason)
    record = F.coalesce(F.col(_CORRUPT), F.to_csv(F.struct(*names), {k: v for k, v in options.items() if k == "sep"}))
    good = marked.where("_reason is null").select(*names)
    return good, marked.where("_reason is not null").select(record.alias("record"), F.col("_reason").alias("reason"), F.col("_file").alias("file"))
