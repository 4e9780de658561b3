"""Sinks: Parquet partitioned by month or columns, small CSV tables, one-row JSON records. Builds that resume are in builds, versions in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv_table(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for small aggregates only."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_status(df: DataFrame, path: str) -> None:
    """A status record: df must be an aggregate of one row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_by_month(df: DataFrame, path: str, date: str = "date", mode: str = "errorifexists") -> None:
    """Parquet partitioned by the month of `date`; rows without a date are in a partition of their own.

    Rows are brought together by month before the write, so that a month is few files; months that hold many rows are split by size.
    """
    month = F.date_format(date, "yyyy-MM")
    df.withColumn("month", month).hint("rebalance", "month").write.mode(mode).partitionBy("month").parquet(path)


def read_by_month(spark: SparkSession, path: str, schema, first: str | None = None, last: str | None = None, date: str = "date") -> DataFrame:
    """Rows of write_by_month() from date `first` to `last`, both included (None: no limit, and then rows without a date too), by a declared schema.

    Only the months between are listed and read, and only the columns used.
    """
    rows = spark.read.schema(f"{schema}, month string").parquet(path)
    for limit, op in ((first, "ge"), (last, "le")):
        if limit is not None:
            bound = getattr(F.col("month"), f"__{op}__")(limit[:7])
            rows = rows.where(bound & getattr(F.col(date), f"__{op}__")(F.lit(limit).cast("date")))
    return rows.drop("month")
