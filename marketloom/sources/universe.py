"""Symbol directory: reading, filters and market-cap gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.exprs import finite
from marketloom.sources.delimited import read_with_rejects

# Words of names that are no common equity, and of those that are.
EXCLUDED = r"\b(PREFERRED|WARRANTS?|RIGHTS?|UNITS?|NOTES?|BONDS?|DEBENTURES?|ETF|EXCHANGE TRADED FUND|FUND)\b"
COMMON = r"(COMMON STOCK|COMMON SHARES|ORDINARY SHARES|AMERICAN DEPOSITARY SHARES)"
DIRECTORY_COLUMNS = ("Symbol", "Security Name", "ETF", "Test Issue", "Listing Exchange")


def read_directory(spark: SparkSession, path: str, columns: tuple[str, ...] = DIRECTORY_COLUMNS) -> DataFrame:
    """A pipe-separated symbol directory, all strings, without its trailer; every required column must be there."""
    head = spark.read.option("sep", "|").option("header", True).csv(path).columns
    df = spark.read.option("sep", "|").option("header", True).schema(", ".join(f"`{c}` string" for c in head)).csv(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"symbol directory lacks {', '.join(missing)}")
    return df.where(~F.coalesce(F.col(df.columns[0]), F.lit("")).startswith("File Creation"))


def read_directory_with_rejects(spark: SparkSession, path: str, columns: tuple[str, ...] = DIRECTORY_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """The directory's rows, and its records with too few or too many cells or without a symbol; the trailer is neither. See read_with_rejects()."""
    rows, rejects = read_with_rejects(spark, path, ", ".join(f"`{c}` string" for c in columns), (columns[0],), sep="|")
    trailer = lambda c: F.coalesce(F.col(c), F.lit("")).startswith("File Creation")
    return rows.where(~trailer(f"`{columns[0]}`")), rejects.where(~trailer("record"))


def common_equity(name: str):
    text = F.upper(F.trim(F.coalesce(F.col(name), F.lit(""))))
    return ~text.rlike(EXCLUDED) & text.rlike(COMMON)


def listed(universe: DataFrame) -> DataFrame:
    """Symbols that are no test issues, ETFs or special classes; a dash for the class dot; the first row of each symbol."""
    universe = universe.withColumn("symbol", F.trim("symbol"))
    ok = F.col("symbol").isNotNull() & (F.coalesce("test_issue", F.lit("N")) != "Y") & (F.coalesce("etf", F.lit("N")) != "Y") & ~F.col("symbol").contains("$") & ~F.col("symbol").contains("^")
    x = universe.where(ok).withColumn("yahoo_symbol", F.translate(F.trim("symbol"), ".", "-"))
    return x.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy("source_order"))).where("_n = 1").drop("_n")


def market_cap(caps: DataFrame) -> DataFrame:
    """symbol, cap: the first positive finite one of the fast and the standard field, else unknown."""
    positive = lambda c: F.when(finite(F.col(c)) > 0, F.col(c))
    return caps.select("symbol", F.coalesce(positive("fast_cap"), positive("std_cap")).alias("cap"))


def cap_status(rows: DataFrame, caps: DataFrame, least: float, key: str = "ticker") -> DataFrame:
    """Adds cap and cap_status: qualified, below or unavailable; unknown caps fail."""
    x = rows.join(market_cap(caps).withColumnRenamed("symbol", key).hint("shuffle_hash"), key, "left")
    return x.withColumn("cap_status", F.when(F.col("cap").isNull(), "unavailable").when(F.col("cap") >= least, "qualified").otherwise("below"))
