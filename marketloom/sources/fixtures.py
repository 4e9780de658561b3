"""Market tables derived from the star-schema tables: daily bars, benchmark, market caps, universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.exprs import half_up


def _bars(days: DataFrame, keys: list[str]) -> DataFrame:
    """OHLCV from daily average discount (ad), tax (tx) and volume; one series for each value of keys."""
    w = Window.partitionBy(*keys).orderBy("date")
    close = half_up(100 * F.exp(F.sum(0.4 * (F.col("ad") - 0.05)).over(w)), 4)
    opened = half_up(F.coalesce(F.lag("close").over(w), F.lit(100.0)) * (1 + 0.25 * (F.col("tx") - 0.04)), 4)
    high = half_up(F.greatest("open", "close") * (1 + 0.10 * F.col("tx") + 0.001), 4)
    low = half_up(F.least("open", "close") * (1 - 0.10 * F.col("ad") - 0.001), 4)
    rows = days.withColumn("close", close).withColumn("open", opened).withColumn("high", high).withColumn("low", low)
    return rows.select(*keys, "date", "open", "high", "low", "close", "volume")


def _days(lines: DataFrame, **keys: Column) -> DataFrame:
    exact = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / (100 * F.count("*"))
    rows = lines.select(*(v.alias(k) for k, v in keys.items()), F.col("l_shipdate").cast("date").alias("date"), "l_discount", "l_tax", "l_quantity")
    return rows.groupBy(*keys, "date").agg(exact("l_discount").alias("ad"), exact("l_tax").alias("tx"), F.sum("l_quantity").alias("volume"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_discount", "l_tax", "l_quantity")


#: Bytes of the longest method that HotSpot compiles; Spark's own limit for generated stages lets longer ones be interpreted.
METHOD_BYTES = 8000
_METHOD = "spark.sql.codegen.hugeMethodLimit"


def compiled_methods(spark: SparkSession) -> None:
    """Bounds the session's generated stages by METHOD_BYTES, unless they are bounded by less: the stages of the indicators and signals are longer, and
    then run by operator, in compiled parts. It stays so, since what a query returns is computed after it has returned. Results don't depend on it.
    """
    if int(spark.conf.get(_METHOD)) > METHOD_BYTES:
        spark.conf.set(_METHOD, METHOD_BYTES)


#: Lines that one task of the bars gets. Its windows hold ten times the bars' columns, which Spark's own choice, made by the bars' bytes, does not foresee.
LINES_A_TASK = 250_000


def bars(spark: SparkSession, sf_dir: str, tickers: int | None = None) -> DataFrame:
    """Daily bars by supplier: ticker, date, open, high, low, close, volume. With `tickers`, suppliers fold into that many dense series.

    A task's tickers have LINES_A_TASK lines on average at most, so that what it holds does not grow with the input. A supplier has few lines a date, so they
    are dealt once, by ticker; dense series are summed up by date first.
    """
    compiled_methods(spark)
    rows = lines(spark, sf_dir)
    tasks = max(spark.sparkContext.defaultParallelism, rows.count() // LINES_A_TASK + 1)
    if tickers is None:
        return _bars(_days(rows.withColumn("ticker", F.col("l_suppkey").cast("string")).repartition(tasks, "ticker"), ticker=F.col("ticker")), ["ticker"])
    return _bars(_days(rows, ticker=(F.col("l_suppkey") % tickers).cast("string")).repartition(min(tasks, tickers), "ticker"), ["ticker"])


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with a row on nearly every date: suppliers fold into a tenth as many series (ten at least), so that their number grows with the input."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    return bars(spark, sf_dir, max(10, suppliers // 10))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark: the same formulas by date over all suppliers. One row a trading day, which bounds its size."""
    days = _days(lines(spark, sf_dir), symbol=F.lit("SPY"))
    return _bars(days, ["symbol"]).drop("symbol")


def bench_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector series by the supplier's region: symbol, date, open, high, low, close, volume."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    of = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    rows = lines(spark, sf_dir).join(of, F.col("l_suppkey") == F.col("s_suppkey"))
    return _bars(_days(rows, symbol=F.concat(F.lit("S"), F.col("n_regionkey"))), ["symbol"])


def market_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, fast_cap, std_cap from account balances; balances that are not positive are unknown caps."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_suppkey").cast("string").alias("symbol"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("fast_cap"), (F.col("s_acctbal") + 500).alias("std_cap"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol-directory rows made of parts: symbol, security_name, etf, test_issue, source_order."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.col("p_partkey") % 7
    suffix = F.when(kind == 0, " Common Stock").when(kind == 1, " Ordinary Shares").when(kind == 2, " Warrants").when(kind == 3, " 5% Notes").when(kind == 4, " American Depositary Shares").when(kind == 5, " ETF").otherwise(" Class A Common Stock")
    symbol = F.concat(F.substring("p_brand", 1, 3), F.lit(" "), (F.col("p_partkey") % 400).cast("string"), F.when(F.col("p_partkey") % 11 == 0, ".A").when(F.col("p_partkey") % 13 == 0, "$B").otherwise(""))
    return p.select(
        F.when(F.col("p_partkey") % 50 != 0, symbol).alias("symbol"), F.concat(F.col("p_name"), suffix).alias("security_name"),
        F.when(kind == 5, "Y").when(F.col("p_partkey") % 9 != 0, "N").alias("etf"), F.when(F.col("p_partkey") % 17 == 0, "Y").otherwise("N").alias("test_issue"), F.col("p_partkey").alias("source_order"),
    )


def raw5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a vendor's text rows would come: ticker, ts (UTC), prices and volume as text, some of them no numbers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    price = F.when(F.col("user_id") % 10 == 3, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return e.select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("string").alias("ts"), *(price.alias(c) for c in ("open", "high", "low", "close")), F.lit("1").alias("volume"))


def bars5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars from events: ticker, ts (local), open, high, low, close, volume. Users fold into one series for each 750 customers, two at least."""
    tickers = max(2, spark.read.parquet(f"{sf_dir}/customer.parquet").count() // 750)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    slot = F.floor((F.hour("ts") * 60 + F.minute("ts")) * 390 / 1440 / 5).cast("int")
    days = e.groupBy((F.col("user_id") % tickers).cast("string").alias("ticker"), F.to_date("ts").alias("session"), slot.alias("slot")).agg(
        (F.sum(F.round(F.log(1 + F.col("value")) * 1e6).cast("long")).cast("double") / (1e6 * F.count("*"))).alias("a"), F.count("*").alias("n")
    )
    w = Window.partitionBy("ticker").orderBy("session", "slot")
    x = days.withColumn("close", half_up(100 * F.exp(F.sum(0.004 * (F.col("a") - 3.42)).over(w.rowsBetween(Window.unboundedPreceding, 0))), 4)).withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    high = half_up(F.greatest("open", "close") * (1 + 0.0002 * (F.col("n") % 7)), 4)
    low = half_up(F.least("open", "close") * (1 - 0.0002 * (F.col("n") % 5)), 4)
    at = F.expr("timestampadd(MINUTE, 570 + slot * 5, cast(session as timestamp))")
    return x.select("ticker", at.alias("ts"), "open", high.alias("high"), low.alias("low"), "close", F.col("n").cast("double").alias("volume"))


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars as text with times, a ticker without numbers, one with negative volumes, and one with two rows a day (seq)."""
    b = bars(spark, sf_dir)
    one = b.select(
        "ticker", F.concat(F.col("date").cast("string"), F.lit(" 16:00:00")).alias("date"), F.when(F.col("ticker") == "3", "n/a").otherwise(F.col("close").cast("string")).alias("close"),
        "open", "high", "low", F.when(F.col("ticker") == "5", -F.col("volume")).otherwise(F.col("volume")).alias("volume"), F.lit(1).alias("seq"),
    )
    two = b.where("ticker = '7'").select("ticker", F.col("date").cast("string").alias("date"), (F.col("close") * 1.01).cast("string").alias("close"), "open", "high", "low", "volume", F.lit(2).alias("seq"))
    return one.unionByName(two)


def wide_bars(spark: SparkSession, sf_dir: str, tickers: int = 10) -> DataFrame:
    """date and a column `field|ticker` for each field of each dense series."""
    b = bars(spark, sf_dir, tickers)
    fields = ("open", "high", "low", "close", "volume")
    pick = lambda f, t: F.max(F.when(F.col("ticker") == t, F.col(f))).alias(f"{f}|{t}")
    return b.groupBy("date").agg(*(pick(f, str(t)) for t in range(tickers) for f in fields))
