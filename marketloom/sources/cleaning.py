"""Steps that bring landed tables into shape: bars, symbol lists, signals and booleans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.exprs import finite

PRICES = ("open", "high", "low", "close")


def clean_bars(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Usable daily bars of raw(ticker, date, open, high, low, close, volume): dates without a time, numbers where they parse.

    Of several rows for one day the last by `order` (by stamp without it) stays, whatever it holds. Rows with a missing number, a
    price that is not positive or a negative volume are left out.
    """
    stamp = F.col("date").try_cast("timestamp")
    keys = [F.desc(order)] if order else []
    x = raw.select("ticker", F.to_date(stamp).alias("date"), stamp.alias("_stamp"), *([order] if order else []), *(finite(F.col(c).try_cast("double")).alias(c) for c in (*PRICES, "volume"))).where("ticker is not null and date is not null")
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("ticker", "date").orderBy(*keys, F.desc("_stamp"), *PRICES))).where("_k = 1")
    return x.where(" and ".join(f"{c} > 0" for c in PRICES) + " and volume >= 0").select("ticker", "date", *PRICES, "volume")


def long_bars(wide: DataFrame, separator: str = "|") -> DataFrame:
    """ticker, date, open, high, low, close, volume of a table with a column `field|ticker` for each: one pass, rows without any value are dropped."""
    tickers = sorted({c.split(separator, 1)[1] for c in wide.columns if separator in c})
    fields = (*PRICES, "volume")
    value = lambda f, t: (F.col(f"`{f}{separator}{t}`").cast("double") if f"{f}{separator}{t}" in wide.columns else F.lit(None).cast("double")).alias(f)
    each = F.array(*(F.struct(F.lit(t).alias("ticker"), *(value(f, t) for f in fields)) for t in tickers))
    return wide.select("date", F.explode(each).alias("b")).select("b.ticker", "date", *(f"b.{f}" for f in fields)).dropna("all", subset=list(fields))


def keep_existing(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The named columns that are there, in the given order."""
    return df.select([c for c in names if c in df.columns])


def prepared_signals(signals: DataFrame) -> DataFrame:
    """Signals with close_signal, atr20 and risk_per_share, as studies of trade mechanics need them; those without risk are left out."""
    x = signals.withColumns({"close_signal": F.col("entry"), "atr20": F.col("atr20_pct") * F.col("entry"), "risk_per_share": F.abs(F.col("entry") - F.col("stop"))})
    return x.where("risk_per_share > 0")


def published(signals: DataFrame) -> DataFrame:
    """Signals for readers: entry under the name SignalClose, constant status, no internal columns."""
    return signals.drop("rn", "risk", "stop_k").withColumnRenamed("entry", "SignalClose").withColumn("ResearchStatus", F.lit("Research only"))


def repaired_booleans(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Booleans that went through text: true, 1 and yes are true, all else and missing values and columns are false."""
    for c in names:
        value = F.lower(F.trim(F.col(c).cast("string"))).isin("true", "1", "yes") if c in df.columns else F.lit(False)
        df = df.withColumn(c, F.coalesce(value, F.lit(False)))
    return df


def mapped_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """rows with yahoo_symbol of symbols(ticker, yahoo_symbol), or the ticker where the map has none."""
    return rows.join(symbols.hint("shuffle_hash"), "ticker", "left").withColumn("yahoo_symbol", F.coalesce("yahoo_symbol", "ticker"))
