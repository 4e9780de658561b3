"""Market context: breadth over tickers, sectors' cross-section, volatility percentile, sector proxies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.indicators import by_ticker


def breadth(features: DataFrame) -> DataFrame:
    """By date over all tickers with a bar: shares above their averages and with positive returns, spread of 20-day returns, up to down volume."""
    x = features.withColumn("ret5", F.col("close") / F.lag("close", 5).over(by_ticker()) - 1)
    share = lambda c, known: F.count_if(c) / F.nullif(F.count(known), F.lit(0))
    up = F.sum(F.when(F.col("close") > F.col("prev_close"), F.col("volume")))
    down = F.sum(F.when(F.col("close") < F.col("prev_close"), F.col("volume")))
    return x.groupBy("date").agg(
        F.count("*").alias("active"), *(share(F.col("close") > F.col(f"ema{n}"), f"ema{n}").alias(f"above_ema{n}") for n in (20, 50, 200)), share(F.col("ret5") > 0, "ret5").alias("positive5"), share(F.col("ret20") > 0, "ret20").alias("positive20"),
        F.expr("percentile(ret20, 0.5)").alias("median_ret20"), F.stddev_samp("ret20").alias("std_ret20"), (up / F.nullif(down, F.lit(0.0))).alias("up_down_volume"),
    )


def sector_cross_section(sectors: DataFrame) -> DataFrame:
    """By date: share of sectors with a positive 20-day return (a missing one is not positive), spread, median, extremes."""
    w = Window.partitionBy("symbol").orderBy("date")
    x = sectors.withColumn("ret20", F.col("close") / F.lag("close", 20).over(w) - 1)
    positive = F.when(F.col("ret20") > 0, 1.0).otherwise(0.0)
    return x.groupBy("date").agg(F.avg(positive).alias("positive"), F.stddev_samp("ret20").alias("std_ret20"), F.expr("percentile(ret20, 0.5)").alias("median_ret20"), F.max("ret20").alias("max_ret20"), F.min("ret20").alias("min_ret20"))


def level_percentile(series: DataFrame, value: str, sessions: int = 252, least: int = 60) -> DataFrame:
    """date, level and the share of the last `sessions` levels that are not above it; null below `least` observations. One series."""
    w = Window.orderBy("date")
    past = F.collect_list(value).over(w.rowsBetween(-(sessions - 1), 0))
    x = series.select("date", F.col(value).alias("level"), past.alias("_past"))
    return x.select("date", "level", F.when((F.size("_past") >= least) & F.col("level").isNotNull(), F.size(F.filter("_past", lambda p: p <= F.col("level"))) / F.size("_past")).alias("percentile"))


def sector_proxy(bars: DataFrame, sectors: DataFrame, symbols: list[str], sessions: int = 60, least: int = 40) -> DataFrame:
    """The sector whose daily returns correlate most with each ticker's over its last `sessions` bars: ticker, date, sector, correlation.

    Windows of a ticker's bars are one matrix a series, taken in the task that has the ticker; ties go to the first symbol. A sector without a
    correlation, as one of the two series doesn't move, takes no part; sector and correlation are null if none is left.
    """
    s = Window.partitionBy("symbol").orderBy("date")
    returns = sectors.withColumn("r", F.col("close") / F.lag("close").over(s) - 1).groupBy("date").pivot("symbol", symbols).agg(F.first("r"))
    x = bars.withColumn("r", F.col("close") / F.lag("close").over(by_ticker()) - 1).join(F.broadcast(returns), "date")
    for c in symbols:
        x = x.where(F.col(c).isNotNull())
    x = x.select("ticker", "date", F.col("r").cast("double").alias("r"), *(F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(symbols)))
    kinds = dict(x.dtypes)

    def correlated(t: pa.Table) -> pa.Table:
        t = t.sort_by("date")
        known = t.column("r").is_valid().to_numpy()
        n, best, corr = _best_correlation(t.column("r").to_numpy(), known, [t.column(f"s{i}").to_numpy() for i in range(len(symbols))], sessions)
        keep = n >= least
        t, best, corr = t.filter(pa.array(keep)), best[keep], corr[keep]
        found = pa.array([symbols[i] if i >= 0 else None for i in best], pa.string())
        return pa.table({"ticker": t.column("ticker"), "date": t.column("date"), "sector": found, "correlation": pa.array(corr, pa.float64(), mask=best < 0)})

    return x.groupBy("ticker").applyInArrow(correlated, f"ticker {kinds['ticker']}, date {kinds['date']}, sector string, correlation double")


#: Rows of which the windows are held at once.
WINDOWS = 4096


def _best_correlation(r: np.ndarray, known: np.ndarray, series: list[np.ndarray], sessions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row, over the last `sessions` rows: how many have a known r, the series that correlates most with it there (the first of equal ones; -1 if none has a correlation), and its correlation.

    Means are taken from the row's own value (of r: the last known one), so that a series that doesn't move has a deviation of exactly 0.
    """
    n, best, corr = np.zeros(len(r), np.int64), np.full(len(r), -1), np.full(len(r), np.nan)
    last = np.maximum.accumulate(np.where(known, np.arange(len(r)), -1))
    for start in range(0, len(r), WINDOWS):
        own = np.arange(start, min(start + WINDOWS, len(r)))
        at = own[:, None] - np.arange(sessions - 1, -1, -1)
        used = (at >= 0) & known[np.maximum(at, 0)]
        at = np.where(used, at, 0)
        n[own] = used.sum(1)
        count = np.maximum(n[own], 1)

        def apart(x: np.ndarray, base: np.ndarray, at=at, used=used, count=count) -> np.ndarray:
            moved = np.where(used, x[at] - base[:, None], 0.0)
            return np.where(used, moved - (moved.sum(1) / count)[:, None], 0.0)

        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            mine = apart(r, r[last[own]])
            spread = np.sqrt((mine * mine).sum(1) / count)
            for i, x in enumerate(series):
                other = apart(x, x[own])
                scale = spread * np.sqrt((other * other).sum(1) / count)
                c = np.where(scale != 0, (mine * other).sum(1) / count / scale, np.nan)
                better = ~np.isnan(c) & ((best[own] < 0) | (c > corr[own]))
                best[own[better]], corr[own[better]] = i, c[better]
    return n, best, corr


def benchmark_context(bench: DataFrame, others: DataFrame, second: str, third: str) -> DataFrame:
    """By date, over the union of three series' dates: returns of the benchmark and of two other symbols, and the benchmark's range measures."""
    w = Window.orderBy("date")  # one row a session
    past = lambda n: F.col("close") / F.lag("close", n).over(w) - 1
    before = F.lag("close").over(w)
    x = bench.withColumns({"pc": before, "t": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))})
    last = w.rowsBetween(-19, 0)
    x = x.withColumn("atr20", F.when(F.count("t").over(last) == 20, F.avg("t").over(last)))
    first = x.select("date", past(1).alias("spy_ret1"), past(5).alias("spy_ret5"), past(20).alias("spy_ret20"), (F.col("atr20") / F.col("close")).alias("spy_atr20_pct"), (F.when(F.col("pc").isNotNull(), F.col("t")) / F.nullif(F.col("atr20"), F.lit(0.0))).alias("spy_tr_atr20"))
    q = others.where(F.col("symbol") == second).select("date", past(5).alias("qqq_ret5"), past(20).alias("qqq_ret20"))
    i = others.where(F.col("symbol") == third).select("date", past(20).alias("iwm_ret20"))
    return first.join(q.hint("merge"), "date", "full").join(i.hint("merge"), "date", "full")


def sector_strength(proxies: DataFrame, bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """proxies(ticker, date, sector) with the sector's 20-day return, the ticker's excess over it, and the share of sectors that are not stronger."""
    s = Window.partitionBy("symbol").orderBy("date")
    returns = sectors.select(F.col("symbol").alias("sector"), "date", (F.col("close") / F.lag("close", 20).over(s) - 1).alias("sector_ret20"))
    day = Window.partitionBy("date").orderBy("sector_ret20").rangeBetween(Window.unboundedPreceding, 0)
    known = returns.where("sector_ret20 is not null")
    known = known.withColumn("sector_rank_pct", F.count("*").over(day) / F.count("*").over(Window.partitionBy("date")))
    own = bars.select("ticker", "date", (F.col("close") / F.lag("close", 20).over(by_ticker()) - 1).alias("own20"))
    x = proxies.select("ticker", "date", "sector").join(known.hint("merge"), ["sector", "date"], "left").join(own.hint("merge"), ["ticker", "date"], "left")
    return x.select("ticker", "date", "sector", "sector_ret20", (F.col("own20") - F.col("sector_ret20")).alias("rs_sector_20"), "sector_rank_pct")


def date_indexes(first: DataFrame, second: DataFrame) -> DataFrame:
    """The union of two tables' dates, and whether both have each."""
    a, b = (x.select("date").distinct().withColumn(n, F.lit(True)) for x, n in ((first, "a"), (second, "b")))
    return a.join(b.hint("merge"), "date", "full").select("date", (F.coalesce("a", F.lit(False)) & F.coalesce("b", F.lit(False))).alias("in_both"))
