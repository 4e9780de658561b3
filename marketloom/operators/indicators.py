"""Daily indicators. All windows of a ticker share one exchange and one sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.exprs import ratio
from marketloom.params import EMA_SPANS, RANGE_LENGTHS


def by_ticker() -> Window:
    """Rows of a ticker in order of date."""
    return Window.partitionBy("ticker").orderBy("date")


def full(x: Column, n: int, agg=F.avg, last: int = 0) -> Column:
    """agg of x over the n rows that end `last` rows before this one; null unless all n are there."""
    frame = by_ticker().rowsBetween(-(n - 1) - last, -last)
    # an average counts its rows once more
    value = F.sum(x).over(frame) / n if agg is F.avg else agg(x).over(frame)
    return F.when(F.count(x).over(frame) == n, value)


#: Rows after which the weights of a running average start anew, so that they stay within doubles.
EMA_BLOCK = 1000


#: Lengths whose extremes are read from all their rows.
RANGE_UNITS = (4, 10)


def extremes(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """rows with hh_n and ll_n, the highest high and the lowest low of the n rows before today's; null unless all n are there.

    A long range is covered by shorter ones, ended some rows earlier, so that a row is not visited by the frames of all lengths. The shorter ones end
    with today's row, as the averages' frames do.
    """
    extreme = {"hh": ("high", F.max, F.greatest), "ll": ("low", F.min, F.least)}
    rows = rows.withColumns({f"_{k}_{n}": full(F.col(c), n, agg) for k, (c, agg, _) in extreme.items() for n in RANGE_UNITS})

    def covered(k: str, n: int, pick) -> Column:
        unit = max((u for u in RANGE_UNITS if u <= n), default=None)
        if unit is None:
            c, agg, _ = extreme[k]
            return full(F.col(c), n, agg, 1)
        parts = [F.lag(f"_{k}_{unit}", 1 + back).over(by_ticker()) for back in sorted({*range(0, n - unit, unit), n - unit})]
        if len(parts) == 1:
            return parts[0]
        whole = parts[0].isNotNull()
        for x in parts[1:]:
            whole = whole & x.isNotNull()
        return F.when(whole, pick(*parts))

    return rows.withColumns({f"{k}_{n}": covered(k, n, pick) for n in lengths for k, (*_, pick) in extreme.items()}).drop(*(f"_{k}_{n}" for k in extreme for n in RANGE_UNITS))


def with_emas(rows: DataFrame, value: str, names: dict[str, int]) -> DataFrame:
    """rows(ticker, date, rn, ...) with exponential averages of `value` by name and span, started at the first value; null before row `span`.

    The recursion y = a x + (1 - a) y' in closed form: a running sum of weighted values in blocks of EMA_BLOCK rows, and what the
    ends of earlier blocks (a thousandth of the rows) still weigh. It holds for series of any length, in the ticker's one exchange.
    """
    block = (F.col("rn") - 1) / EMA_BLOCK
    at = (F.col("rn") - 1 - F.col("_block") * EMA_BLOCK).cast("double")
    rows = rows.withColumn("_block", F.floor(block))
    inside = Window.partitionBy("ticker", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rate = {c: -math.log(1 - 2.0 / (n + 1)) for c, n in names.items()}
    x = F.col(value)
    sums = {f"_{c}": F.sum(F.when(F.col("rn") == 1, x).otherwise(2.0 / (n + 1) * x) * F.exp(rate[c] * at)).over(inside) for c, n in names.items()}
    rows = rows.withColumns(sums)
    ends = F.collect_list(F.when(F.col("rn") % EMA_BLOCK == 0, F.struct("rn", *sums))).over(by_ticker().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_ends", ends)
    earlier = lambda c: F.aggregate("_ends", F.lit(0.0), lambda acc, e: acc + e[f"_{c}"] * F.exp(-rate[c] * (F.col("rn") - 1 - e["rn"] + EMA_BLOCK)))
    found = {c: F.when(F.col("rn") >= n, F.exp(-rate[c] * at) * F.col(f"_{c}") + earlier(c)) for c, n in names.items()}
    return rows.withColumns(found).drop("_block", "_ends", *sums)


def bench_context(bench: DataFrame, n: int = 20) -> DataFrame:
    """date, regime (trend by the benchmark's averages, and a mark for high volatility) and bench_ret, its return over n sessions, in one pass."""
    b = bench.withColumn("ticker", F.lit("SPY")).withColumn("rn", F.row_number().over(by_ticker()))
    b = with_emas(b, "close", {f"e{n}": n for n in EMA_SPANS}).withColumn("vol", full(F.col("high") - F.col("low"), 20) / F.col("close"))
    up = (F.col("close") > F.col("e20")) & (F.col("e20") > F.col("e50")) & (F.col("e50") > F.col("e200"))
    down = (F.col("close") < F.col("e20")) & (F.col("e20") < F.col("e50")) & (F.col("e50") < F.col("e200"))
    text = F.when(up, "Bullish").when(down, "Bearish").otherwise("Neutral")
    back = F.col("close") / F.lag("close", n).over(by_ticker()) - 1
    return b.select("date", F.concat(text, F.when(F.col("vol") > 0.025, " / High Vol").otherwise("")).alias("regime"), back.alias("bench_ret"))


def regime(bench: DataFrame) -> DataFrame:
    """date and market regime of the benchmark."""
    return bench_context(bench).select("date", "regime")


def features(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """All daily indicators of bars(ticker, date, open, high, low, close, volume) against bench.

    The benchmark has one row a session, so it is broadcast. Windows are full or null; ranges exclude today's bar.
    """
    rows = bars.join(F.broadcast(bench_context(bench)), "date", "left")
    c, h, lo, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    rows = rows.withColumns({"rn": F.row_number().over(by_ticker()), "prev_close": F.lag("close").over(by_ticker())})
    rows = with_emas(rows, "close", {f"ema{n}": n for n in EMA_SPANS}).withColumn("true_range", F.greatest(h - lo, F.abs(h - F.col("prev_close")), F.abs(lo - F.col("prev_close"))))
    tr = F.col("true_range")
    rows = rows.withColumns({
        "tr": F.when(F.col("prev_close").isNotNull(), tr),
        **{f"atr{n}": full(tr, n) for n in (10, 20, 40)},
        "rvol20": ratio(v, full(v, 20)), "vol_accel": ratio(v, F.lag("volume").over(by_ticker())), "dv20": full(c * v, 20),
        "ret20": c / F.lag("close", 20).over(by_ticker()) - 1, "gap_pct": F.col("open") / F.col("prev_close") - 1,
        "bench_filled": F.last("bench_ret", True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)),
        "regime_filled": F.coalesce(F.last("regime", True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)), F.lit("Neutral")),
    })
    rows = extremes(rows, RANGE_LENGTHS)
    atr = F.nullif(F.col("atr20"), F.lit(0.0))
    return rows.withColumns({
        "tr_atr20": F.col("tr") / atr, "close_loc": ratio(c - lo, h - lo), "atr_comp": 1 - ratio(F.col("atr10"), F.col("atr40")), "atr20_pct": F.col("atr20") / c,
        "trend20": (c - F.col("ema20")) / atr, "trend50": (F.col("ema20") - F.col("ema50")) / atr, "trend200": (F.col("ema50") - F.col("ema200")) / atr,
        "rs_spy_20": F.col("ret20") - F.col("bench_filled"),
        **{f"rng_{n}": (F.col(f"hh_{n}") - F.col(f"ll_{n}")) / F.col("prev_close") for n in RANGE_LENGTHS},
    }).drop("bench_ret", "regime", "true_range", "bench_filled").withColumnRenamed("regime_filled", "regime")


#: Sessions of returns and of forward returns, in excess of the benchmark's.
BACKS, AHEADS = (1, 3, 5, 10, 20, 60), (1, 3, 5, 10)


def bench_moves(bench: DataFrame) -> DataFrame:
    """By date the benchmark's returns b_n and forward returns bf_n."""
    b = bench.withColumn("ticker", F.lit("SPY"))
    return b.select("date", *((F.col("close") / F.lag("close", n).over(by_ticker()) - 1).alias(f"b_{n}") for n in BACKS), *((F.lead("close", n).over(by_ticker()) / F.lead("open", 1).over(by_ticker()) - 1).alias(f"bf_{n}") for n in AHEADS))


def panel(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Research columns beside features(): returns and excess over horizons, averages' slopes, volatility, distances, forward labels."""
    x = features(bars, bench).join(F.broadcast(bench_moves(bench)), "date", "left")
    c, o = F.col("close"), F.col("open")
    x = x.withColumn("ret_1", c / F.lag("close", 1).over(by_ticker()) - 1)
    x = x.withColumns({
        **{f"ret_{n}": c / F.lag("close", n).over(by_ticker()) - 1 for n in (3, 5, 10, 20, 60, 120, 252)},
        **{f"ema_dist_{n}": c / F.col(f"ema{n}") - 1 for n in EMA_SPANS},
        "ema_slope20_5": F.col("ema20") / F.lag("ema20", 5).over(by_ticker()) - 1, "ema_slope50_10": F.col("ema50") / F.lag("ema50", 10).over(by_ticker()) - 1,
        "vol10": full(F.col("ret_1"), 10, F.stddev_samp), "vol20": full(F.col("ret_1"), 20, F.stddev_samp),
        "volume_trend5_20": ratio(full(F.col("volume"), 5), full(F.col("volume"), 20)), "dv20_log": F.log1p(F.greatest(F.col("dv20"), F.lit(0.0))),
        "hh_60": full(F.col("high"), 60, F.max, 1), "ll_60": full(F.col("low"), 60, F.min, 1), "high252": full(c, 252, F.max),
        "intraday_ret": ratio(c, o) - 1, "tr_pct": F.col("tr") / c, "atr10_pct": F.col("atr10") / c,
        **{f"fwd_ret_{n}": F.lead("close", n).over(by_ticker()) / F.lead("open", 1).over(by_ticker()) - 1 for n in AHEADS},
        **{f"fwd_exit_{n}": F.lead("date", n).over(by_ticker()) for n in AHEADS},
    })
    x = x.withColumns({
        **{f"excess_{n}": F.col(f"ret_{n}") - F.col(f"b_{n}") for n in BACKS},
        **{f"fwd_excess_{n}": F.col(f"fwd_ret_{n}") - F.col(f"bf_{n}") for n in AHEADS},
        "dist_high20": c / F.col("hh_20") - 1, "dist_high60": c / F.col("hh_60") - 1, "dist_low20": c / F.col("ll_20") - 1, "dist_low60": c / F.col("ll_60") - 1, "dist_high252": c / F.col("high252") - 1,
        "close_loc20": ratio(c - F.col("ll_20"), F.col("hh_20") - F.col("ll_20")), "close_loc60": ratio(c - F.col("ll_60"), F.col("hh_60") - F.col("ll_60")),
    })
    scale = F.nullif(F.col("atr20_pct") * math.sqrt(5.0), F.lit(0.0))
    return x.withColumns({
        "target_risk_adj5": F.when((F.col("fwd_excess_5") / scale).isNotNull(), F.greatest(F.least(F.col("fwd_excess_5") / scale, F.lit(3.0)), F.lit(-3.0))),
        "risk_adj_mom20": F.col("excess_20") / F.nullif(F.col("vol20") * math.sqrt(20.0), F.lit(0.0)), "risk_adj_mom60": F.col("excess_60") / F.nullif(F.col("vol20") * math.sqrt(60.0), F.lit(0.0)), "raw_mom20": F.col("excess_20"),
    })


def average_rank(value: str, *by: str) -> Column:
    """Average rank as a share of the rows of each group: ties share the mean of their ranks. Null for null."""
    w = Window.partitionBy(*by)
    rank = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), (rank + (ties - 1) / 2.0) / F.count(value).over(w))


def quintile_labels(rows: DataFrame, value: str = "fwd_excess_5") -> DataFrame:
    """top_quintile and bottom_quintile by date from the average rank of value."""
    x = rows.withColumn("pct_rank", average_rank(value, "date"))
    return x.withColumns({"top_quintile": F.when(F.col("pct_rank").isNotNull(), (F.col("pct_rank") >= 0.8).cast("int")), "bottom_quintile": F.when(F.col("pct_rank").isNotNull(), (F.col("pct_rank") <= 0.2).cast("int"))})


def quintile_bounds(rows: DataFrame, value: str = "fwd_excess_5") -> DataFrame:
    """One row a date: low, the highest value of the bottom quintile, and high, the lowest of the top one; null where a quintile has no row."""
    of = lambda agg, label: agg(F.when(F.col(label) == 1, F.col(value)))
    return quintile_labels(rows.select("date", value), value).groupBy("date").agg(of(F.max, "bottom_quintile").alias("low"), of(F.min, "top_quintile").alias("high"))


def bounded_labels(rows: DataFrame, bounds: DataFrame, value: str = "fwd_excess_5") -> DataFrame:
    """The labels of quintile_labels() from quintile_bounds(), without dealing rows by date; the bounds, one row a session, are broadcast. Rows without a date have no place."""
    v = F.col(value)
    x = rows.join(F.broadcast(bounds.select("date", F.col("low").alias("_low"), F.col("high").alias("_high"))), "date")
    known = lambda c: F.when(v.isNotNull(), F.coalesce(c, F.lit(False)).cast("int"))
    return x.withColumns({"top_quintile": known(v >= F.col("_high")), "bottom_quintile": known(v <= F.col("_low"))}).drop("_low", "_high")
