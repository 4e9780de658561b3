"""Five-minute bars: session VWAP, time-of-day volume, opening range, confirmation, triggers and same-day outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.exprs import finite, ratio

#: Sessions open at this minute of the day and last so many minutes.
OPEN_MINUTE, SESSION_MINUTES = 570, 390
TARGETS = (1.0, 1.5, 2.0)
RULES = ("ORB_VWAP", "PULLBACK_VWAP", "REVERSAL_VWAP")


def read_bars(raw: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """ticker, ts, open, high, low, close, volume of raw text or numbers stamped in UTC: local time, numbers where they parse; incomplete rows are dropped."""
    number = lambda c: finite(F.col(c).try_cast("double"))
    rows = raw.select("ticker", F.from_utc_timestamp(F.col("ts").try_cast("timestamp"), zone).alias("ts"), *(number(c).alias(c) for c in ("open", "high", "low", "close", "volume")))
    return rows.dropna()


def session() -> Window:
    return Window.partitionBy("ticker", "session").orderBy("ts")


def prepare(bars: DataFrame) -> DataFrame:
    """Adds session, minute (of the session), vwap, tr, atr14 and tod_rvol to bars(ticker, ts, open, high, low, close, volume)."""
    x = bars.withColumns({"session": F.to_date("ts"), "minute": F.hour("ts") * 60 + F.minute("ts") - OPEN_MINUTE}).where(f"minute between 0 and {SESSION_MINUTES - 1}")
    running = session().rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("ts"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0 * F.col("volume")
    x = x.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    last14, slot = session().rowsBetween(-13, 0), Window.partitionBy("ticker", "minute").orderBy("session").rowsBetween(-20, -1)
    return x.withColumns({
        "vwap": ratio(F.sum(typical).over(running), F.sum("volume").over(running)), "atr14": F.when(F.count("tr").over(last14) >= 5, F.avg("tr").over(last14)),
        "tod_rvol": ratio(F.col("volume"), F.when(F.count("volume").over(slot) >= 5, F.avg("volume").over(slot))),
    })


def quarter_hours(prepared: DataFrame) -> DataFrame:
    """ticker, session, start and the bar of each 15 minutes; window() makes it usable on a stream as well."""
    first, last = (lambda c: F.min_by(c, "ts")), (lambda c: F.max_by(c, "ts"))
    x = prepared.groupBy("ticker", "session", F.window("ts", "15 minutes").alias("w")).agg(first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"), F.sum("volume").alias("volume"), last("vwap").alias("vwap"))
    return x.select("ticker", "session", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "vwap")


def opening_range(prepared: DataFrame, bars: int = 6) -> DataFrame:
    """or_high, or_low and or_mid of each session's first bars, and how many bars it has."""
    x = prepared.withColumn("at", F.row_number().over(session()))
    early = lambda c: F.when(F.col("at") <= bars, F.col(c))
    x = x.groupBy("ticker", "session").agg(F.max(early("high")).alias("or_high"), F.min(early("low")).alias("or_low"), F.count("*").alias("bars"))
    return x.withColumn("or_mid", (F.col("or_high") + F.col("or_low")) / 2.0)


def next_session(signals: DataFrame, sessions: DataFrame) -> DataFrame:
    """signals(ticker, date, ...) with trade_session: the ticker's first session after the date, by one ordered pass. Signals without one are left out."""
    days = sessions.select("ticker", F.col("session").alias("d"), F.col("session").alias("s")).distinct()
    asked = signals.select("ticker", F.col("date").alias("d"), F.lit(None).cast("date").alias("s")).distinct()
    later = Window.partitionBy("ticker").orderBy(F.desc("d"), F.col("s").isNotNull())
    found = days.unionByName(asked).withColumn("trade_session", F.last("s", True).over(later.rowsBetween(Window.unboundedPreceding, 0))).where("s is null and trade_session is not null")
    return signals.join(found.select("ticker", F.col("d").alias("date"), "trade_session").hint("merge"), ["ticker", "date"])


def confirmed(signals: DataFrame, quarters: DataFrame, bar: int = 2) -> DataFrame:
    """signals(ticker, trade_session, direction, ...) whose session's given 15-minute bar closes beyond its VWAP and its open: adds confirm_ts."""
    q = quarters.withColumn("at", F.row_number().over(Window.partitionBy("ticker", "session").orderBy("start"))).where(F.col("at") == bar)
    x = signals.join(q.select("ticker", F.col("session").alias("trade_session"), F.col("start").alias("confirm_ts"), "open", "close", "vwap").hint("merge"), ["ticker", "trade_session"])
    long = F.col("direction") == "Long"
    ok = F.when(long, (F.col("close") > F.col("vwap")) & (F.col("close") > F.col("open"))).otherwise((F.col("close") < F.col("vwap")) & (F.col("close") < F.col("open")))
    return x.where(ok).drop("open", "close", "vwap")


def triggers(confirmed: DataFrame, prepared: DataFrame, last_minute: int = 180, least_rvol: float = 1.2, least_bars: int = 12) -> DataFrame:
    """First bar after the confirmation on which each rule's condition holds: ticker, date, direction, rule, trade_session, trigger_ts, entry, atr, swing_low, swing_high.

    Shorts are longs of the mirrored price. Highs of the last three bars count bars after the confirmation only; the false break is looked for in the whole session.
    """
    day = prepared.withColumns({
        "low6": F.min("low").over(session().rowsBetween(-6, -1)), "high6": F.max("high").over(session().rowsBetween(-6, -1)), "seen": F.count("*").over(session().rowsBetween(-6, -1)), "close1": F.lag("close").over(session()),
        "swing_low": F.min("low").over(session().rowsBetween(-3, -1)), "swing_high": F.max("high").over(session().rowsBetween(-3, -1)),
    })
    opening = opening_range(prepared).where((F.col("bars") >= least_bars) & (F.col("or_high") > F.col("or_low")))
    x = confirmed.join(opening.withColumnRenamed("session", "trade_session").hint("merge"), ["ticker", "trade_session"])
    x = x.join(day.withColumnRenamed("session", "trade_session").hint("merge"), ["ticker", "trade_session"]).where("ts > confirm_ts")
    w = Window.partitionBy("ticker", "date", "direction").orderBy("ts").rowsBetween(-3, -1)
    full = F.count("*").over(w) == 3
    x = x.withColumns({"high3": F.when(full, F.max("high").over(w)), "low3": F.when(full, F.min("low").over(w))})
    x = x.where((F.col("minute") <= last_minute) & (F.col("tod_rvol") >= least_rvol))
    long = F.col("direction") == "Long"
    beyond = lambda a, b: F.when(long, F.col("close") > F.col(a)).otherwise(F.col("close") < F.col(b))
    false_break = (F.col("seen") == 6) & F.when(long, (F.col("low6") < F.col("or_low")) & (F.col("close1") > F.col("or_mid"))).otherwise((F.col("high6") > F.col("or_high")) & (F.col("close1") < F.col("or_mid")))
    conditions = (beyond("or_high", "or_low"), beyond("high3", "low3"), false_break & beyond("or_mid", "or_mid"))
    x = x.where(beyond("vwap", "vwap")).withColumn("rule", F.explode(F.array_compact(F.array(*(F.when(c, r) for r, c in zip(RULES, conditions, strict=True))))))
    first = x.groupBy("ticker", "date", "direction", "rule", "trade_session").agg(F.min(F.struct("ts", "close", "atr14", "swing_low", "swing_high")).alias("b"))
    return first.select("ticker", "date", "direction", "rule", "trade_session", F.col("b.ts").alias("trigger_ts"), F.col("b.close").alias("entry"), F.col("b.atr14").alias("atr"), "b.swing_low", "b.swing_high")


def with_stops(triggers: DataFrame, buffer: float = 0.10, most_atr: float = 2.0) -> DataFrame:
    """Adds stop and risk: the swing of the last three bars and a share of the ATR beyond it; trades with too small or too large a risk are left out."""
    s = F.when(F.col("direction") == "Long", 1.0).otherwise(-1.0)
    swing = F.when(s > 0, F.col("swing_low")).otherwise(F.col("swing_high"))
    x = triggers.where("atr > 0").withColumn("stop", swing - s * buffer * F.col("atr"))
    return x.withColumn("risk", s * (F.col("entry") - F.col("stop"))).where((F.col("risk") > 0) & (F.col("risk") <= most_atr * F.col("atr")))


def same_day(trades: DataFrame, prepared: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """outcome and reason of each trade and target within its session, from the trigger bar on; a time-out is a failure, both levels in one bar too."""
    bars = prepared.select("ticker", F.col("session").alias("trade_session"), "ts", "high", "low")
    x = trades.withColumn("target_r", F.explode(F.array(*map(F.lit, targets)))).join(bars.hint("merge"), ["ticker", "trade_session"]).where("ts >= trigger_ts")
    s = F.when(F.col("direction") == "Long", 1.0).otherwise(-1.0)
    best, worst = F.when(s > 0, F.col("high")).otherwise(-F.col("low")), F.when(s > 0, F.col("low")).otherwise(-F.col("high"))
    won, lost = best >= s * F.col("entry") + F.col("target_r") * F.col("risk"), worst <= s * F.col("entry") - F.col("risk")
    event = F.when(won & lost, "same_bar_ambiguous").when(won, "target").when(lost, "stop")
    found = x.groupBy("ticker", "date", "direction", "rule", "target_r").agg(F.min(F.when(event.isNotNull(), F.struct("ts", event.alias("reason")))).alias("e"))
    reason = F.coalesce("e.reason", F.lit("eod_timeout"))
    return found.select("ticker", "date", "direction", "rule", "target_r", (reason == "target").cast("int").alias("outcome"), reason.alias("reason"))
