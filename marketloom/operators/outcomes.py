"""What happened after each signal: barrier touches, fixed-horizon outcomes and simulated trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.params import COSTS, HORIZONS


def calendar(bench: DataFrame) -> DataFrame:
    """pos and date of each session, from the benchmark: one row a session."""
    return bench.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))


#: What of a later bar outcomes need.
_AHEAD = ("date", "open", "high", "low", "close")


def with_ahead(bars: DataFrame, sessions: int = 10) -> DataFrame:
    """Adds ahead, the ticker's next `sessions` bars in order (fewer at the end), as an array. After other windows of the ticker it needs no shuffle and no sort."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(1, sessions)
    return bars.withColumn("ahead", F.collect_list(F.struct(*_AHEAD)).over(w))


def following(signals: DataFrame, bars: DataFrame | None, sessions: int) -> DataFrame:
    """Signals with ahead cut to `sessions`: their own column if they have one, else that of their bar by ticker and row number."""
    if "ahead" not in signals.columns:
        later = with_ahead(numbered(bars), sessions).select("ticker", "rn", "ahead")
        signals = signals.join(later.hint("merge"), ["ticker", "rn"])
    return signals.withColumn("ahead", F.slice("ahead", 1, sessions))


def ahead_of(signals: DataFrame) -> list[str]:
    """["ahead"] if the signals have their following bars, else []."""
    return [c for c in signals.columns if c == "ahead"]


def forward_bars(signals: DataFrame, bars: DataFrame | None, sessions: int) -> DataFrame:
    """The next `sessions` bars of each signal's ticker: signal columns, k, b_open, b_high, b_low, b_close, b_date. See with_ahead() for signals without bars."""
    x = following(signals, bars, sessions)
    rows = x.select(*(c for c in x.columns if c != "ahead"), F.posexplode("ahead").alias("_k", "_b"))
    return rows.select(*(c for c in x.columns if c != "ahead"), (F.col("_k") + 1).alias("k"), *(F.col(f"_b.{c}").alias(f"b_{c}") for c in _AHEAD))


def first_touch(signals: DataFrame, bars: DataFrame | None = None, sessions: int = 10, reanchor: bool = False, target_r: float | None = None) -> DataFrame:
    """outcome 1 if the target is touched before the stop within `sessions` bars, else 0; both in one bar is 0, and so is neither.

    With reanchor the entry is the next bar's open and the levels keep their distance from the signal's close. The first touching bar is found within
    the row; signals without a following bar are left out. Returns key, levels, outcome and touch_k; see labelled() for all columns.
    """
    return labelled(signals, bars, sessions, reanchor, target_r).select("ticker", "date", "direction", "entry_actual", "stop_actual", "target_actual", "outcome", "touch_k")


def labelled(signals: DataFrame, bars: DataFrame | None = None, sessions: int = 10, reanchor: bool = False, target_r: float | None = None) -> DataFrame:
    """signals with entry_actual, stop_actual, target_actual, outcome and touch_k of first_touch(), without their following bars."""
    rows = following(signals, bars, sessions).where(F.size("ahead") > 0)
    long = F.col("direction") == "Long"
    entry = F.col("ahead")[0]["open"] if reanchor else F.col("entry")
    target = F.col("target") if target_r is None else F.col("entry") + F.when(long, 1.0).otherwise(-1.0) * target_r * F.col("risk")
    shift = F.col("entry_actual") - F.col("entry")
    rows = rows.withColumn("entry_actual", entry).withColumns({"stop_actual": F.col("stop") + shift, "target_actual": target + shift})

    def touch(b: Column, i: Column) -> Column:
        won = F.when(long, b["high"] >= F.col("target_actual")).otherwise(b["low"] <= F.col("target_actual"))
        lost = F.when(long, b["low"] <= F.col("stop_actual")).otherwise(b["high"] >= F.col("stop_actual"))
        return F.when(won | lost, F.struct((i + 1).alias("k"), (won & ~lost).cast("int").alias("won")))

    rows = rows.withColumn("_touch", F.get(F.array_compact(F.transform("ahead", touch)), F.lit(0)))
    return rows.withColumns({"outcome": F.coalesce("_touch.won", F.lit(0)), "touch_k": F.col("_touch.k")}).drop("_touch", "ahead")


#: Risk units of the outcome grids: the signal's own stop distance, and one ATR.
RISK_MODELS = ("SignalRisk", "ATR1x")


def prefixes(signals: DataFrame, bars: DataFrame | None = None, targets: tuple[float, ...] = (1.0,), sessions: int = 10) -> DataFrame:
    """One row a signal and risk model, from which all horizons and targets are read without another pass over bars.

    Entry is the next bar's open; unit is the risk or one ATR. best and worst are arrays: the most favourable and the most adverse price so far, as
    multiples of the direction's sign, bar by bar. stop_k and target_k (an array, by target) are the first bars that touch the levels one unit
    against and `targets` units with the trade: places in these monotone arrays. Signals without positive risk and ATR are left out; those without a
    following bar or its open have null entry.
    """
    x = following(signals, bars, sessions)
    s = F.when(F.col("direction") == "Long", 1.0).otherwise(-1.0)
    atr = F.col("atr20_pct") * F.col("entry")
    with_trade = F.transform("ahead", lambda b: F.when(s > 0, b["high"]).otherwise(-b["low"]))
    against = F.transform("ahead", lambda b: F.when(s > 0, b["low"]).otherwise(-b["high"]))
    x = x.where((F.col("risk") > 0) & (atr > 0)).withColumns({"start": s * F.get("ahead", F.lit(0))["open"], "_w": with_trade, "_a": against})
    so_far = lambda c, f: F.transform(c, lambda _, i: f(F.slice(c, 1, i + 1)))
    x = x.withColumns({"best": so_far(F.col("_w"), F.array_max), "worst": so_far(F.col("_a"), F.array_min)})
    units = F.array(*(F.struct(F.lit(name).alias("risk_model"), unit.alias("unit")) for name, unit in zip(RISK_MODELS, (F.col("risk"), atr), strict=True)))
    x = x.select("ticker", "date", "direction", "setup", "start", "best", "worst", F.inline(units))
    after = lambda before, c: F.nullif(F.size(before) + 1, F.size(c) + 1)
    stop = after(F.filter("worst", lambda p: p > F.col("start") - F.col("unit")), F.col("worst"))
    target = lambda t: after(F.filter("best", lambda p: p < F.col("start") + t * F.col("unit")), F.col("best"))
    return x.withColumns({"stop_k": stop, "target_k": F.array(*map(target, targets))})


def outcome_grid(signals: DataFrame, bars: DataFrame | None = None, targets: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0), horizons: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """outcome and reason of every risk model, horizon and target: `target_k`, `stop_k`, `same_bar_ambiguous`, `timeout`, or `invalid` without an entry."""
    x = prefixes(signals, bars, targets, max(horizons))
    cells = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(t).alias("target_r"), F.col("target_k")[i].alias("target_k")) for h in horizons for i, t in enumerate(targets)))
    x = x.select("ticker", "date", "direction", "setup", "risk_model", "start", "stop_k", F.inline(cells))
    outcome, reason = _decided(F.col("target_k"), F.col("stop_k"), F.col("horizon"), F.col("start"))
    return x.select("ticker", "date", "direction", "setup", "risk_model", "horizon", "target_r", outcome.alias("outcome"), reason.alias("reason"))


def _decided(target: Column, stop: Column, horizon: Column, start: Column) -> tuple[Column, Column]:
    t, s = (F.when(k <= horizon, k) for k in (target, stop))
    won = t.isNotNull() & (s.isNull() | (t < s))
    reason = F.when(start.isNull(), "invalid").when(t == s, "same_bar_ambiguous").when(won, F.concat(F.lit("target_"), t.cast("string"))).when(s.isNotNull(), F.concat(F.lit("stop_"), s.cast("string"))).otherwise("timeout")
    return F.coalesce(won, F.lit(False)).cast("int"), reason


def excursions(signals: DataFrame, bars: DataFrame | None = None, horizons: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Largest favourable and adverse move (mfe_r, mae_r, in risk units, 0 at least and at most) until the first touch of one unit with or against the
    trade, by risk model and horizon, with outcome and reason as in outcome_grid(). Signals without an entry have null moves."""
    x = prefixes(signals, bars, (1.0,), max(horizons)).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    end = F.least(F.col("stop_k"), F.col("target_k")[0], F.col("horizon"), F.size("best"))
    outcome, reason = _decided(F.col("target_k")[0], F.col("stop_k"), F.col("horizon"), F.col("start"))
    best, worst = (F.get(c, end - 1) for c in ("best", "worst"))
    entered = F.col("start").isNotNull()
    return x.select(
        "ticker", "date", "direction", "setup", "risk_model", "horizon", F.when(entered, F.greatest(F.lit(0.0), (best - F.col("start")) / F.col("unit"))).alias("mfe_r"),
        F.when(entered, F.least(F.lit(0.0), (worst - F.col("start")) / F.col("unit"))).alias("mae_r"), outcome.alias("outcome"), reason.alias("reason"),
    )


def net_pnl(gross: Column, direction: Column, days: Column, cost) -> Column:
    return gross - cost.round_trip_bps / 1e4 - F.when(direction == "Short", cost.borrow_rate * days / 252.0).otherwise(0.0)


def fixed_horizon(signals: DataFrame, bars: DataFrame, bench: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Open-to-close outcome between exact sessions of the market's calendar, with the benchmark over the same dates.

    Missing bars give a status, not a substitute: complete, pending_future_exit, pending_stock_bar (the
    ticker's bars end before the exit), invalid_missing_stock_bar (they went past it), missing_benchmark_bar, not_in_calendar.
    """
    days = calendar(bench)
    pick = lambda k, names: days.join(bench, "date").select(F.col("pos").alias(k), *(F.col(a).alias(b) for a, b in names.items()))
    x = signals.join(F.broadcast(days), "date", "left").withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    x = x.withColumns({"entry_pos": F.col("pos") + 1, "exit_pos": F.col("pos") + F.col("horizon")})
    x = x.join(F.broadcast(pick("entry_pos", {"date": "entry_date", "open": "bench_open"})), "entry_pos", "left").join(F.broadcast(pick("exit_pos", {"date": "exit_date", "close": "bench_close"})), "exit_pos", "left")
    a = bars.select("ticker", F.col("date").alias("entry_date"), F.col("open").alias("entry_price"))
    b = bars.select("ticker", F.col("date").alias("exit_date"), F.col("close").alias("exit_price"))
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_bar"))
    x = x.join(a.hint("merge"), ["ticker", "entry_date"], "left").join(b.hint("merge"), ["ticker", "exit_date"], "left").join(last.hint("merge"), "ticker", "left")
    status = (
        F.when(F.col("pos").isNull(), "not_in_calendar").when(F.col("exit_date").isNull(), "pending_future_exit")
        .when(F.col("entry_price").isNull() | F.col("exit_price").isNull(), F.when(F.col("last_bar").isNull() | (F.col("last_bar") < F.col("exit_date")), "pending_stock_bar").otherwise("invalid_missing_stock_bar"))
        .when(F.col("bench_open").isNull() | F.col("bench_close").isNull(), "missing_benchmark_bar").otherwise("complete")
    )
    sign = F.when(F.col("direction") == "Long", 1.0).otherwise(-1.0)
    done = F.col("status") == "complete"
    x = x.withColumn("status", status).withColumns({"stock_return": F.when(done, F.col("exit_price") / F.col("entry_price") - 1), "bench_return": F.when(done, F.col("bench_close") / F.col("bench_open") - 1)})
    gross = sign * F.col("stock_return")
    x = x.withColumns({"gross": gross, "excess": sign * (F.col("stock_return") - F.col("bench_return")), **{f"net_{c.name.lower()}": net_pnl(gross, F.col("direction"), F.col("horizon"), c) for c in COSTS}})
    return x.select("ticker", "date", "direction", "setup_score", "horizon", "status", "entry_date", "exit_date", "entry_price", "exit_price", "stock_return", "bench_return", "gross", "excess", "net_base", "net_stress", *(c for c in x.columns if c.startswith("qc_")))


def simulated_trades(signals: DataFrame, bars: DataFrame, bench: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Trades on the market's calendar: next-open entry, levels moved with it, stop first when both are touched, gaps filled at the open
    (stops) or capped (targets), exit at the close of the last session. Every bar of a trade must exist, or its status says which is missing."""
    days = calendar(bench).join(bench.select("date", F.col("open").alias("s_open"), F.col("close").alias("s_close")), "date")
    size = F.broadcast(days.agg(F.max("pos").alias("last_pos")))
    keys = ["ticker", "date", "direction", "horizon"]
    x = signals.select("ticker", "date", "direction", "setup", "setup_score", "entry", "stop", "target").join(F.broadcast(days.select("date", "pos")), "date").crossJoin(size)
    x = x.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    ready = F.col("pos") + F.col("horizon") <= F.col("last_pos")  # the others keep one step without a session
    steps = x.withColumn("k", F.explode(F.when(ready, F.sequence(F.lit(1), F.col("horizon"))).otherwise(F.array(F.lit(None).cast("int"))))).withColumn("at", F.col("pos") + F.col("k"))
    steps = steps.join(F.broadcast(days.select(F.col("pos").alias("at"), F.col("date").alias("b_date"), "s_open", "s_close")), "at", "left")
    b = bars.select("ticker", F.col("date").alias("b_date"), *(F.col(c).alias(f"b_{c}") for c in ("open", "high", "low", "close")))
    steps = steps.join(b.hint("merge"), ["ticker", "b_date"], "left")
    w = Window.partitionBy(*keys)
    steps = steps.withColumn("fill", F.first(F.when(F.col("k") == 1, F.col("b_open")), True).over(w))
    s = F.when(F.col("direction") == "Long", 1.0).otherwise(-1.0)
    stop, target = s * (F.col("stop") + F.col("fill") - F.col("entry")), s * (F.col("target") + F.col("fill") - F.col("entry"))
    o, high, low = s * F.col("b_open"), F.when(s > 0, F.col("b_high")).otherwise(-F.col("b_low")), F.when(s > 0, F.col("b_low")).otherwise(-F.col("b_high"))
    last = F.col("k") == F.col("horizon")
    event = (
        F.when(F.col("k").isNull(), None).when(F.col("b_open").isNull(), F.struct(F.lit("missing").alias("reason"), F.lit(None).cast("double").alias("price"))).when(o <= stop, F.struct(F.lit("stop_gap").alias("reason"), F.col("b_open").alias("price")))
        .when(o >= target, F.struct(F.lit("target_gap_capped").alias("reason"), (s * target).alias("price"))).when((low <= stop) & (high >= target), F.struct(F.lit("stop_and_target_same_bar_stop_first").alias("reason"), (s * stop).alias("price")))
        .when(low <= stop, F.struct(F.lit("stop").alias("reason"), (s * stop).alias("price"))).when(high >= target, F.struct(F.lit("target").alias("reason"), (s * target).alias("price"))).when(last, F.struct(F.lit("time_exit").alias("reason"), F.col("b_close").alias("price")))
    )
    first = F.min(F.when(event.isNotNull(), F.struct("k", event.alias("e"), F.col("b_date").alias("exit_date"), "s_close")))
    ended = steps.groupBy(*keys).agg(first.alias("x"), F.first("fill", True).alias("fill"), F.min(F.when(F.col("k") == 1, F.col("s_open"))).alias("s_open"), F.max(F.col("k").isNotNull()).alias("ready"), *(F.first(c).alias(c) for c in ("setup", "setup_score", "entry", "stop")))
    done = ended.withColumn("status", F.when(~F.col("ready"), "pending_exit_beyond_download").when(F.col("fill").isNull() | ((F.col("x.k") == 1) & (F.col("x.e.reason") == "missing")), "invalid_missing_stock_entry_bar").when(F.col("x.e.reason") == "missing", "invalid_missing_stock_bar_before_exit").otherwise("complete"))
    ok = F.col("status") == "complete"
    gross = s * (F.col("x.e.price") / F.col("fill") - 1)
    done = done.select(
        *keys, "setup", "setup_score", "status", F.when(ok, F.col("x.e.reason")).alias("exit_reason"), F.when(ok, F.col("x.exit_date")).alias("exit_date"), F.when(ok, F.col("x.k")).alias("holding"), F.when(ok, F.col("fill")).alias("entry_price"), F.when(ok, F.col("x.e.price")).alias("exit_price"),
        F.when(ok, gross).alias("gross"), F.when(ok, gross - s * (F.col("x.s_close") / F.col("s_open") - 1)).alias("excess"), F.when(ok, gross * F.col("fill") / (s * (F.col("entry") - F.col("stop")))).alias("r_multiple"),
    )
    return done.withColumns({f"net_{c.name.lower()}": net_pnl(F.col("gross"), F.col("direction"), F.col("holding"), c) for c in COSTS})
