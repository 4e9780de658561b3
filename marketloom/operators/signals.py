"""Setup classification and scoring of every bar, and quality flags of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.exprs import clamp, half_up, holds, ratio
from marketloom.params import SETUP, SetupParams

# Names of setups, long and short, and texts of quality flags.
REVERSAL = ("Failed Breakdown Reversal", "Failed Breakout Reversal")
CONTRACTION = ("VCP / Volatility Contraction Breakout", "VCP / Volatility Contraction Breakdown")
EXPANSION = ("Range Expansion", "Range Expansion Down")
TREND = ("Trend Continuation", "Trend Breakdown")
CONSOLIDATION = ("Consolidation Breakout", "Consolidation Breakdown")
NO_FLAGS = "No automatic QC flags"
STATUS_VOLUME = "CHECK — unusual volume; verify raw data"
STATUS_RISK = "CHECK — extension / volatility / stop distance"
STATUS_COUNTER = "COUNTERTREND — verify market context"
STATUS_STANDARD = "STANDARD REVIEW — still research only"


def volume_score(rvol: Column) -> Column:
    """Piecewise linear through (1, 25), (1.5, 55), (2, 75), (2.5, 90), (3, 100), flat outside."""
    points = ((1.0, 25.0), (1.5, 55.0), (2.0, 75.0), (2.5, 90.0), (3.0, 100.0))
    out = F.when(rvol <= points[0][0], points[0][1])
    for (x, y), (p, q) in zip(points, points[1:], strict=False):
        out = out.when(rvol <= p, y + (rvol - x) * ((q - y) / (p - x)))
    return out.otherwise(points[-1][1])


def _side(long: bool, p: SetupParams) -> dict[str, Column]:
    """What one direction's candidates of a bar share whatever the base length. Shorts are longs of the mirrored price."""
    s, side = (1.0, 0) if long else (-1.0, 1)
    c = s * F.col("close")
    atr, loc, tr, e20 = F.col("atr20"), F.col("close_loc"), F.col("tr_atr20"), s * F.col("ema20")
    comp = ratio(F.col("atr10"), F.col("atr40"))
    near = loc >= p.location_long_min if long else loc <= p.location_short_max
    turned = loc >= 0.55 if long else loc <= 0.45
    strong = holds(c > e20) & holds(e20 > s * F.col("ema50")) & holds(s * F.col("ema50") > s * F.col("ema200"))
    trend = (holds(c > e20).cast("int") + holds(e20 > s * F.col("ema50")).cast("int") + holds(s * F.col("ema50") > s * F.col("ema200")).cast("int")) * 100 / 3.0
    continuation, wide = (c - e20) / atr, holds(tr >= p.range_expansion_min)
    continued = strong & holds((tr >= 1.0) & (continuation >= p.reversal_atr_min))
    expanded = holds((tr >= p.range_expansion_min) & near)
    w = p.weights
    return {
        "c": c, "low": F.col("low") if long else -F.col("high"), "near": near, "turned": turned, "strong": strong, "calm": comp <= p.atr_ratio_max, "tight": comp <= p.tight_atr_ratio,
        "family": F.when(wide, EXPANSION[side]).when(strong, TREND[side]), "anyway": F.when(continued, TREND[side]).when(expanded, EXPANSION[side]), "moved": F.when(continued, continuation).when(expanded, tr),
        "buffer": p.buffer_atr * atr, "floor": c - p.stop_atr * atr, "volume": w["volume"] * volume_score(F.col("rvol20")), "trend": w["trend"] * trend,
        "volatility": w["volatility"] * F.when(comp.isNotNull(), clamp(300 * (1 - comp))).otherwise(50.0), "strength": w["strength"] * clamp(50 + s * 1000 * F.col("rs_spy_20")),
        "bias": w["regime"] * F.when(F.col("regime").contains("Bullish" if long else "Bearish"), 80.0).otherwise(45.0),
    }


def _best(lengths: Column, long: bool, p: SetupParams) -> Column:
    """Struct of the best base length's candidate in one direction, null where none.

    Functions over arrays are evaluated without compiled code or shared parts, so each step computes its values once, in a struct that the next one
    reads, and only lengths with a setup come to the levels and the score.
    """
    s, side = (1.0, 0) if long else (-1.0, 1)
    of = lambda name: F.col(f"_{'long' if long else 'short'}_{name}")
    c, atr, w = of("c"), F.col("atr20"), p.weights

    def placed(x: Column) -> Column:
        resistance, support = (x["hh"], x["ll"]) if long else (-x["ll"], -x["hh"])
        return F.struct(x["ord"].alias("ord"), x["n"].alias("n"), x["rng"].alias("rng"), support.alias("support"), ((c - support) / atr).alias("rejection"), ((c - resistance) / atr).alias("breakout"), (c > resistance).alias("above"))

    def classified(x: Column) -> Column:
        based = (x["rng"] <= p.range_max) & of("calm")
        broke = holds(x["above"] & of("near") & (x["breakout"] >= p.breakout_atr_min))
        reversal = holds((of("low") < x["support"]) & (c > x["support"]) & of("turned") & (x["rejection"] >= p.reversal_atr_min))
        family = F.coalesce(F.when(holds(based & (x["rng"] <= p.tight_range) & of("tight")), CONTRACTION[side]), of("family"), F.when(holds(based), CONSOLIDATION[side]))
        return F.struct(x["ord"].alias("ord"), x["n"].alias("n"), x["rng"].alias("rng"), x["support"].alias("support"), x["rejection"].alias("rejection"), x["breakout"].alias("breakout"), reversal.alias("reversal"), F.when(broke, family).alias("family"))

    def levelled(x: Column) -> Column:
        setup = F.when(x["reversal"], REVERSAL[side]).otherwise(F.coalesce(x["family"], of("anyway")))
        trigger = F.when(x["reversal"], x["rejection"]).when(x["family"].isNotNull(), x["breakout"]).otherwise(of("moved"))
        level = F.when(x["reversal"], of("low") - of("buffer")).otherwise(F.coalesce(x["support"] - of("buffer"), of("floor")))
        return F.struct(x["ord"].alias("ord"), x["n"].alias("n"), x["rng"].alias("rng"), setup.alias("setup"), trigger.alias("trigger"), F.greatest(level, of("floor")).alias("stop"))

    def scored(x: Column) -> Column:
        base = F.when(x["rng"].isNotNull(), clamp(100 - 100 * x["rng"] / p.range_max)).otherwise(50.0)
        score = w["breakout"] * clamp(50 + 35 * x["trigger"]) + of("volume") + w["base"] * base + of("trend") + of("volatility") + of("strength") + of("bias")
        risk = c - x["stop"]
        return F.struct(
            half_up(score, 1).alias("score"), (-x["ord"]).alias("first"), x["setup"].alias("setup"), x["n"].alias("base_days"), x["trigger"].alias("trigger_atr"), x["rng"].alias("base_range"),
            F.when(of("strong"), "Strong").otherwise("Mixed").alias("trend"), (s * x["stop"]).alias("stop"), (s * (c + p.target_r * risk)).alias("target"), risk.alias("risk"),
        )

    def moves(highest: Column, lowest: Column) -> Column:
        return (F.col("close") > highest) | (F.col("low") < lowest) if long else (F.col("close") < lowest) | (F.col("high") > highest)

    # the shortest base has the narrowest range: a bar that stays within it leaves no longer one either
    n = min(p.lengths)
    some = of("anyway").isNotNull() | moves(F.col(f"hh_{n}"), F.col(f"ll_{n}"))
    near = F.filter(lengths, lambda x: of("anyway").isNotNull() | moves(x["hh"], x["ll"]))
    found = F.filter(F.transform(F.transform(near, placed), classified), lambda x: x["reversal"] | x["family"].isNotNull() | of("anyway").isNotNull())
    return F.when(some, F.array_max(F.transform(F.filter(F.transform(found, levelled), lambda x: c - x["stop"] > 0), scored)))


def candidates(features: DataFrame, p: SetupParams = SETUP, keep: tuple[str, ...] = ()) -> DataFrame:
    """Best base length of every bar and direction: ticker, date, direction, score and levels. No shuffle: lengths stay within the row.

    The columns `keep` of the bar stay too. Ties go to the first length. Bars without volume, location or range to judge by are dropped before lengths are tried.
    """
    lengths = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("n"), F.col(f"hh_{n}").alias("hh"), F.col(f"ll_{n}").alias("ll"), F.col(f"rng_{n}").alias("rng")) for i, n in enumerate(p.lengths)))
    ready = features.where((F.col("rvol20") >= p.rvol_min) & F.col("close_loc").isNotNull() & (F.col("atr20") > 0))
    ready = ready.withColumns({f"_{name}_{k}": x for name, long in (("long", True), ("short", False)) for k, x in _side(long, p).items()})
    sides = F.array(*(F.struct(F.lit(direction).alias("direction"), _best(lengths, long, p).alias("b")) for direction, long in (("Long", True), ("Short", False))))
    rows = ready.withColumn("_s", F.explode(sides)).where("_s.b is not null")
    b = lambda c: F.col(f"_s.b.{c}")
    return rows.select(
        "ticker", "date", F.col("_s.direction").alias("direction"), b("setup").alias("setup"), b("score").alias("setup_score"), half_up(F.col("rvol20"), 2).alias("rvol20"), F.col("vol_accel"), b("base_days").alias("base_days"),
        half_up(b("trigger_atr"), 2).alias("breakout_atr"), b("trend").alias("trend"), F.col("close_loc"), b("base_range").alias("base_range_pct"), F.col("atr20_pct"), (b("risk") / F.col("atr20")).alias("risk_atr"), F.col("dv20"), F.col("gap_pct"),
        F.coalesce(half_up(F.col("atr_comp"), 3), F.lit(0.0)).alias("atr_compression"), "trend20", "trend50", "trend200", "rs_spy_20", "tr_atr20", F.col("close").alias("entry"), b("stop").alias("stop"), b("target").alias("target"), b("risk").alias("risk"), F.col("regime"),
        F.format_string("%dd setup + %sx RVOL + trigger %s ATR + %s trend", b("base_days"), half_up(F.col("rvol20"), 1), half_up(b("trigger_atr"), 1), F.lower(b("trend"))).alias("why"), "rn", *keep,
    )


def historical(features: DataFrame, p: SetupParams = SETUP, min_price: float = 0.0, min_dollar_volume: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Signals of all bars after the warm-up that pass price and liquidity, with the columns `keep` of the bars. Filters come after all windows."""
    ok = (F.col("rn") > p.warmup) & (F.col("close") >= min_price) & (F.col("dv20") >= min_dollar_volume)
    return candidates(features.where(ok), p, keep)


def last_bars(features: DataFrame) -> DataFrame:
    """Each ticker's last bar: the one that none follows, in the order that the features' windows have, so the wide rows are not sorted once more."""
    follows = F.lead(F.lit(True)).over(Window.partitionBy("ticker").orderBy("date"))
    return features.withColumn("_follows", follows).where("_follows is null").drop("_follows")


def latest(features: DataFrame, p: SetupParams = SETUP, min_price: float = 0.0, min_dollar_volume: float = 0.0) -> DataFrame:
    """Signals on each ticker's last bar."""
    return candidates(last_bars(features).where((F.col("close") >= min_price) & (F.col("dv20") >= min_dollar_volume)), p)


def quality(signals: DataFrame) -> DataFrame:
    """Adds quality_flags, quality_status, market_context and the booleans qc_flagged, qc_volume, qc_risk, qc_counter."""
    accel, rvol, trigger, atr, risk = (F.col(c) for c in ("vol_accel", "rvol20", "breakout_atr", "atr20_pct", "risk_atr"))
    counter = holds((F.col("regime").startswith("Bullish") & (F.col("direction") == "Short")) | (F.col("regime").startswith("Bearish") & (F.col("direction") == "Long")))
    flags = F.array_compact(F.array(
        F.when(accel >= 10, "EXTREME VOLUME ACCELERATION (>=10x prior day)").when(accel >= 5, "HIGH VOLUME ACCELERATION (>=5x prior day)"),
        F.when(rvol >= 10, "EXTREME RVOL (>=10x 20-day average)"), F.when(trigger >= 4, "EXTENDED TRIGGER (>=4 ATR)"), F.when(atr >= 0.08, "HIGH VOLATILITY (ATR20 >=8% of price)"),
        F.when(risk < 0.5, "TIGHT REFERENCE STOP (<0.5 ATR)"), F.when(counter, "COUNTERTREND VS SPY REGIME"),
    ))
    volume, risky = holds(accel >= 10) | holds(rvol >= 10), holds(trigger >= 4) | holds(atr >= 0.08) | holds(risk < 0.5)
    return signals.withColumns({
        "quality_flags": F.when(F.size(flags) > 0, F.array_join(flags, "; ")).otherwise(NO_FLAGS), "qc_flagged": F.size(flags) > 0, "qc_volume": volume, "qc_risk": risky, "qc_counter": counter,
        "quality_status": F.when(volume, STATUS_VOLUME).when(risky, STATUS_RISK).when(counter, STATUS_COUNTER).otherwise(STATUS_STANDARD),
        "market_context": F.when(counter, "Countertrend vs SPY").otherwise("Aligned / neutral vs SPY"),
    })


def reparsed_quality(signals: DataFrame, flags: str = "quality_flags") -> DataFrame:
    """The booleans as the ledger reads them back from the flags' text: unusual volume is HIGH or EXTREME with VOLUME."""
    text = F.upper(F.coalesce(F.col(flags), F.lit("")))
    return signals.withColumns({
        "ledger_flagged": (text != "") & (text != NO_FLAGS.upper()), "ledger_volume": text.contains("VOLUME") & (text.contains("HIGH") | text.contains("EXTREME")), "ledger_counter": text.contains("COUNTERTREND"),
    })


def with_ids(signals: DataFrame) -> DataFrame:
    """candidate_id of date, ticker and direction, kept once."""
    x = signals.withColumn("candidate_id", F.concat_ws("|", F.col("date").cast("string"), "ticker", "direction"))
    first = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("setup_score"), "setup"))
    return x.withColumn("_n", first).where("_n = 1").drop("_n")


def ranked(signals: DataFrame, top: int | None = None, by: tuple[str, ...] = ("direction",)) -> DataFrame:
    """signal_rank within each group by score, ties by ticker; with `top`, only the first so many."""
    w = Window.partitionBy(*by).orderBy(F.col("setup_score").desc_nulls_last(), "ticker")
    x = signals.withColumn("signal_rank", F.row_number().over(w))
    return x if top is None else x.where(F.col("signal_rank") <= top)
