"""Variants of how a signal is traded, gaps at the entry, and contraction patterns before a breakout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.exprs import ratio
from marketloom.operators.indicators import by_ticker
from marketloom.operators.outcomes import ahead_of, following
from marketloom.params import SETUP
from marketloom.sources.staging import staged

KEYS = ("ticker", "date", "direction")


@dataclass(frozen=True)
class Variant:
    name: str
    kind: str
    atr: float = 0.0
    guard: float = 0.0


# The variants of entry and risk.
VARIANTS = (
    Variant("Reanchored_Signal_Risk", "reanchored"), Variant("Fixed_Signal_Levels", "fixed"), Variant("Entry_ATR_1.0x", "atr", atr=1.0), Variant("Entry_ATR_1.25x", "atr", atr=1.25),
    Variant("Entry_ATR_1.5x", "atr", atr=1.5), Variant("Gap_Guard_2pct", "guard", guard=0.02), Variant("Gap_Guard_5pct", "guard", guard=0.05), Variant("Signal_Close_Benchmark", "close"),
)


def traded(signals: DataFrame, bars: DataFrame, variants: tuple[Variant, ...] = VARIANTS, sessions: int = 10) -> DataFrame:
    """outcome, realized_r and reason of every signal under every variant. The first touching bar is found within the row.

    Levels that the entry is beyond already end the trade at the open. A gap guard leaves out entries after too large an adverse gap.
    Signals without a following bar are left out.
    """
    s = F.when(F.col("direction") == "Long", 1.0).otherwise(-1.0)
    rows = following(signals.withColumn("atr", F.col("atr20_pct") * F.col("entry")).select(*KEYS, "setup", "regime", "rn", F.col("entry").alias("close"), "stop", "target", "atr", *ahead_of(signals)), bars, sessions)
    rows = rows.withColumns({
        "next_open": F.get("ahead", F.lit(0))["open"], "_best": F.transform("ahead", lambda b: F.when(s > 0, b["high"]).otherwise(-b["low"])), "_worst": F.transform("ahead", lambda b: F.when(s > 0, b["low"]).otherwise(-b["high"])),
    }).where("next_open is not null").drop("ahead")
    each = F.array(*(F.struct(F.lit(v.name).alias("variant"), F.lit(v.kind).alias("kind"), F.lit(v.atr).alias("m"), F.lit(v.guard).alias("guard")) for v in variants))
    x = rows.select(*rows.columns, F.inline(each))
    entry = F.when(F.col("kind") == "close", F.col("close")).otherwise(F.col("next_open"))
    unit = F.when(F.col("kind") == "atr", F.col("m") * F.col("atr")).otherwise(F.abs(F.col("close") - F.col("stop")))
    fixed = F.col("kind") == "fixed"
    x = x.withColumns({"e": s * entry, "st": s * F.when(fixed, F.col("stop")).otherwise(entry - s * unit), "tg": s * F.when(fixed, F.col("target")).otherwise(entry + s * 2.0 * unit)})

    def touch(best: Column, i: Column) -> Column:
        won, lost = best >= F.col("tg"), F.get("_worst", i) <= F.col("st")
        return F.when(won & lost, "same_bar_ambiguous").when(won, "target").when(lost, "stop")

    g = x.withColumn("touched", F.get(F.array_compact(F.transform("_best", touch)), F.lit(0)))
    adverse = -s * (F.col("next_open") / F.col("close") - 1)
    reason = (
        F.when((F.col("kind") == "guard") & (adverse > F.col("guard")), "gap_filtered").when(F.col("e") == F.col("st"), "zero_risk").when(F.col("e") >= F.col("tg"), "target_at_open").when(F.col("e") <= F.col("st"), "stop_at_open")
        .otherwise(F.coalesce("touched", F.lit("timeout")))
    )
    g = g.withColumn("reason", reason)
    at_open = (F.col("e") - s * F.col("close")) / F.abs(F.col("e") - F.col("st"))
    realized = F.when(F.col("reason").endswith("at_open"), at_open).when(F.col("reason") == "target", 2.0).when(~F.col("reason").isin("gap_filtered", "zero_risk"), -1.0)
    return g.select(*KEYS, "setup", "regime", "variant", F.col("reason").isin("target", "target_at_open").cast("int").alias("outcome"), realized.alias("realized_r"), "reason", adverse.alias("adverse_gap"))


def mechanics_summary(trades: DataFrame, *by: str) -> DataFrame:
    """Rows, scored rows, success rate, mean and median realized R, filtered share and time-outs by group."""
    levels = _levels(trades, *by)
    w = Window.partitionBy(*by)
    upto = F.sum("c").over(w.orderBy("realized_r").rowsBetween(Window.unboundedPreceding, 0))
    levels = levels.withColumns({"upto": upto, "total": F.sum("c").over(w)})
    # the values at the middle place, or at both of an even number
    low, high = (F.min(F.when(F.col("upto") > F.floor(at / 2), F.col("realized_r"))) for at in (F.col("total") - 1, F.col("total")))
    return _summed(levels, {"median_r": 0.5 * low + 0.5 * high}, *by)


def _levels(trades: DataFrame, *by: str) -> DataFrame:
    """Counts and sums by group and distinct realized R: no task holds the values of a group."""
    held = F.col("reason") != "gap_filtered"
    return trades.groupBy(*by, "realized_r").agg(
        F.count("*").alias("rows"), F.count_if(held).alias("n"), F.sum(F.when(held, F.col("outcome"))).alias("wins"), F.count(F.when(held, F.col("realized_r"))).alias("c"), F.sum(F.when(held, F.col("realized_r"))).alias("r"),
        F.count_if(F.col("reason") == "timeout").alias("timeouts"),
    )


def _summed(levels: DataFrame, more: dict[str, Column], *by: str) -> DataFrame:
    rows, n = F.sum("rows"), F.sum("n")
    rate = F.sum("wins") / F.nullif(n, F.lit(0))
    return levels.groupBy(*by).agg(
        rows.alias("rows"), n.alias("n"), rate.alias("success_rate"), (3 * rate - 1).alias("expectancy"), (F.sum("r") / F.nullif(F.sum("c"), F.lit(0))).alias("mean_r"), *(x.alias(c) for c, x in more.items()),
        (rows - n).alias("gap_filtered"), ((rows - n) / rows).alias("gap_filtered_share"), F.sum("timeouts").alias("timeouts"),
    )


def robust(trades: DataFrame, windows: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Variants and directions whose mean realized R is positive in at least three of three or more named windows, and overall with a rate above a third."""
    label = F.coalesce(*(F.when(F.col("date").between(a, b), name) for name, a, b in windows))
    # some rows a variant, direction and window, from which both the windows' and the overall figures come: the trades are computed once
    levels = staged(_summed(_levels(trades.withColumn("window", label), "variant", "direction", "window"), {"r": F.sum("r"), "c": F.sum("c"), "wins": F.sum("wins")}, "variant", "direction", "window"), "windows")
    seen = levels.where("window is not null").groupBy("variant", "direction").agg(F.count_if(F.col("mean_r") > 0).alias("positive_windows"), F.count("*").alias("windows"))
    x = _summed(levels, {}, "variant", "direction").select("variant", "direction", "success_rate", "mean_r").join(seen.hint("merge"), ["variant", "direction"], "left").na.fill(0, ["positive_windows", "windows"])
    ok = (F.col("windows") >= 3) & (F.col("positive_windows") >= 3) & (F.col("success_rate") > 1 / 3) & (F.col("mean_r") > 0)
    return x.withColumn("survivor", F.coalesce(ok, F.lit(False)))


def entry_gaps(labelled: DataFrame) -> DataFrame:
    """Signals labelled with re-anchored entries: outcome and the gap of the next open, gap_pct, signed_gap_r, adverse_gap_r."""
    x = labelled.where("risk > 0")
    s = F.when(F.col("direction") == "Long", 1.0).otherwise(-1.0)
    signed = s * (F.col("entry_actual") - F.col("entry")) / F.col("risk")
    return x.select(*KEYS, "outcome", (F.col("entry_actual") / F.col("entry") - 1).alias("gap_pct"), signed.alias("signed_gap_r"), F.greatest(F.lit(0.0), -signed).alias("adverse_gap_r"))


def gap_guards(gaps: DataFrame, guards: tuple[float, ...] = (0.25, 0.50, 0.75, 1.00, 1.50)) -> DataFrame:
    """Success by direction without a guard (null) and with trades left out whose adverse gap exceeds each guard."""
    x = gaps.withColumn("guard", F.explode(F.array(F.lit(None).cast("double"), *map(F.lit, guards)))).withColumn("held", F.col("guard").isNull() | (F.col("adverse_gap_r") <= F.col("guard")))
    rate = F.avg(F.when(F.col("held"), F.col("outcome").cast("double")))
    # left-out trades are counted beside the others, so that the gaps are computed once
    out = x.groupBy("direction", "guard").agg(F.count_if("held").alias("n"), rate.alias("success_rate"), (3 * rate - 1).alias("expectancy"), (F.count("*") - F.count_if("held")).alias("excluded"))
    return out.where("n > 0")


@dataclass(frozen=True)
class Contraction:
    name: str
    base: int
    phases: int
    range_decay: float
    volume_decay: float
    atr_ratio: float
    breakout: float = 0.25


# Detectors over 15 bars in three phases, and the grid of rules.
DETECTORS = (Contraction("VCP_Moderate", 15, 3, 0.90, 0.90, 0.80), Contraction("VCP_Strict", 15, 3, 0.80, 0.85, 0.75))
RULE_GRID = (
    Contraction("VCP10_2_Mod", 10, 2, 0.90, 0.90, 0.85), Contraction("VCP15_2_Mod", 15, 2, 0.90, 0.90, 0.85), Contraction("VCP20_2_Mod", 20, 2, 0.90, 0.90, 0.85), Contraction("VCP15_3_Mod", 15, 3, 0.90, 0.90, 0.85),
    Contraction("VCP10_2_Loose", 10, 2, 0.95, 0.95, 0.90), Contraction("VCP15_2_Loose", 15, 2, 0.95, 0.95, 0.90), Contraction("VCP20_2_Loose", 20, 2, 0.95, 0.95, 0.90), Contraction("VCP15_3_Loose", 15, 3, 0.95, 0.95, 0.90),
    Contraction("VCP15_2_Early", 15, 2, 0.90, 0.95, 0.90, 0.10), Contraction("VCP20_2_Early", 20, 2, 0.90, 0.95, 0.90, 0.10), Contraction("VCP15_3_Early", 15, 3, 0.95, 0.95, 0.90, 0.10), Contraction("VCP20_3_Early", 20, 3, 0.95, 0.95, 0.90, 0.10),
)


def contractions(features: DataFrame, rules: tuple[Contraction, ...], rvol_min: float = SETUP.rvol_min) -> DataFrame:
    """Breakouts after ranges and volumes that shrink from phase to phase: ticker, date, direction, rule, breakout_atr, atr_compression.

    Phases are window frames in the order that the features' windows have, so no further shuffle is needed. Those of one length are the same frame, ended
    some rows earlier. The following bars stay, where the features have them.
    """
    spans = sorted({(r.base, r.phases) for r in rules})
    chunks: dict[str, Column] = {}
    for n in sorted({base // phases for base, phases in spans}):
        w = by_ticker().rowsBetween(-(n - 1), 0)
        chunks |= {f"_r_{n}": (F.max("high").over(w) - F.min("low").over(w)) / F.avg("close").over(w), f"_v_{n}": F.avg("volume").over(w)}
    phase = lambda c, base, phases, j: F.lag(f"_{c}_{base // phases}", base - (j + 1) * (base // phases) + 1).over(by_ticker())
    columns = {f"{c}_{base}_{phases}_{j}": phase(c, base, phases, j) for base, phases in spans for j in range(phases) for c in ("r", "v")}
    x = features.withColumns(chunks).withColumns(columns).where((F.col("rn") > SETUP.warmup) & (F.col("rvol20") >= rvol_min) & (F.col("atr20") > 0) & F.col("close_loc").isNotNull())
    shrink = ratio(F.col("atr10"), F.col("atr40"))
    sides = []
    for r in rules:
        decays = [F.col(f"{c}_{r.base}_{r.phases}_{j + 1}") <= F.col(f"{c}_{r.base}_{r.phases}_{j}") * d for c, d in (("r", r.range_decay), ("v", r.volume_decay)) for j in range(r.phases - 1)]
        calm = shrink <= r.atr_ratio
        for d in decays:
            calm = calm & d
        up, down = (F.col("close") - F.col(f"hh_{r.base}")) / F.col("atr20"), (F.col(f"ll_{r.base}") - F.col("close")) / F.col("atr20")
        for name, move, placed in (("Long", up, F.col("close_loc") >= SETUP.location_long_min), ("Short", down, F.col("close_loc") <= SETUP.location_short_max)):
            sides.append(F.when(calm & (move > 0) & (move >= r.breakout) & placed, F.struct(F.lit(r.name).alias("rule"), F.lit(name).alias("direction"), move.alias("breakout_atr"))))
    return x.withColumn("f", F.explode(F.array_compact(F.array(*sides)))).select("ticker", "date", "rn", "f.direction", "f.rule", "f.breakout_atr", (1 - shrink).alias("atr_compression"), "close", "atr20", *ahead_of(features))
