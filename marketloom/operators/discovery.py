"""Rules found on validation dates and confirmed on later ones, and frozen candidates tested on fresh signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.exprs import holds
from marketloom.operators import statistics as A
from marketloom.operators.outcomes import ahead_of, forward_bars

# Targets in units of risk, horizons in sessions, and edges of right-closed bins, open at both ends.
TARGETS = (0.50, 0.75, 1.00, 1.25, 1.50, 2.00)
SESSIONS = (3, 5, 10)
EDGES = {
    "rvol20": (-A.INF, 1.2, 1.5, 2.0, 3.0, A.INF),
    "breakout_atr": (-A.INF, 0.25, 0.5, 1.0, 1.5, 2.0, A.INF),
    "atr_compression": (-A.INF, 0.0, 0.15, 0.25, 0.35, A.INF),
    "trend20": (-A.INF, -1.0, 0.0, 1.0, 2.0, A.INF),
    "trend50": (-A.INF, -1.0, 0.0, 1.0, 2.0, A.INF),
    "trend200": (-A.INF, -1.0, 0.0, 1.0, 2.0, A.INF),
    "rs_spy_20": (-A.INF, -0.05, 0.0, 0.05, 0.10, A.INF),
    "tr_atr20": (-A.INF, 1.0, 1.5, 2.0, 3.0, A.INF),
    "close_loc": (-A.INF, 0.35, 0.5, 0.65, 0.8, A.INF),
    "base_range_pct": (-A.INF, 0.04, 0.06, 0.08, 0.10, 0.12, A.INF),
    "atr20_pct": (-A.INF, 0.01, 0.02, 0.04, 0.06, 0.10, A.INF),
    "risk_atr": (-A.INF, 0.50, 0.75, 1.00, 1.25, 1.50, A.INF),
    "gap_pct": (-A.INF, -0.05, -0.02, 0.0, 0.02, 0.05, A.INF),
}
# Frozen candidates as direction, setup, feature, upper edge of the bin, horizon, target.
CANDIDATES = (
    ("Long", "Failed Breakdown Reversal", "trend50", -1.0, 10, 0.75),
    ("Long", "Failed Breakdown Reversal", "trend50", -1.0, 10, 1.0),
    ("Long", "Failed Breakdown Reversal", "trend50", -1.0, 10, 1.25),
    ("Long", "Range Expansion", "breakout_atr", 1.0, 10, 0.5),
    ("Long", "Failed Breakdown Reversal", "close_loc", 0.65, 10, 1.5),
    ("Long", "Failed Breakdown Reversal", "trend50", -1.0, 10, 0.5),
    ("Long", "Failed Breakdown Reversal", "trend50", -1.0, 5, 0.75),
    ("Long", "Range Expansion", "breakout_atr", 1.0, 10, 0.75),
    ("Long", "Failed Breakdown Reversal", "gap_pct", 0.02, 10, 1.0),
    ("Long", "Failed Breakdown Reversal", "risk_atr", 1.0, 10, 1.25),
    ("Long", "Failed Breakdown Reversal", "gap_pct", 0.02, 10, 1.25),
    ("Long", "Trend Continuation", "base_range_pct", 0.10, 10, 0.5),
    ("Long", "Failed Breakdown Reversal", "trend50", -1.0, 10, 1.5),
    ("Long", "Failed Breakdown Reversal", "close_loc", 0.65, 10, 1.0),
    ("Long", "Failed Breakdown Reversal", "close_loc", 0.65, 10, 2.0),
    ("Long", "Failed Breakdown Reversal", "base_range_pct", 0.06, 10, 1.25),
    ("Long", "Failed Breakdown Reversal", "risk_atr", 1.25, 10, 0.75),
    ("Long", "Failed Breakdown Reversal", "rs_spy_20", 0.0, 10, 1.25),
    ("Long", "Failed Breakdown Reversal", "risk_atr", 1.0, 10, 1.5),
    ("Long", "Range Expansion", "rvol20", 3.0, 10, 1.0),
)
KEYS = ("ticker", "date", "direction", "setup")


def touches(signals: DataFrame, bars: DataFrame | None, keys: tuple[str, ...] = KEYS, targets: tuple[float, ...] = TARGETS, sessions: int = max(SESSIONS)) -> DataFrame:
    """Of signals(keys, rn, risk), entered at the next open: keys, stop_k and t0, t1, ... - the first bar that touches the stop one risk away, and each target.

    Null where a level is not touched within `sessions` bars. Signals without a next bar or a positive risk are left out.
    """
    rows = forward_bars(signals.where("risk > 0").select(*keys, "rn", "risk", *ahead_of(signals)), bars, sessions)
    entry = F.first(F.when(F.col("k") == 1, F.col("b_open")), True).over(Window.partitionBy(*keys))
    rows = rows.withColumn("e", entry).where("e is not null")
    long = F.col("direction") == "Long"
    sign = F.when(long, 1.0).otherwise(-1.0)
    level = lambda t: F.col("e") + sign * t * F.col("risk")
    stopped = F.when(long, F.col("b_low") <= level(-1.0)).otherwise(F.col("b_high") >= level(-1.0))
    reached = lambda t: F.when(long, F.col("b_high") >= level(t)).otherwise(F.col("b_low") <= level(t))
    return rows.groupBy(*keys).agg(F.min(F.when(stopped, F.col("k"))).alias("stop_k"), *(F.min(F.when(reached(t), F.col("k"))).alias(f"t{i}") for i, t in enumerate(targets)))


def won(target_k: str, horizon: int | Column) -> Column:
    """Whether the target is touched within the horizon and before the stop; both in one bar count for the stop."""
    return holds((F.col(target_k) <= horizon) & (F.col("stop_k").isNull() | (F.col(target_k) < F.col("stop_k"))))


def with_signal_features(found: DataFrame, signals: DataFrame, features: tuple[str, ...] = tuple(EDGES)) -> DataFrame:
    """Outcomes with the features of their signal, kept once a key (the best score, then the lowest risk); outcomes without a signal keep nulls."""
    first = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("setup_score").desc_nulls_last(), "risk", *features))
    once = signals.withColumn("_n", first).where("_n = 1").select(*KEYS, *features)
    return found.join(once.hint("merge"), list(KEYS), "left")


def outcome_grid(found: DataFrame, *keep: str, targets: tuple[float, ...] = TARGETS, horizons: tuple[int, ...] = SESSIONS) -> DataFrame:
    """One row for each outcome of touches(), target and horizon: keep columns, target_r, horizon, outcome."""
    cells = F.array(*(F.struct(F.lit(t).alias("target_r"), F.lit(h).alias("horizon"), won(f"t{i}", h).cast("int").alias("outcome")) for i, t in enumerate(targets) for h in horizons))
    return found.withColumn("_c", F.explode(cells)).select(*keep, "_c.target_r", "_c.horizon", "_c.outcome")


def discovered_rules(rows: DataFrame, targets: tuple[float, ...] = TARGETS, horizons: tuple[int, ...] = SESSIONS, edges: dict[str, tuple[float, ...]] = EDGES, min_n: int = 100) -> DataFrame:
    """Validation and holdout results of each direction, setup, feature, bin, horizon and target with min_n validation rows.

    rows: touches() with features and partition. Wins of all horizons and targets are counted in one grouping; only its few groups
    are unfolded into the grid, not the outcomes.
    """
    by = ["direction", "setup", "feature", "bin"]
    bins = A.feature_bins(rows, ["direction", "setup", "partition", "stop_k", *(f"t{i}" for i in range(len(targets)))], edges)
    cells = [(i, t, h) for i, t in enumerate(targets) for h in horizons]
    parts = {"v": "Validation", "h": "Holdout"}
    wins = [F.count_if((F.col("partition") == name) & won(f"t{i}", h)).alias(f"{p}_{i}_{h}") for p, name in parts.items() for i, _, h in cells]
    x = bins.groupBy(*by).agg(*(F.count_if(F.col("partition") == name).alias(f"n_{p}") for p, name in parts.items()), *wins).where(F.col("n_v") >= min_n)
    each = F.array(*(F.struct(F.lit(t).alias("target_r"), F.lit(h).alias("horizon"), F.col(f"v_{i}_{h}").alias("v"), F.col(f"h_{i}_{h}").alias("h")) for i, t, h in cells))
    x = x.withColumn("_c", F.explode(each)).select(*by, "_c.target_r", "_c.horizon", F.col("n_v").alias("validation_n"), (F.col("_c.v") / F.col("n_v")).alias("validation_rate"), F.col("n_h").alias("holdout_n"), (F.col("_c.h") / F.nullif(F.col("n_h"), F.lit(0))).alias("holdout_rate"))
    return x.withColumns({f"{p}_expectancy": F.col(f"{p}_rate") * (1 + F.col("target_r")) - 1 for p in ("validation", "holdout")})


def best_rules(rules: DataFrame, top: int = 30, min_holdout: int = 50) -> DataFrame:
    """The best rules by validation expectancy, rate and n, with holdout_pass: enough holdout rows and a positive expectancy there."""
    order = [F.desc("validation_expectancy"), F.desc("validation_rate"), F.desc("validation_n"), "direction", "setup", "feature", "bin", "horizon", "target_r"]
    return rules.orderBy(*order).limit(top).withColumn("holdout_pass", holds((F.col("holdout_n") >= min_holdout) & (F.col("holdout_expectancy") > 0)))


def partition_results(rows: DataFrame, by: list[str], target_r: float) -> DataFrame:
    """n, rate and expectancy of rows(outcome, partition, by) by group and partition."""
    rate = F.avg(F.col("outcome").cast("double"))
    return rows.groupBy(*by, "partition").agg(F.count("*").alias("n"), rate.alias("rate"), (rate * (1 + target_r) - 1).alias("expectancy"))


def with_holdout(results: DataFrame, by: list[str], min_n: int = 30) -> DataFrame:
    """Validation rows of partition_results() with min_n rows, each with the holdout's results of exactly its key; null where there are none."""
    here = results.where((F.col("partition") == "Validation") & (F.col("n") >= min_n)).drop("partition")
    later = results.where("partition = 'Holdout'").select(*by, F.col("n").alias("holdout_n"), F.col("rate").alias("holdout_rate"), F.col("expectancy").alias("holdout_expectancy"))
    return here.join(later.hint("merge"), by, "left")


def persistence(rows: DataFrame, by: list[str], target_r: Column | float, least_halves: int = 3) -> DataFrame:
    """Of rows(date, outcome, by), by group: half-years observed and positive, their mean expectancy, all rows' rate and expectancy, and robust."""
    half = rows.withColumn("half", A.half_year(F.col("date"))).groupBy(*by, "half").agg(F.count("*").alias("n"), F.sum("outcome").alias("wins"))
    half = half.withColumn("e", F.col("wins") / F.col("n") * (1 + target_r) - 1)
    x = half.groupBy(*by).agg(F.count("*").alias("halves_observed"), F.count_if(F.col("e") > 0).alias("positive_halves"), F.avg("e").alias("mean_half_expectancy"), F.sum("n").alias("n"), F.sum("wins").alias("wins"))
    x = x.withColumn("success_rate", F.col("wins") / F.col("n")).withColumn("expectancy", F.col("success_rate") * (1 + target_r) - 1)
    robust = (F.col("positive_halves") >= least_halves) & (F.col("halves_observed") >= least_halves) & (F.col("success_rate") > 0.5) & (F.col("expectancy") > 0)
    return x.withColumn("robust", robust)


def frozen_candidates(rows: DataFrame, candidates: tuple[tuple, ...] = CANDIDATES, edges: dict[str, tuple[float, ...]] = EDGES, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """Outcomes of the signals that meet a candidate: ticker, date, candidate_id (from 1) and its fields, outcome.

    rows: touches() with features. An equi-join on direction, setup, feature and bin with the candidates, a fixed parameter table.
    """
    table = [(n, d, s, f, edges[f].index(upper) - 1, h, t) for n, (d, s, f, upper, h, t) in enumerate(candidates, 1)]
    wanted = rows.sparkSession.createDataFrame(table, "candidate_id int, direction string, setup string, feature string, bin int, horizon int, target_r double")
    bins = A.feature_bins(rows, ["ticker", "date", "direction", "setup", "stop_k", *(f"t{i}" for i in range(len(targets)))], {f: edges[f] for f in {c[2] for c in candidates}})
    x = bins.join(F.broadcast(wanted), ["direction", "setup", "feature", "bin"])
    outcome = F.coalesce(*(F.when(F.col("target_r") == t, won(f"t{i}", F.col("horizon")).cast("int")) for i, t in enumerate(targets)))
    return x.select("ticker", "date", *wanted.columns, outcome.alias("outcome"))


def confirmed(rows: DataFrame, min_n: int = 100, level: float = 0.05, least_share: float = 0.60) -> DataFrame:
    """Confirmation of frozen_candidates(): n, wins, expectancy, one-sided binomial p against break-even, Holm's adjustment, share of positive half-years, and the gate."""
    by = ["candidate_id", "direction", "setup", "feature", "bin", "horizon", "target_r"]
    x = persistence(rows, by, F.col("target_r"))
    x = x.withColumn("p_value", A.binomial_upper(F.col("n"), F.col("wins"), 1 / (1 + F.col("target_r"))))
    held = A.holm(x.select("candidate_id", "p_value"), "p_value").select("candidate_id", "holm_p")
    x = x.join(held.hint("merge"), "candidate_id").withColumn("positive_half_rate", F.col("positive_halves") / F.col("halves_observed"))
    gate = (F.col("n") >= min_n) & (F.col("expectancy") > 0) & (F.col("holm_p") < level) & (F.col("positive_half_rate") >= least_share)
    return x.select(*by, "n", "wins", "success_rate", "expectancy", "p_value", "holm_p", "halves_observed", "positive_half_rate", gate.alias("confirmed"))
