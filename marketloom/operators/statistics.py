"""Grouped statistics of labelled signals, time partitions, sampling and model-score metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.sources.staging import staged


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Counts, success rate, expectancy 3p - 1, and means by group; all rows as one group without `by`."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("outcome").cast("double")).alias("success_rate"), (3 * F.avg(F.col("outcome").cast("double")) - 1).alias("expectancy"), F.avg("setup_score").alias("mean_score"),
        F.avg("rvol20").alias("mean_rvol"), F.avg("breakout_atr").alias("mean_breakout"), F.count_if(F.col("direction") == "Long").alias("n_long"), F.count_if(F.col("direction") == "Short").alias("n_short"),
        F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


SCORE_BANDS = ((0.0, 60.0, "<60"), (60.0, 70.0, "60-70"), (70.0, 80.0, "70-80"), (80.0, 90.0, "80-90"), (90.0, 1e9, "90+"))


def score_bands(rows: DataFrame) -> DataFrame:
    """n and success rate by band of the score; empty bands stay."""
    band = F.coalesce(*(F.when((F.col("setup_score") >= a) & (F.col("setup_score") < b), name) for a, b, name in SCORE_BANDS))
    found = rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(F.col("outcome").cast("double")).alias("success_rate"))
    bands = rows.sparkSession.createDataFrame([(name,) for *_, name in SCORE_BANDS], "band string")
    return bands.join(F.broadcast(found), "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def binned(value: Column, edges: tuple[float, ...]) -> Column:
    """Number of the right-closed bin (edge, edge] that holds value; null outside or missing."""
    return F.coalesce(*(F.when((value > a) & (value <= b), F.lit(i)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))


INF = 1e18
# Edges of right-closed bins by feature, open at both ends.
EDGES = {
    "rvol20": (-INF, 1.5, 2.0, 3.0, INF),
    "breakout_atr": (-INF, 0.5, 1.0, 1.5, 2.0, INF),
    "atr_compression": (-INF, 0.10, 0.20, 0.30, 0.40, INF),
    "trend20": (-INF, -1.0, 0.0, 1.0, 2.0, INF),
    "trend50": (-INF, -1.0, 0.0, 1.0, 2.0, INF),
    "trend200": (-INF, -1.0, 0.0, 1.0, 2.0, INF),
    "rs_spy_20": (-INF, -0.05, 0.0, 0.05, 0.10, INF),
    "tr_atr20": (-INF, 1.0, 1.5, 2.0, 3.0, INF),
    "close_loc": (-INF, 0.35, 0.50, 0.65, 0.80, INF),
    "base_range_pct": (-INF, 0.04, 0.06, 0.08, 0.10, 0.12, INF),
    "atr20_pct": (-INF, 0.01, 0.02, 0.04, 0.06, 0.10, INF),
    "risk_atr": (-INF, 0.50, 0.75, 1.00, 1.25, INF),
    "gap_pct": (-INF, -0.05, -0.02, 0.0, 0.02, 0.05, INF),
}


def feature_bins(rows: DataFrame, keep: list[str], edges: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """One row for each feature of a row with its bin: keep columns, feature, bin."""
    each = F.array(*(F.struct(F.lit(f).alias("feature"), binned(F.col(f), e).alias("bin")) for f, e in (edges or EDGES).items()))
    return rows.withColumn("_f", F.explode(each)).select(*keep, "_f.feature", "_f.bin").where("bin is not null")


def date_partitions(rows: DataFrame, first: float = 0.60, second: float = 0.75) -> DataFrame:
    """partition Train, Validation or Holdout by position among the distinct signal dates (few, numbered in one place and broadcast)."""
    return rows.join(F.broadcast(date_cuts(rows.select("date").distinct(), first, second)), "date")


def date_cuts(dates: DataFrame, first: float, second: float) -> DataFrame:
    """The partition of each of the distinct dates."""
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(Window.orderBy("date")) - 1
    return dates.select("date", F.when(at < F.floor(first * n), "Train").when(at < F.floor(second * n), "Validation").otherwise("Holdout").alias("partition"))


def _by_position(at: Column, n: Column, first: float, second: float) -> Column:
    return F.when(at < F.floor(first * n), "Train").when(at < F.floor(second * n), "Validation").otherwise("Holdout")


def calendar_partitions(rows: DataFrame, calendar: DataFrame, first: float = 0.60, second: float = 0.80) -> DataFrame:
    """partition by the date's position in the market's calendar(pos, date), one row a session; dates outside of it are left out."""
    sessions = calendar.withColumn("sessions", F.count("*").over(Window.partitionBy()))
    return rows.join(F.broadcast(sessions), "date").withColumn("partition", _by_position(F.col("pos"), F.col("sessions"), first, second))


def purged(outcomes: DataFrame, calendar: DataFrame, first: float = 0.60, second: float = 0.80) -> DataFrame:
    """Outcomes(date, horizon, ...) with partition; those whose exit lies in another partition than their signal are left out."""
    x = calendar_partitions(outcomes, calendar, first, second)
    return x.where(F.col("partition") == _by_position(F.col("pos") + F.col("horizon"), F.col("sessions"), first, second))


def time_folds(rows: DataFrame, folds: int, ties: tuple[str, ...]) -> DataFrame:
    """fold: the number of the expanding split that tests a row, in order of date and ties; null for rows that are only ever trained on.

    Rows are numbered by date first: the dates are few, so their running counts are one small window, and no task sorts all rows.
    """
    dates = rows.groupBy("date").agg(F.count("*").alias("here"))
    dates = dates.select("date", (F.sum("here").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("before"), F.sum("here").over(Window.partitionBy()).alias("total"))
    x = rows.join(F.broadcast(dates), "date").withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("date").orderBy(*ties)) - 1)
    size = F.floor(F.col("total") / (folds + 1))
    start = F.col("total") - folds * size
    return x.withColumn("fold", F.when(F.col("at") >= start, F.floor((F.col("at") - start) / size)).cast("int")).drop("before", "total", "at")


def partition_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("partition").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"))


def half_year(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.when(F.month(date) <= 6, "-H1").otherwise("-H2"))


def rule_stats(rows: DataFrame, by: list[str], min_n: int = 50) -> DataFrame:
    """Validation and holdout success of each setup, feature and bin in one pass; groups with fewer validation rows are left out."""
    bins = feature_bins(rows, [*by, "partition", "outcome"])
    y, part = F.col("outcome").cast("double"), F.col("partition")
    stats = bins.groupBy(*by, "feature", "bin").agg(
        F.count_if(part == "Validation").alias("validation_n"), F.avg(F.when(part == "Validation", y)).alias("validation_rate"), F.count_if(part == "Holdout").alias("holdout_n"), F.avg(F.when(part == "Holdout", y)).alias("holdout_rate"),
    )
    return stats.where(F.col("validation_n") >= min_n).withColumns({"validation_expectancy": 3 * F.col("validation_rate") - 1, "holdout_expectancy": 3 * F.col("holdout_rate") - 1})


#: Bins a unit in which quantiles() looks for its places: a power of two, so that no rounding puts a larger value into a lower bin.
QUANTILE_BINS = 256


def quantiles(rows: DataFrame, by: list[str], wanted: tuple[tuple[str, float, str], ...]) -> DataFrame:
    """Interpolated quantiles by group, null values left out: by, and a column for each (column, share, name) of wanted; groups without values are missing.

    rows are read twice, so they should be staged; by has no nulls. Values are counted in bins; only the bins that hold a wanted place are read again, and there
    equal values are counted together, so a task sorts the distinct values of a bin, not all of a group.
    """
    columns = sorted({c for c, _, _ in wanted})
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns))
    values = rows.select(*by, F.explode(each).alias("_v")).select(*by, "_v.column", "_v.x").where("x is not null").withColumn("bin", F.floor(F.col("x") * QUANTILE_BINS))
    group = [*by, "column"]
    w = Window.partitionBy(*group)
    bins = values.groupBy(*group, "bin").agg(F.count("*").alias("here"))
    bins = bins.withColumns({"upto": F.sum("here").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("here").over(w)}).withColumn("before", F.col("upto") - F.col("here"))
    places = F.array(*(F.struct(F.lit(c).alias("of"), F.lit(name).alias("name"), ((F.col("total") - 1) * q).alias("at")) for c, q, name in wanted))
    picks = bins.withColumn("_p", F.explode(places)).where("_p.of = column").select(*group, "bin", "before", "upto", "_p.name", "_p.at")
    picks = picks.select("*", F.floor("at").alias("low"), F.ceil("at").alias("high")).where("(low >= before and low < upto) or (high >= before and high < upto)")
    picks = staged(picks, "places")  # at most two bins a group and quantile
    read = values.join(F.broadcast(picks.select(*group, "bin", "before").distinct()), [*group, "bin"]).groupBy(*group, "bin", "before", "x").agg(F.count("*").alias("here"))
    reached = F.col("before") + F.sum("here").over(Window.partitionBy(*group, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    levels = read.withColumn("end", reached).withColumn("start", F.col("end") - F.col("here")).select(*group, "bin", "x", "start", "end")
    held = levels.join(F.broadcast(picks.select(*group, "bin", "name", "at", "low", "high")), [*group, "bin"])
    at = lambda place: F.max(F.when((F.col(place) >= F.col("start")) & (F.col(place) < F.col("end")), F.col("x")))
    found = held.groupBy(*by, "name", "at", "low", "high").agg(at("low").alias("a"), at("high").alias("b"))
    value = F.when((F.col("low") == F.col("high")) | (F.col("a") == F.col("b")), F.col("a")).otherwise((F.col("high") - F.col("at")) * F.col("a") + (F.col("at") - F.col("low")) * F.col("b"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, value)).alias(name) for _, _, name in wanted))


def ordinals(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The distinct keys with at, their exact number from 0 in order (null first), and how many there are.

    Keys are range-partitioned and numbered within their partition; the partitions' sizes, one number each, give the offsets. No task sees all keys.
    """
    ranges = rows.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    own = staged(ranges.withColumn("_id", F.monotonically_increasing_id()), "ordinals")  # partition number and place in it
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in own.groupBy(part.alias("part")).count().collect())  # one row a partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return own.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(key, (F.col("_start") + place).alias("at")), total


def evenly_spaced(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n of N keys at round(j (N - 1) / (n - 1)), half to even, in order of key; all if there are no more than n. n rows are broadcast."""
    numbered, total = ordinals(rows, key)
    wanted = range(min(n, total)) if n < 2 or total <= n else sorted({round(j * (total - 1) / (n - 1)) for j in range(n)})
    places = rows.sparkSession.createDataFrame([(i,) for i in wanted], "at long")
    return numbered.join(F.broadcast(places), "at", "left_semi").select(key)


def hash_sample(rows: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """n distinct keys in order of the SHA-256 of salt and key: the same for any order of the input."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.sha2(F.concat(F.lit(salt), F.col(key)), 256)).limit(n)


def placed(rows: DataFrame, score: str, ties: tuple[str, ...], *by: str, descending: bool = False) -> DataFrame:
    """rows with place, from 1 in order of score and ties within each group, and total, the group's rows; rows without a score are left out.

    Running counts of the distinct scores, which are few, give where each score begins; only rows of equal score are numbered together,
    so no task sorts a whole group. rows is read twice.
    """
    keys, w = [*by, score], Window.partitionBy(*by)
    levels = rows.groupBy(*keys).agg(F.count("*").alias("_here"))
    before = F.sum("_here").over(w.orderBy(F.desc(score) if descending else F.asc(score))) - F.col("_here")
    levels = levels.select(*keys, before.alias("_before"), F.sum("_here").over(w).alias("total"))
    x = rows.join(levels.hint("merge"), keys)
    return x.withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy(*ties))).drop("_before")


def top_fractions(rows: DataFrame, score: str, fractions: tuple[float, ...] = (0.05, 0.10, 0.20, 0.30), tie: tuple[str, ...] = ("ticker", "date", "direction")) -> DataFrame:
    """Success rate and expectancy of the best scored shares, by direction. rows is read twice."""
    x = placed(rows, score, tie, "direction", descending=True).withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    x = x.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("fraction") * F.col("total"))))
    return x.groupBy("direction", "fraction").agg(F.count("*").alias("n"), F.avg(F.col("outcome").cast("double")).alias("success_rate"), (3 * F.avg(F.col("outcome").cast("double")) - 1).alias("expectancy"))


def holm(rows: DataFrame, p: str, *by: str) -> DataFrame:
    """Holm's step-down adjustment of p within each group: adds holm_p."""
    w = Window.partitionBy(*by).orderBy(p, *[c for c in rows.columns if c != p and c not in by])
    m = F.count("*").over(Window.partitionBy(*by))
    step = F.least(F.lit(1.0), (m - F.col("_rank") + 1) * F.col(p))
    return rows.withColumn("_rank", F.row_number().over(w)).withColumn("holm_p", step).withColumn("holm_p", F.max("holm_p").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_rank")


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 8, less the logarithm of the factors between."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    factors = x
    for i in range(1, 8):
        factors = factors * (x + float(i))
    return series - F.log(factors)


def binomial_upper(n: Column, wins: Column, p0: Column | float) -> Column:
    """P(X >= wins) for X binomial(n, p0), within the row.

    The tail that lies away from the mean is summed over at most 12 sqrt(n) + 60 terms (those beyond add less than 1e-16); below the mean it is taken from 1.
    """
    n, wins, p = n.cast("double"), wins.cast("double"), F.lit(p0).cast("double") if isinstance(p0, float) else p0
    term = lambda i: F.exp(log_gamma(n + 1) - log_gamma(i + 1) - log_gamma(n - i + 1) + i * F.log(p) + (n - i) * F.log(1 - p))
    total = lambda a, b: F.aggregate(F.sequence(a.cast("long"), b.cast("long")), F.lit(0.0), lambda s, i: s + term(i.cast("double")))
    reach = F.ceil(12 * F.sqrt(n)) + 60
    above = total(wins, F.least(n, wins + reach))
    below = 1 - total(F.greatest(F.lit(0.0), wins - 1 - reach), wins - 1)
    return F.when(wins <= 0, 1.0).when(wins >= n * p, F.least(above, F.lit(1.0))).otherwise(F.greatest(below, F.lit(0.0)))


def binomial_tail(rows: DataFrame, n: str, wins: str, p0: float) -> DataFrame:
    """Adds p_value: P(X >= wins) for X binomial(n, p0)."""
    return rows.withColumn("p_value", binomial_upper(F.col(n), F.col(wins), p0))


#: Replicates of a bootstrap that one row draws.
_CHUNK = 100


def bootstrap_interval(daily: DataFrame, value: str, *by: str, block: int = 10, reps: int = 2500, min_n: int = 20, seed: str = "bootstrap") -> DataFrame:
    """Circular block-bootstrap interval of the mean of value over dates: n, mean, ci_low, ci_high (null below min_n dates).

    Starts are hashes of seed, replicate and block, so every engine draws the same ones; only the first n draws of a replicate count.
    A group's values are an array, one a date, which the calendar bounds; the sums of its blocks are found once, and a row draws _CHUNK replicates
    by looking them up. The hashes (replicates x blocks, bounded by the calendar too) are made once and broadcast. daily is read twice.
    """
    keys = list(by)
    size = F.size("v")
    x = daily.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", F.col(value).alias("v")))).alias("v")).where(size > 0)
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, e: a + e)
    x = x.withColumn("v", F.transform("v", lambda e: e["v"])).select(*keys, size.cast("long").alias("n"), (add("v") / size).alias("mean"), "v", F.ceil(size / block).alias("blocks"))
    turn = F.concat("v", F.slice("v", 1, block - 1))  # the circle's end goes on with its start
    short = (F.col("n") - block * (F.col("blocks") - 1)).cast("int")
    sums = lambda length: F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: add(F.slice("turn", i, length)))
    drawn = x.where(F.col("n") >= min_n).withColumn("turn", turn).withColumns({"whole": sums(F.lit(block)), "part": sums(short)}).select(*keys, "n", "blocks", "whole", "part")
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "rep", "blk")), 1, 8), 16, 10).cast("long")
    most = daily.where(F.col(value).isNotNull()).groupBy(*keys).count().agg(F.ceil(F.max("count") / block).cast("int").alias("most")).where("most > 0")
    hashes = most.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("most") - 1))).select("rep", "blk", start.alias("h"))
    one = hashes.groupBy("rep").agg(F.transform(F.sort_array(F.collect_list(F.struct("blk", "h"))), lambda e: e["h"]).alias("h"))
    chunks = one.groupBy(F.floor(F.col("rep") / _CHUNK).alias("chunk")).agg(F.collect_list("h").alias("draws"))
    at = lambda h: F.pmod(h, F.col("n")).cast("int")
    mean = lambda h: (F.aggregate(F.slice(h, 1, F.col("blocks").cast("int") - 1), F.lit(0.0), lambda a, e: a + F.get("whole", at(e))) + F.get("part", at(F.get(h, F.col("blocks").cast("int") - 1)))) / F.col("n")
    rows = drawn.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((reps - 1) // _CHUNK).cast("long")))).repartition(*keys, "chunk").join(F.broadcast(chunks), "chunk")
    means = rows.select(*keys, F.explode(F.transform("draws", mean)).alias("m"))
    cis = means.groupBy(*keys).agg(F.expr("percentile(m, 0.025)").alias("ci_low"), F.expr("percentile(m, 0.975)").alias("ci_high"))
    sizes = x.select(*keys, "n", "mean")
    return sizes.join(cis.hint("shuffle_hash"), keys, "left") if by else sizes.crossJoin(cis)


QC_GROUPS = ("All", "QC Clear", "QC Flagged", "No Unusual Volume", "Unusual Volume")


def _memberships() -> Column:
    flagged, volume = F.col("qc_flagged"), F.col("qc_volume")
    return F.array_compact(F.array(F.lit(QC_GROUPS[0]), F.when(~flagged, QC_GROUPS[1]), F.when(flagged, QC_GROUPS[2]), F.when(~volume, QC_GROUPS[3]), F.when(volume, QC_GROUPS[4])))


def slot_portfolios(trades: DataFrame, values: tuple[str, ...] = ("gross", "excess", "net_base", "net_stress"), top_k: tuple[int, ...] = (10, 40), horizons: tuple[int, ...] = (1, 3, 5, 10), extra: dict[str, Column] | None = None) -> DataFrame:
    """Portfolios of K fixed slots for the full grid of date, direction, QC group, horizon and K.

    portfolio_status: no_candidates (cash: zero returns), pending_outcomes, unscorable_missing_outcome, or complete; only complete ones and
    cash have returns, as sums over K slots. The best K are taken before outcomes are known, and never replaced.
    extra: further aggregates of the selected trades that are complete.
    """
    arr = lambda xs: F.array(*map(F.lit, xs))
    keys = ["date", "direction", "qc_group", "horizon", "top_k"]
    grid = trades.select("date", "direction").distinct().withColumn("qc_group", F.explode(arr(QC_GROUPS))).withColumn("horizon", F.explode(arr(horizons))).withColumn("top_k", F.explode(arr(top_k)))
    w = Window.partitionBy("date", "direction", "qc_group", "horizon").orderBy(F.col("setup_score").desc_nulls_last(), "ticker")
    x = trades.withColumn("qc_group", F.explode(_memberships())).withColumn("rank", F.row_number().over(w)).withColumn("top_k", F.explode(arr(top_k))).where(F.col("rank") <= F.col("top_k"))
    done, waits = F.col("status") == "complete", F.col("status").startswith("pending")
    found = x.groupBy(*keys).agg(
        F.count("*").alias("selected"), F.count_if(done).alias("done"), F.count_if(waits).alias("pending_slots"), F.count_if(~done & ~waits).alias("missing_slots"), *(F.sum(F.when(done, F.col(c))).alias(f"_{c}") for c in values),
        F.avg(F.when(done, (F.col("net_base") > 0).cast("double"))).alias("net_hit_rate"), *(c.alias(n) for n, c in (extra or {}).items()),
    )
    out = grid.join(found.hint("merge"), keys, "left").na.fill(0, ["selected", "done", "pending_slots", "missing_slots"])
    status = F.when(F.col("selected") == 0, "no_candidates").when(F.col("pending_slots") > 0, "pending_outcomes").when(F.col("missing_slots") > 0, "unscorable_missing_outcome").otherwise("complete")
    out = out.withColumn("portfolio_status", status)
    full, cash = F.col("portfolio_status") == "complete", F.col("portfolio_status") == "no_candidates"
    mean = lambda c: F.when(cash, 0.0).when(full, F.col(f"_{c}") / F.col("top_k"))
    return out.select(
        *keys, "portfolio_status", "selected", "pending_slots", F.when(F.col("pending_slots") > 0, 0).otherwise(F.col("missing_slots")).alias("missing_slots"), F.when(full, F.col("done")).otherwise(0).alias("n"), F.when(cash, 0.0).when(full, F.col("done") / F.col("top_k")).alias("slot_coverage"),
        *(mean(c).alias(f"mean_{c}") for c in values), F.when(full, F.col("_net_base") / F.col("done")).alias("net_base_per_trade"), F.when(full, F.col("net_hit_rate")).alias("net_hit_rate"), *(F.when(full, F.col(n)).alias(n) for n in (extra or {})),
    )


def slot_summary(daily: DataFrame) -> DataFrame:
    """Of slot_portfolios(), by direction, QC group, horizon and K: dates by status, trades, means over dates with returns, share of positive dates."""
    status = F.col("portfolio_status")
    scored = status.isin("complete", "no_candidates")
    return daily.groupBy("direction", "qc_group", "horizon", "top_k").agg(
        F.count("*").alias("dates"), F.count_if(status != "no_candidates").alias("active_dates"), F.count_if(scored).alias("scorable_dates"), F.count_if(status == "pending_outcomes").alias("pending_dates"), F.count_if(status == "unscorable_missing_outcome").alias("unscorable_dates"),
        F.sum("n").alias("trades"), *(F.avg(f"mean_{c}").alias(f"mean_{c}") for c in ("gross", "excess", "net_base", "net_stress")), F.avg("slot_coverage").alias("mean_coverage"), F.avg((F.col("mean_net_base") > 0).cast("double")).alias("positive_share"),
    )


def evidence_gate(intervals: DataFrame, summary: DataFrame, least_dates: int = 200) -> DataFrame:
    """decision for each group of slot_summary(): enough dates, and means and interval lows above zero under both costs. intervals: by group and net (Base, Stress)."""
    keys = ["direction", "qc_group", "horizon", "top_k"]
    lows = intervals.groupBy(*keys).agg(*(F.max(F.when(F.col("net") == n, F.col("ci_low"))).alias(f"low_net_{n.lower()}") for n in ("Base", "Stress")))
    x = summary.select(*keys, "scorable_dates", "mean_net_base", "mean_net_stress").join(lows.hint("merge"), keys, "left")
    good = (F.col("mean_net_base") > 0) & (F.col("mean_net_stress") > 0) & (F.col("low_net_base") > 0) & (F.col("low_net_stress") > 0)
    decision = F.when(F.col("scorable_dates") < least_dates, f"Collecting; need {least_dates} scorable dates under both cost cases").when(good, "Positive under both cost cases; still research-only and requires independent replication").otherwise("No confirmed positive net edge under both cost cases")
    return x.withColumn("decision", decision)


def daily_portfolios(trades: DataFrame, top_k: tuple[int, ...] = (10, 40)) -> DataFrame:
    """Equal-weight portfolios of the best K by date, direction, QC group and horizon: n, mean gross, excess and net over filled names.
    Ties by ticker; names without an outcome are never substituted."""
    x = trades.withColumn("qc_group", F.explode(_memberships()))
    w = Window.partitionBy("date", "direction", "qc_group", "horizon").orderBy(F.desc("setup_score"), "ticker")
    x = x.withColumn("rank", F.row_number().over(w)).withColumn("top_k", F.explode(F.array(*map(F.lit, top_k)))).where(F.col("rank") <= F.col("top_k"))
    done = F.col("status") == "complete"
    mean = lambda c: F.avg(F.when(done, F.col(c)))
    return x.groupBy("date", "direction", "qc_group", "horizon", "top_k").agg(F.count("*").alias("selected"), F.count_if(done).alias("n"), *(mean(c).alias(f"mean_{c}") for c in ("gross", "excess", "net_base", "net_stress")), F.avg(F.when(done, (F.col("gross") > 0).cast("double"))).alias("hit_rate"))


def portfolio_summary(daily: DataFrame) -> DataFrame:
    return daily.groupBy("direction", "qc_group", "horizon", "top_k").agg(
        F.count("*").alias("dates"), F.count_if(F.col("n") > 0).alias("scored_dates"), F.sum("n").alias("trades"), *(F.avg(f"mean_{c}").alias(f"mean_{c}") for c in ("gross", "excess", "net_base", "net_stress")), F.avg((F.col("mean_net_base") > 0).cast("double")).alias("positive_share"),
    )


def score_metrics(rows: DataFrame, p: str, y: str, *by: str) -> DataFrame:
    """Brier score, AUC with ties counted half, and base rate, from counts by distinct score."""
    levels = rows.groupBy(*by, p).agg(F.count("*").alias("_c"), F.sum(F.col(y).cast("double")).alias("_w"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("_b"))
    lost = F.col("_c") - F.col("_w")
    below = F.sum(lost).over(Window.partitionBy(*by).orderBy(p)) - lost
    n, wins = F.sum("_c"), F.sum("_w")
    return levels.withColumn("_pairs", F.col("_w") * (below + lost / 2)).groupBy(*by).agg((F.sum("_b") / n).alias("brier"), (F.sum("_pairs") / F.nullif(wins * (n - wins), F.lit(0.0))).alias("auc"), (wins / n).alias("base_rate"))


def information_coefficient(rows: DataFrame, score: str, value: str, min_names: int = 20) -> DataFrame:
    """Daily Spearman correlation of score and value on dates with enough names."""
    from marketloom.operators.indicators import average_rank

    x = rows.where(F.col(score).isNotNull() & F.col(value).isNotNull())
    x = x.withColumns({"_a": average_rank(score, "date"), "_b": average_rank(value, "date")})
    return x.groupBy("date").agg(F.count("*").alias("names"), F.corr("_a", "_b").alias("ic")).where(F.col("names") >= min_names)


def score_coefficients(rows: DataFrame, scores: tuple[str, ...], value: str, min_names: int = 20) -> DataFrame:
    """Daily Spearman correlation of each score with value, over rows that have all of them: date, names, ranking, ic.

    Dates with fewer names are left out. A score or value that is the same for all names of a date has no correlation: null.
    """
    from marketloom.operators.indicators import average_rank

    x = rows.dropna(subset=[value, *scores]).select("date", value, *scores)
    x = x.withColumns({f"_{c}": average_rank(c, "date") for c in (value, *scores)})
    x = x.groupBy("date").agg(F.count("*").alias("names"), *(F.corr(f"_{c}", f"_{value}").alias(c) for c in scores)).where(F.col("names") >= min_names)
    return x.unpivot(["date", "names"], list(scores), "ranking", "ic")
