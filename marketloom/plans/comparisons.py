"""Queries that compare portfolios, rules and samples, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.operators import indicators
from marketloom.operators import statistics as A
from marketloom.plans import sql as S
from marketloom.plans.daily import MIN_DOLLAR_VOLUME, features, historical, panel, rounded
from marketloom.plans.studies import _BINS, _DENSE, _FILLED, _FIXED, _LAB, _PAN, _SIG, _parts, labelled, parted, portfolios
from marketloom.sources import fixtures
from marketloom.sources.delimited import staged

QUERIES: dict = {}
SQL: dict[str, str] = {}
NETS = ("net_base", "net_stress")


def register(name: str, query, text: str | None = None) -> None:
    QUERIES[name] = lambda s, d: rounded(query(s, d))
    if text is not None:
        SQL[name] = text


def r6(x: str, name: str) -> str:
    return f"{S.half_up(x, 6)} as {name}"


def paired(s: SparkSession, d: str) -> DataFrame:
    """By date, each quality group's net result minus that of all candidates."""
    daily = staged(portfolios(s, d), "daily")
    keys = ["date", "direction", "horizon", "top_k"]
    every = daily.where("qc_group = 'All'").select(*keys, *(F.col(f"mean_{c}").alias(f"all_{c}") for c in NETS))
    return daily.where("qc_group != 'All'").join(every.hint("merge"), keys).where("mean_net_base is not null and all_net_base is not null").select(*keys, "qc_group", *((F.col(f"mean_{c}") - F.col(f"all_{c}")).alias(f"diff_{c}") for c in NETS))


_PAIRED = "pr as (select g.date, g.direction, g.horizon, g.top_k, g.qc_group, g.mean_net_base - a.mean_net_base as diff_net_base, g.mean_net_stress - a.mean_net_stress as diff_net_stress from daily g join daily a on a.qc_group = 'All' and g.qc_group <> 'All' and a.date = g.date and a.direction = g.direction and a.horizon = g.horizon and a.top_k = g.top_k where g.mean_net_base is not null and a.mean_net_base is not null)"
_PORT = (*_DENSE, _FIXED, _FILLED)
_GROUP = ["direction", "qc_group", "horizon", "top_k"]
register(
    "agg_28_paired_differences", lambda s, d: paired(s, d).groupBy(*_GROUP).agg(F.count("*").alias("dates"), *(F.avg(f"diff_{c}").alias(f"mean_diff_{c}") for c in NETS)),
    S.with_(*_PORT, _PAIRED) + f"select {', '.join(_GROUP)}, count(*) as dates, {', '.join(r6(f'avg(diff_{c})', f'mean_diff_{c}') for c in NETS)} from pr group by 1, 2, 3, 4",
)
register("joi_08_paired_dates", paired, S.with_(*_PORT, _PAIRED) + f"select date, {', '.join(_GROUP)}, {', '.join(r6(f'diff_{c}', f'diff_{c}') for c in NETS)} from pr")
register(
    "agg_05_setup_split", lambda s, d: parted(s, d, columns=("ticker", "date", "setup", "outcome")).groupBy("setup").pivot("partition", ["Validation", "Holdout"]).agg(F.count("ticker").alias("n"), F.avg(F.col("outcome").cast("double")).alias("rate")).na.fill(0, ["Validation_n", "Holdout_n"]),
    S.with_(*_LAB, _parts(0.6, 0.75)) + "select setup, " + ", ".join(f"count(*) filter (where partition = '{p}') as {p}_n, {r6(f'''avg(outcome) filter (where partition = '{p}')''', p + '_rate')}" for p in ("Validation", "Holdout")) + " from parts group by 1",
)
register(
    "agg_19_best_rules",
    lambda s, d: A.rule_stats(parted(s, d, columns=("date", "direction", "outcome", *A.EDGES)), ["direction"], 100).withColumn("place", F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("validation_expectancy"), F.desc("validation_n"), "feature", "bin"))).where("place <= 6").select("direction", "feature", "bin", "place", "validation_expectancy", (F.col("holdout_expectancy") > 0).alias("holdout_pass")),
    S.with_(*_LAB, _parts(0.6, 0.75), _BINS, "ru as (select direction, feature, bin, count(*) filter (where partition = 'Validation') as vn, 3*avg(outcome) filter (where partition = 'Validation') - 1 as ve, 3*avg(outcome) filter (where partition = 'Holdout') - 1 as he from bins where bin is not null group by 1, 2, 3), rk as (select *, row_number() over (partition by direction order by ve desc, vn desc, feature, bin) as place from ru where vn >= 100)")
    + f"select direction, feature, bin, place, {r6('ve', 'validation_expectancy')}, he > 0 as holdout_pass from rk where place <= 6",
)


TOP_K, AHEADS = (10, 20, 40, 80), (1, 3, 5, 10)
_FORWARD = [f"fwd_{kind}_{h}" for kind in ("ret", "excess") for h in AHEADS]


def picks(s: SparkSession, d: str, *by: str) -> DataFrame:
    """Results of the K names with the strongest momentum of each date, and of the weakest for shorts, by direction, K, horizon and `by`."""
    rows = indicators.quintile_labels(panel(s, d).where("rn > 220"))
    rows = rows.where(" and ".join(f"{c} is not null" for c in ("raw_mom20", *_FORWARD))).select("ticker", "date", "raw_mom20", "top_quintile", "bottom_quintile", *_FORWARD)
    sides = F.array(*(F.struct(F.lit(name).alias("direction"), F.lit(sign).alias("sign")) for name, sign in (("Long", 1.0), ("Short", -1.0))))
    x = rows.withColumn("_s", F.explode(sides)).select("*", "_s.*").drop("_s")
    place = F.row_number().over(Window.partitionBy("date", "direction").orderBy(F.desc(F.col("sign") * F.col("raw_mom20")), "ticker"))
    x = x.withColumn("place", place).where(F.col("place") <= max(TOP_K)).withColumn("top_k", F.explode(F.filter(F.array(*map(F.lit, TOP_K)), lambda k: k >= F.col("place"))))
    cells = F.array(*(F.struct(F.lit(h).alias("horizon"), (F.col("sign") * F.col(f"fwd_ret_{h}")).alias("r"), (F.col("sign") * F.col(f"fwd_excess_{h}")).alias("x")) for h in AHEADS))
    x = x.withColumn("label", F.when(F.col("sign") > 0, F.col("top_quintile")).otherwise(F.col("bottom_quintile"))).withColumn("_c", F.explode(cells)).select("date", "direction", "top_k", "label", "_c.*")
    share = lambda c: F.avg(c.cast("double"))
    return x.groupBy(*by, "direction", "top_k", "horizon").agg(F.count("*").alias("n"), F.avg("r").alias("mean_return"), F.avg("x").alias("mean_excess"), share(F.col("r") > 0).alias("hit_rate"), share(F.col("label")).alias("quintile_rate"))


_AVERAGE_RANK = "rank() over (partition by date order by {0} nulls last) + (count(*) over (partition by date, {0}) - 1)/2.0"
_ahead = lambda kind: "sg*case horizon " + " ".join(f"when {h} then fwd_{kind}_{h}" for h in AHEADS) + " end"
_PICKS = (
    *_PAN,
    f"pq as (select *, case when fwd_excess_5 is not null then ({_AVERAGE_RANK.format('fwd_excess_5')})/count(fwd_excess_5) over (partition by date) end as pct_rank from panel where rn > 220)",
    "pk as (select p.*, direction, sg, case when sg = 1 then cast(pct_rank >= 0.8 as int) else cast(pct_rank <= 0.2 as int) end as label, row_number() over (partition by date, direction order by sg*raw_mom20 desc, ticker) as place "
    f"from pq p, (values ('Long', 1), ('Short', -1)) s(direction, sg) where {' and '.join(f'{c} is not null' for c in ('raw_mom20', *_FORWARD))})",
    f"cells as (select date, direction, top_k, horizon, label, {_ahead('ret')} as r, {_ahead('excess')} as x from pk, (values {', '.join(f'({k})' for k in TOP_K)}) k(top_k), (values {', '.join(f'({h})' for h in AHEADS)}) h(horizon) where place <= top_k)",
)
for _name, _by in {"agg_20_rank_slices": (), "agg_21_daily_top_k": ("date",)}.items():
    _keys = ", ".join((*_by, "direction", "top_k", "horizon"))
    register(
        _name, lambda s, d, by=_by: picks(s, d, *by),
        S.with_(*_PICKS) + f"select {_keys}, count(*) as n, {r6('avg(r)', 'mean_return')}, {r6('avg(x)', 'mean_excess')}, {r6('avg(case when r > 0 then 1.0 else 0.0 end)', 'hit_rate')}, {r6('avg(label)', 'quintile_rate')} from cells group by {_keys}",
    )
#: Momentum in units of the average range, and the plain one.
MOMENTUM = ("atr_mom20", "atr_mom60", "raw_mom20")


def momentum(rows: DataFrame) -> DataFrame:
    """Adds atr_mom20 and atr_mom60, excess over so many sessions by the range expected over them, and raw_mom20, the plain excess."""
    scaled = {f"atr_mom{n}": F.col(f"excess_{n}") / F.nullif(F.col("atr20_pct") * math.sqrt(n), F.lit(0.0)) for n in (20, 60)}
    return rows.withColumns({**scaled, "raw_mom20": F.col("excess_20")})


_RANKS = ("target_risk_adj5", *MOMENTUM)
register(
    "agg_22_momentum_coefficients", lambda s, d: A.score_coefficients(momentum(panel(s, d).where("rn > 220")), MOMENTUM, "target_risk_adj5"),
    S.with_(
        *_PAN, f"mo as (select *, {', '.join(f'excess_{n}/nullif(atr20_pct*{math.sqrt(n)!r}, 0) as atr_mom{n}' for n in (20, 60))} from panel where rn > 220)",
        f"ok as (select date, {', '.join(_RANKS)} from mo where {' and '.join(f'{c} is not null' for c in _RANKS)})", f"rk as (select date, {', '.join(f'{_AVERAGE_RANK.format(c)} as r_{c}' for c in _RANKS)} from ok)",
    )
    + " union all ".join(f"select date, count(*) as names, '{c}' as ranking, {r6(f'corr(r_{c}, r_target_risk_adj5)', 'ic')} from rk group by date having count(*) >= 20" for c in MOMENTUM),
)
register(
    "flt_07_liquidity_gate", lambda s, d: features(s, d).withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(f"k = 1 and close >= 5 and dv20 >= {MIN_DOLLAR_VOLUME}").select("ticker", "date", "close", "dv20"),
    S.with_(*S.BASE) + f"select ticker, date, {r6('close', 'close')}, {r6('dv20', 'dv20')} from (select *, row_number() over (partition by ticker order by date desc) as k from features) q where k = 1 and close >= 5 and dv20 >= {MIN_DOLLAR_VOLUME}",
)
register(
    "flt_09_eligible_bars", lambda s, d: features(s, d).where(f"rn > 220 and close >= 5 and dv20 >= {MIN_DOLLAR_VOLUME} and rvol20 >= 1.2 and atr20 > 0").select("ticker", "date", "regime"),
    S.with_(*S.BASE) + f"select ticker, date, regime from features where rn > 220 and close >= 5 and dv20 >= {MIN_DOLLAR_VOLUME} and rvol20 >= 1.2 and atr20 > 0",
)
register("flt_10_warmup", lambda s, d: features(s, d).where("rn > 220").groupBy("ticker").agg(F.count("*").alias("bars")), S.with_(*S.BASE) + "select ticker, count(*) as bars from features where rn > 220 group by 1")
register(
    "flt_11_complete_cases", lambda s, d: features(s, d).dropna(subset=["ema200", "atr40", "rvol20", "close_loc", "rs_spy_20"]).select("ticker", "date"),
    S.with_(*S.BASE) + "select ticker, date from features where ema200 is not null and atr40 is not null and rvol20 is not null and close_loc is not null and rs_spy_20 is not null",
)
register("flt_12_recent", lambda s, d: historical(s, d).where(F.col("date") >= F.date_sub(F.lit("1998-06-30").cast("date"), 30)).select("ticker", "date", "direction"), S.with_(*_SIG) + "select ticker, date, direction from signals where date >= date '1998-06-30' - 30")


def cascade(s: SparkSession, d: str) -> DataFrame:
    """Disjoint evenly spaced samples, each from what the earlier ones left."""
    rest, out = fixtures.bars(s, d).select("ticker").distinct(), None
    for i, n in enumerate((20, 30)):
        picked = A.evenly_spaced(rest, "ticker", n)
        out = picked.withColumn("sample", F.lit(i)) if out is None else out.unionByName(picked.withColumn("sample", F.lit(i)))
        rest = rest.join(F.broadcast(picked), "ticker", "left_anti")  # at most n rows
    return out


_PICK = "select ticker from (select ticker, row_number() over (order by ticker) - 1 as idx, count(*) over () as n from {0}) z where idx in (select cast(round_even(i*(n-1)/{1}, 0) as bigint) from range({2}) t(i))"
register("smp_02_cascade", cascade, S.with_(S.BARS, "a0 as (select distinct ticker from bars)", f"p0 as ({_PICK.format('a0', '19.0', 20)})", "a1 as (select ticker from a0 where ticker not in (select ticker from p0))", f"p1 as ({_PICK.format('a1', '29.0', 30)})") + "select ticker, 0 as sample from p0 union all select ticker, 1 from p1")


def calibration(s: SparkSession, d: str, bins: int = 10) -> DataFrame:
    """Mean score and observed rate by quantile bin of the score's rank, by direction."""
    x = A.placed(staged(labelled(s, d), "labelled"), "setup_score", ("ticker", "date"), "direction").withColumns({"p": F.col("setup_score") / 100, "n": F.col("total")})
    x = x.withColumn("bin", F.greatest(F.ceil((F.col("place") - 1) * bins / F.nullif(F.col("n") - 1, F.lit(0))) - 1, F.lit(0)).cast("int"))
    return x.groupBy("direction", "bin").agg(F.count("*").alias("rows"), F.avg("p").alias("mean_p"), F.avg(F.col("outcome").cast("double")).alias("observed"))


register(
    "mod_12_calibration", calibration,
    S.with_(*_LAB, "cb as (select *, setup_score/100 as p, row_number() over (partition by direction order by setup_score, ticker, date) as place, count(*) over (partition by direction) as n from lab)")
    + f"select direction, cast(greatest(ceil((place-1)*10/nullif(n-1, 0)) - 1, 0) as int) as bin, count(*) as rows, {r6('avg(p)', 'mean_p')}, {r6('avg(outcome)', 'observed')} from cb group by 1, 2",
)
