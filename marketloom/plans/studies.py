"""Queries over outcomes, statistics, samples and the universe, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import indicators
from marketloom.operators import outcomes as O
from marketloom.operators import signals as G
from marketloom.operators import statistics as A
from marketloom.params import COSTS
from marketloom.plans import sql as S
from marketloom.plans.daily import DIGITS, features, historical, panel, rounded
from marketloom.sources import fixtures
from marketloom.sources import universe as U
from marketloom.sources.delimited import staged

QUERIES: dict = {}
SQL: dict[str, str] = {}
MIN_CAP = 3000.0


def register(name: str, query, text: str | None = None) -> None:
    QUERIES[name] = lambda s, d: rounded(query(s, d))
    if text is not None:
        SQL[name] = text


def rounding(texts: str, doubles: str) -> str:
    return ", ".join([*texts.split(), *(f"{S.half_up(c, DIGITS)} as {c}" for c in doubles.split())])


def ahead(s: SparkSession, d: str, sessions: int = 10) -> DataFrame:
    """Signals with their following bars, taken in the ticker's own windows."""
    return G.historical(O.with_ahead(features(s, d), sessions), keep=("ahead",))


def labelled(s: SparkSession, d: str, reanchor: bool = False) -> DataFrame:
    """Signals with their outcome; bars are read once."""
    return O.labelled(ahead(s, d), reanchor=reanchor)


def parted(s: SparkSession, d: str, *cuts: float, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    """Labelled signals with their partition by date; they are used twice for that, so they are staged, of `columns` only."""
    return A.date_partitions(staged(labelled(s, d).select(*columns), "labelled"), *cuts)


_ENTRY = "case when k = 1 then b.open end"
_TOUCH = """
nb as (select ticker, date, open, high, low, close, row_number() over (partition by ticker order by date) as brn from bars),
fw as (select s.*, b.brn - s.rn as k, b.open as bo, b.high as bh, b.low as bl, b.close as bc, max(case when b.brn = s.rn + 1 then b.open end) over (partition by s.ticker, s.date, s.direction) as nxt
  from signals s join nb b on b.ticker = s.ticker and b.brn between s.rn + 1 and s.rn + 10),"""


def _labels(reanchor: bool) -> str:
    shift = "nxt - entry" if reanchor else "0"
    return f"""{_TOUCH}
lv as (select *, entry + {shift} as entry_actual, stop + {shift} as stop_actual, target + {shift} as target_actual from fw),
ht as (select *, case when direction = 'Long' then bh >= target_actual else bl <= target_actual end as ht, case when direction = 'Long' then bl <= stop_actual else bh >= stop_actual end as hs from lv),
labels as (select ticker, date, direction, any_value(entry_actual) as entry_actual, any_value(stop_actual) as stop_actual, any_value(target_actual) as target_actual,
  coalesce(min_by(case when ht and not hs then 1 else 0 end, k) filter (where ht or hs), 0) as outcome, min(k) filter (where ht or hs) as touch_k from ht group by 1, 2, 3),
lab as (select s.*, l.outcome from signals s join labels l on s.ticker = l.ticker and s.date = l.date and s.direction = l.direction)"""


_SIG = (*S.BASE, S.SIGNALS)
for _name, _re in {"out_01_first_touch": False, "out_02_reanchored": True}.items():
    register(_name, lambda s, d, r=_re: O.first_touch(ahead(s, d), reanchor=r), S.with_(*_SIG, _labels(_re)) + "select " + rounding("ticker date direction outcome touch_k", "entry_actual stop_actual target_actual") + " from labels")
register(
    "joi_04_forward_bars", lambda s, d: O.forward_bars(ahead(s, d, 3).select("ticker", "date", "direction", "ahead"), None, 3).select("ticker", "date", "direction", "k", "b_open", "b_close"),
    S.with_(*_SIG, _TOUCH.strip().removesuffix(",")) + "select ticker, date, direction, cast(k as int) as k, floor(bo*1e6+0.5)/1e6 as b_open, floor(bc*1e6+0.5)/1e6 as b_close from fw where k <= 3",
)
_GRID_T, _GRID_H = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0), (3, 5, 10)
# Of each signal and risk model: the first bars that touch the stop and the targets, and the moves bar by bar.
_FIRSTS = f"""
nb as (select ticker, date, open, high, low, row_number() over (partition by ticker order by date) as brn from bars),
um as (select s.ticker, s.date, s.direction, s.setup, s.rn, m.risk_model, case m.risk_model when 'SignalRisk' then s.risk else s.atr20_pct*s.entry end as unit, case when direction = 'Long' then 1 else -1 end as sg
  from signals s cross join (values ('SignalRisk'), ('ATR1x')) m(risk_model) where s.risk > 0 and s.atr20_pct*s.entry > 0),
ue as (select um.*, b.open as e from um left join nb b on b.ticker = um.ticker and b.brn = um.rn + 1),
ub as (select u.*, b.brn - u.rn as k, case when sg = 1 then high else -low end as hi, case when sg = 1 then low else -high end as lo from ue u left join nb b on b.ticker = u.ticker and b.brn between u.rn + 1 and u.rn + 10),
fk as (select ticker, date, direction, setup, risk_model, any_value(e) as e, min(k) filter (where lo <= sg*e - unit) as stop_k, count(k) as bars_n, list(greatest(0.0, (hi - sg*e)/unit) order by k) filter (where k is not null) as fav, list(least(0.0, (lo - sg*e)/unit) order by k) filter (where k is not null) as adv,
  {", ".join(f"min(k) filter (where hi >= sg*e + {t}*unit) as t{i}" for i, t in enumerate(_GRID_T))} from ub group by 1, 2, 3, 4, 5)"""
_REASON = "case when e is null then 'invalid' when tk <= horizon and tk = stop_k then 'same_bar_ambiguous' when tk <= horizon and (stop_k is null or tk < stop_k) then 'target_' || tk when stop_k <= horizon then 'stop_' || stop_k else 'timeout' end as reason"
_OUTCOME = "cast(coalesce(tk <= horizon and (stop_k is null or tk < stop_k), false) as int) as outcome"
_CELLS = " union all ".join(f"select *, {h} as horizon, cast({t} as double) as target_r, t{i} as tk from fk" for i, t in enumerate(_GRID_T) for h in _GRID_H)
_GRID = f"{_FIRSTS}, gc as ({_CELLS}), grid_out as (select ticker, date, direction, setup, risk_model, horizon, target_r, {_OUTCOME}, {_REASON} from gc)"
grid = lambda s, d: O.outcome_grid(ahead(s, d), None, _GRID_T, _GRID_H)
register("out_06_target_grid", grid, S.with_(*_SIG, _GRID) + "select * from grid_out")
for _name, _by in {"agg_12_grid_summary": "setup direction risk_model target_r horizon", "agg_12_grid_by_direction": "direction risk_model target_r horizon"}.items():
    register(
        _name, lambda s, d, by=tuple(_by.split()): grid(s, d).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("outcome").cast("double")).alias("rate"), (F.avg(F.col("outcome").cast("double")) * (1 + F.col("target_r")) - 1).alias("expectancy")),
        S.with_(*_SIG, _GRID) + f"select {', '.join(_by.split())}, count(*) as n, floor(avg(outcome)*1e6+0.5)/1e6 as rate, floor((avg(outcome)*(1+target_r)-1)*1e6+0.5)/1e6 as expectancy from grid_out group by {', '.join(_by.split())}",
    )
_EXC = f"""{_FIRSTS},
ex as (select fk.*, h.horizon, t2 as tk, least(coalesce(stop_k, 99), coalesce(t2, 99), h.horizon, bars_n) as x from fk cross join (values {", ".join(f"({h})" for h in _GRID_H)}) h(horizon)),
exc as (select ticker, date, direction, setup, risk_model, horizon, list_max(fav[1:x]) as mfe_r, list_min(adv[1:x]) as mae_r, {_OUTCOME}, {_REASON} from ex)"""
excursions = lambda s, d: O.excursions(ahead(s, d), None, _GRID_H)
_QUANTILES = (("mfe_r", 0.5, "mfe_median"), ("mfe_r", 0.75, "mfe_p75"), ("mfe_r", 0.9, "mfe_p90"), ("mae_r", 0.5, "mae_median"))
register("out_05_excursions", excursions, S.with_(*_SIG, _EXC) + "select " + rounding("ticker date direction setup risk_model horizon outcome reason", "mfe_r mae_r") + " from exc")
_MOVES = ("direction", "setup", "risk_model", "horizon")


def excursion_summary(s: SparkSession, d: str) -> DataFrame:
    """n, quantiles and means of the moves by direction, setup, risk model and horizon. The quantiles read the moves again, so they are staged."""
    moves = staged(excursions(s, d).select(*_MOVES, "mfe_r", "mae_r", "outcome"), "moves")
    means = moves.groupBy(*_MOVES).agg(F.count("*").alias("n"), F.avg("mfe_r").alias("mfe_mean"), F.avg("mae_r").alias("mae_mean"), F.avg(F.col("outcome").cast("double")).alias("hit_rate"))
    return means.join(A.quantiles(moves, list(_MOVES), _QUANTILES).hint("merge"), list(_MOVES), "left").select(*_MOVES, "n", *(name for *_, name in _QUANTILES), "mfe_mean", "mae_mean", "hit_rate")


register(
    "agg_11_excursion_summary", excursion_summary,
    S.with_(*_SIG, _EXC) + f"select {', '.join(_MOVES)}, count(*) as n, " + "".join(f"floor(quantile_cont({c}, {q})*1e6+0.5)/1e6 as {name}, " for c, q, name in _QUANTILES)
    + f"floor(avg(mfe_r)*1e6+0.5)/1e6 as mfe_mean, floor(avg(mae_r)*1e6+0.5)/1e6 as mae_mean, floor(avg(outcome)*1e6+0.5)/1e6 as hit_rate from exc group by {', '.join(_MOVES)}",
)

_LAB = (*_SIG, _labels(False))
_SUMMARY = ("n n_long n_short n_tickers first_date last_date", "success_rate expectancy mean_score mean_rvol mean_breakout")
for _name, _by in {"agg_01_overall": "", "agg_02_by_direction": "direction", "agg_02_by_setup": "direction setup"}.items():
    _cols = _by.split()
    register(
        _name, lambda s, d, by=tuple(_cols): A.summary(labelled(s, d), *by),
        S.with_(*_LAB) + f"select {', '.join([*_cols, ''])} count(*) as n, floor(avg(outcome)*1e6+0.5)/1e6 as success_rate, floor((3*avg(outcome)-1)*1e6+0.5)/1e6 as expectancy, floor(avg(setup_score)*1e6+0.5)/1e6 as mean_score, floor(avg(rvol20)*1e6+0.5)/1e6 as mean_rvol, floor(avg(breakout_atr)*1e6+0.5)/1e6 as mean_breakout, "
        f"count(*) filter (where direction = 'Long') as n_long, count(*) filter (where direction = 'Short') as n_short, count(distinct ticker) as n_tickers, min(date) as first_date, max(date) as last_date from lab {'group by ' + ', '.join(_cols) if _cols else ''}",
    )
register(
    "agg_03_score_bands", lambda s, d: A.score_bands(labelled(s, d)),
    S.with_(*_LAB) + "select b.band, count(l.ticker) as n, floor(avg(outcome)*1e6+0.5)/1e6 as success_rate from (values ('<60', 0, 60), ('60-70', 60, 70), ('70-80', 70, 80), ('80-90', 80, 90), ('90+', 90, 1000000000)) b(band, lo, hi) left join lab l on setup_score >= lo and setup_score < hi group by 1",
)


def _bin(feature: str) -> str:
    edges = A.EDGES[feature]
    return "case " + " ".join(f"when {feature} > {a!r} and {feature} <= {b!r} then {i}" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))) + " end"


_BINS = "bins as (" + " union all ".join(f"select l.*, '{f}' as feature, {_bin(f)} as bin from parts l" for f in A.EDGES) + ")"


def _parts(first: float, second: float, source: str = "lab") -> str:
    return f"""dts as (select date, row_number() over (order by date) - 1 as idx, count(*) over () as total from (select distinct date from {source}) q),
parts as (select l.*, case when idx < floor({first}*total) then 'Train' when idx < floor({second}*total) then 'Validation' else 'Holdout' end as partition from {source} l join dts using (date))"""


register(
    "agg_04_feature_bins", lambda s, d: A.feature_bins(labelled(s, d), ["ticker", "date", "direction"]),
    S.with_(*_LAB, _parts(0.6, 0.75), _BINS) + "select ticker, date, direction, feature, bin from bins where bin is not null",
)
register("prt_01_date_split", lambda s, d: parted(s, d, columns=("ticker", "date", "direction")).select("ticker", "date", "direction", "partition"), S.with_(*_LAB, _parts(0.6, 0.75)) + "select ticker, date, direction, partition from parts")
register("prt_02_other_split", lambda s, d: parted(s, d, 0.5, 0.75, columns=("ticker", "date", "direction")).select("ticker", "date", "direction", "partition"), S.with_(*_LAB, _parts(0.5, 0.75)) + "select ticker, date, direction, partition from parts")
register("prt_05_half_years", lambda s, d: labelled(s, d).groupBy(A.half_year(F.col("date")).alias("half")).agg(F.count("*").alias("n")), S.with_(*_LAB) + "select cast(year(date) as varchar) || case when month(date) <= 6 then '-H1' else '-H2' end as half, count(*) as n from lab group by 1")
register("agg_32_partition_summary", lambda s, d: A.partition_summary(parted(s, d, columns=("date",))), S.with_(*_LAB, _parts(0.6, 0.75)) + "select partition, min(date) as first_date, max(date) as last_date, count(*) as n from parts group by 1")
_RULES = "count(*) filter (where partition = 'Validation') as validation_n, avg(outcome) filter (where partition = 'Validation') as validation_rate, count(*) filter (where partition = 'Holdout') as holdout_n, avg(outcome) filter (where partition = 'Holdout') as holdout_rate"
for _name, _by, _min in (("agg_06_feature_rules", "", 50), ("agg_07_setup_rules", "setup", 50)):
    _cols = [*_by.split(), "feature", "bin"]
    register(
        _name, lambda s, d, by=_by.split(), m=_min: A.rule_stats(parted(s, d, columns=("date", *by, "outcome", *A.EDGES)), by, m),
        S.with_(*_LAB, _parts(0.6, 0.75), _BINS, f"rules as (select {', '.join(_cols)}, {_RULES} from bins where bin is not null group by {', '.join(_cols)})")
        + f"select {', '.join(_cols)}, validation_n, holdout_n, floor(validation_rate*1e6+0.5)/1e6 as validation_rate, floor(holdout_rate*1e6+0.5)/1e6 as holdout_rate, floor((3*validation_rate-1)*1e6+0.5)/1e6 as validation_expectancy, floor((3*holdout_rate-1)*1e6+0.5)/1e6 as holdout_expectancy from rules where validation_n >= {_min}",
    )


def binomial(s: SparkSession, d: str) -> DataFrame:
    groups = labelled(s, d).groupBy("direction", "setup").agg(F.count("*").alias("n"), F.sum("outcome").alias("wins"))
    return A.binomial_tail(groups, "n", "wins", 1 / 3)


_BINOM = "gr as (select direction, setup, count(*) as n, cast(sum(outcome) as bigint) as wins from lab group by 1, 2), pv as (select direction, setup, n, wins, (select least(sum(exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln(1/3.0)+(n-i)*ln(2/3.0))), 1.0) from unnest(generate_series(wins, n)) as u(i)) as p_value from gr)"
register("agg_15_binomial", binomial, S.with_(*_LAB, _BINOM) + "select direction, setup, n, cast(wins as bigint) as wins, floor(p_value*1e6+0.5)/1e6 as p_value from pv")
register(
    "agg_16_holm", lambda s, d: A.holm(binomial(s, d), "p_value").select("direction", "setup", "holm_p"),
    S.with_(*_LAB, _BINOM, "rk as (select *, row_number() over (order by p_value, direction, setup, n, wins) as k, count(*) over () as m from pv)") + "select direction, setup, floor(max(least(1.0, (m-k+1)*p_value)) over (order by k rows unbounded preceding)*1e6+0.5)/1e6 as holm_p from rk",
)
register(
    "top_05_fractions", lambda s, d: A.top_fractions(staged(labelled(s, d), "labelled"), "setup_score"),
    S.with_(*_LAB, "rk as (select *, row_number() over (partition by direction order by setup_score desc, ticker, date, direction) as r, count(*) over (partition by direction) as m from lab)")
    + "select direction, fraction, count(*) as n, floor(avg(outcome)*1e6+0.5)/1e6 as success_rate, floor((3*avg(outcome)-1)*1e6+0.5)/1e6 as expectancy from rk, (values (0.05::double), (0.10::double), (0.20::double), (0.30::double)) f(fraction) where r <= greatest(1, floor(fraction*m)) group by 1, 2",
)
register(
    "mod_11_score_metrics", lambda s, d: A.score_metrics(labelled(s, d).withColumn("p", F.col("setup_score") / 100), "p", "outcome", "direction"),
    S.with_(*_LAB, "rk as (select *, setup_score/100 as p, rank() over (partition by direction order by setup_score) + (count(*) over (partition by direction, setup_score) - 1)/2.0 as r from lab)")
    + "select direction, floor(avg((p-outcome)*(p-outcome))*1e6+0.5)/1e6 as brier, floor((sum(r) filter (where outcome = 1) - sum(outcome)*(sum(outcome)+1)/2.0)/nullif(sum(outcome)*sum(1-outcome), 0)*1e6+0.5)/1e6 as auc, floor(avg(outcome)*1e6+0.5)/1e6 as base_rate from rk group by 1",
)


# Trades and portfolios run on dense series, whose calendars agree with the benchmark's.
def dense(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals, bars and benchmark of the dense series. Bars and benchmark are staged: outcomes use them again beside the signals."""
    bars, bench = staged(fixtures.dense_bars(s, d), "bars"), staged(fixtures.bench(s, d), "bench")
    return G.quality(G.historical(indicators.features(bars, bench))), bars, bench


def _net(gross: str, days: str) -> str:
    return ", ".join(f"{gross} - {c.round_trip_bps / 1e4!r} - case when direction = 'Short' then {c.borrow_rate!r}*{days}/252.0 else 0 end as net_{c.name.lower()}" for c in COSTS)


_DENSE = (*S.DENSE_BASE, S.SIGNALS, S.QUALITY)
_CAL = "cal as (select date, open as s_open, close as s_close, row_number() over (order by date) - 1 as pos from bench)"
_FIXED = f"""{_CAL},
fx0 as (select q.*, h.horizon, c.pos, e.date as entry_date, e.s_open, x.date as exit_date, x.s_close, be.open as entry_price, bx.close as exit_price, lb.last_bar from quality q cross join (values (1), (3), (5), (10)) h(horizon)
  left join cal c on c.date = q.date left join cal e on e.pos = c.pos + 1 left join cal x on x.pos = c.pos + h.horizon left join bars be on be.ticker = q.ticker and be.date = e.date left join bars bx on bx.ticker = q.ticker and bx.date = x.date left join (select ticker, max(date) as last_bar from bars group by 1) lb on lb.ticker = q.ticker),
fx1 as (select *, case when pos is null then 'not_in_calendar' when exit_date is null then 'pending_future_exit' when entry_price is null or exit_price is null then case when last_bar is null or last_bar < exit_date then 'pending_stock_bar' else 'invalid_missing_stock_bar' end else 'complete' end as status, case when direction = 'Long' then 1 else -1 end as sg from fx0),
fx2 as (select *, case when status = 'complete' then exit_price/entry_price - 1 end as stock_return, case when status = 'complete' then s_close/s_open - 1 end as bench_return from fx1),
fx as (select *, sg*stock_return as gross, sg*(stock_return-bench_return) as excess, {_net("sg*stock_return", "horizon")} from fx2)"""
fixed = lambda s, d: O.fixed_horizon(*dense(s, d))
register("out_08_fixed_horizon", lambda s, d: fixed(s, d).drop("qc_flagged", "qc_volume", "qc_risk", "qc_counter"), S.with_(*_DENSE, _FIXED) + "select " + rounding("ticker date direction horizon status entry_date exit_date", "setup_score entry_price exit_price stock_return bench_return gross excess net_base net_stress") + " from fx")
register(
    "agg_31_status_counts", lambda s, d: fixed(s, d).groupBy("horizon", "status").agg(F.count("*").alias("n")), S.with_(*_DENSE, _FIXED) + "select horizon, status, count(*) as n from fx group by 1, 2",
)
_TRADES = f"""{_CAL},
tr0 as (select q.ticker, q.date, q.direction, q.setup, q.setup_score, q.entry, q.stop, q.target, h.horizon, c.pos, (select max(pos) from cal) as last_pos, case when q.direction = 'Long' then 1 else -1 end as sg from quality q join cal c on c.date = q.date cross join (values (1), (3), (5), (10)) h(horizon)),
tr1 as (select t.*, c.pos - t.pos as k, c.date as bdate, c.s_open, c.s_close, b.open as bo, b.high as bh, b.low as bl, b.close as bc from tr0 t join cal c on c.pos between t.pos + 1 and t.pos + t.horizon left join bars b on b.ticker = t.ticker and b.date = c.date where t.pos + t.horizon <= last_pos),
tr2 as (select *, max(case when k = 1 then bo end) over (partition by ticker, date, direction, horizon) as fill, max(case when k = 1 then s_open end) over (partition by ticker, date, direction, horizon) as so from tr1),
tr3 as (select *, sg*(stop+fill-entry) as st, sg*(target+fill-entry) as tg, sg*bo as o, case when sg = 1 then bh else -bl end as hi, case when sg = 1 then bl else -bh end as lo from tr2),
tr4 as (select *, case when bo is null then 'missing' when o <= st then 'stop_gap' when o >= tg then 'target_gap_capped' when lo <= st and hi >= tg then 'stop_and_target_same_bar_stop_first' when lo <= st then 'stop' when hi >= tg then 'target' when k = horizon then 'time_exit' end as reason from tr3),
tr5 as (select *, case reason when 'stop_gap' then bo when 'target_gap_capped' then sg*tg when 'stop_and_target_same_bar_stop_first' then sg*st when 'stop' then sg*st when 'target' then sg*tg when 'time_exit' then bc end as px, row_number() over (partition by ticker, date, direction, horizon order by k) as rk from tr4 where reason is not null),
tr6 as (select *, case when fill is null or (k = 1 and reason = 'missing') then 'invalid_missing_stock_entry_bar' when reason = 'missing' then 'invalid_missing_stock_bar_before_exit' else 'complete' end as status from tr5 where rk = 1),
tr7 as (select ticker, date, direction, horizon, setup, setup_score, status, reason as exit_reason, bdate as exit_date, cast(k as int) as holding, fill as entry_price, px as exit_price, sg*(px/fill-1) as gross, sg*(px/fill-1) - sg*(s_close/so-1) as excess, sg*(px/fill-1)*fill/(sg*(entry-stop)) as r_multiple from tr6),
trades as (select ticker, date, direction, horizon, setup, setup_score, status, case when status = 'complete' then exit_reason end as exit_reason, case when status = 'complete' then exit_date end as exit_date, case when status = 'complete' then holding end as holding,
  {", ".join(f"case when status = 'complete' then {c} end as {c}" for c in ("entry_price", "exit_price", "gross", "excess", "r_multiple"))}, {_net("case when status = 'complete' then gross end", "case when status = 'complete' then holding end")} from tr7
  union all by name select ticker, date, direction, horizon, setup, setup_score, 'pending_exit_beyond_download' as status from tr0 where pos + horizon > last_pos)"""
trades = lambda s, d: O.simulated_trades(*dense(s, d))
register("out_07_simulated_trades", trades, S.with_(*_DENSE, _TRADES) + "select " + rounding("ticker date direction horizon setup status exit_reason exit_date holding", "setup_score entry_price exit_price gross excess r_multiple net_base net_stress") + " from trades")
register(
    "out_09_net_pnl", lambda s, d: trades(s, d).where("status = 'complete'").groupBy("direction", "horizon").agg(F.avg("net_base").alias("mean_net_base"), F.avg("net_stress").alias("mean_net_stress"), F.avg("holding").alias("mean_holding")),
    S.with_(*_DENSE, _TRADES) + "select direction, horizon, floor(avg(net_base)*1e6+0.5)/1e6 as mean_net_base, floor(avg(net_stress)*1e6+0.5)/1e6 as mean_net_stress, floor(avg(holding)*1e6+0.5)/1e6 as mean_holding from trades where status = 'complete' group by 1, 2",
)


_GROUPS = "(values ('All'), ('QC Clear'), ('QC Flagged'), ('No Unusual Volume'), ('Unusual Volume')) g(qc_group)"
_MEMBER = "case qc_group when 'All' then true when 'QC Clear' then not qc_flagged when 'QC Flagged' then qc_flagged when 'No Unusual Volume' then not qc_volume else qc_volume end"


def _ranked_sql(source: str) -> str:
    return f"pg as (select f.*, g.qc_group, row_number() over (partition by date, direction, qc_group, horizon order by setup_score desc, ticker) as r from {source} f cross join {_GROUPS} where {_MEMBER})"


_MEANS = ("gross", "excess", "net_base", "net_stress")
_FILLED = f"""{_ranked_sql("fx")},
daily as (select date, direction, qc_group, horizon, top_k, count(*) as selected, count(*) filter (where status = 'complete') as n, {", ".join(f"avg(case when status = 'complete' then {c} end) as mean_{c}" for c in _MEANS)}, avg(case when status = 'complete' then case when gross > 0 then 1 else 0 end end) as hit_rate
  from pg cross join (values (10), (40)) k(top_k) where r <= top_k group by 1, 2, 3, 4, 5)"""


def _slots(source: str, extra: dict[str, str] | None = None) -> str:
    more = "".join(f", {x} as {n}" for n, x in (extra or {}).items())
    out = "".join(f", case when portfolio_status = 'complete' then {n} end as {n}" for n in (extra or {}))
    return f"""{_ranked_sql(source)},
sa as (select date, direction, qc_group, horizon, top_k, count(*) as selected, count(*) filter (where status = 'complete') as done, count(*) filter (where status like 'pending%') as pending_slots, count(*) filter (where status <> 'complete' and status not like 'pending%') as missing_slots,
  {", ".join(f"sum({c}) filter (where status = 'complete') as s_{c}" for c in _MEANS)}, avg(case when net_base > 0 then 1.0 else 0.0 end) filter (where status = 'complete') as hits{more} from pg cross join (values (10), (40)) k(top_k) where r <= top_k group by 1, 2, 3, 4, 5),
sd as (select d.date, d.direction, g.qc_group, h.horizon, k.top_k, coalesce(selected, 0) as selected, coalesce(done, 0) as done, coalesce(pending_slots, 0) as pending_slots, coalesce(missing_slots, 0) as missing_slots, sa.* exclude (date, direction, qc_group, horizon, top_k, selected, done, pending_slots, missing_slots),
  case when coalesce(selected, 0) = 0 then 'no_candidates' when pending_slots > 0 then 'pending_outcomes' when missing_slots > 0 then 'unscorable_missing_outcome' else 'complete' end as portfolio_status
  from (select distinct date, direction from {source}) d cross join {_GROUPS} cross join (values (1), (3), (5), (10)) h(horizon) cross join (values (10), (40)) k(top_k)
  left join sa on sa.date = d.date and sa.direction = d.direction and sa.qc_group = g.qc_group and sa.horizon = h.horizon and sa.top_k = k.top_k),
slots as (select date, direction, qc_group, horizon, top_k, portfolio_status, selected, pending_slots, case when pending_slots > 0 then 0 else missing_slots end as missing_slots, case when portfolio_status = 'complete' then done else 0 end as n,
  case portfolio_status when 'no_candidates' then 0.0 when 'complete' then done/top_k end as slot_coverage, {", ".join(f"case portfolio_status when 'no_candidates' then 0.0 when 'complete' then s_{c}/top_k end as mean_{c}" for c in _MEANS)},
  case when portfolio_status = 'complete' then s_net_base/done end as net_base_per_trade, case when portfolio_status = 'complete' then hits end as net_hit_rate{out} from sd)"""


_DAILY = "date direction qc_group horizon top_k selected n", "mean_gross mean_excess mean_net_base mean_net_stress hit_rate"
_SLOTS = "date direction qc_group horizon top_k portfolio_status selected pending_slots missing_slots n", "slot_coverage mean_gross mean_excess mean_net_base mean_net_stress net_base_per_trade net_hit_rate"
portfolios = lambda s, d: A.daily_portfolios(fixed(s, d))
slots = lambda s, d: A.slot_portfolios(staged(fixed(s, d), "fixed"))
#: The same, written: one row a date, direction, group, horizon and K.
written_slots = lambda s, d: staged(slots(s, d), "slots")
register("agg_24_daily_portfolios", portfolios, S.with_(*_DENSE, _FIXED, _FILLED) + f"select {rounding(*_DAILY)} from daily")
register("agg_25_slot_portfolios", slots, S.with_(*_DENSE, _FIXED, _slots("fx")) + f"select {rounding(*_SLOTS)} from slots")
_SUM = """sm as (select direction, qc_group, horizon, top_k, count(*) as dates, count(*) filter (where portfolio_status <> 'no_candidates') as active_dates, count(*) filter (where portfolio_status in ('complete', 'no_candidates')) as scorable_dates, count(*) filter (where portfolio_status = 'pending_outcomes') as pending_dates,
  count(*) filter (where portfolio_status = 'unscorable_missing_outcome') as unscorable_dates, cast(sum(n) as bigint) as trades, avg(mean_gross) as mean_gross, avg(mean_excess) as mean_excess, avg(mean_net_base) as mean_net_base, avg(mean_net_stress) as mean_net_stress, avg(slot_coverage) as mean_coverage,
  avg(case when mean_net_base > 0 then 1.0 when mean_net_base is not null then 0.0 end) as positive_share from slots group by 1, 2, 3, 4)"""
register(
    "agg_27_portfolio_summary", lambda s, d: A.slot_summary(slots(s, d)),
    S.with_(*_DENSE, _FIXED, _slots("fx"), _SUM) + "select " + rounding("direction qc_group horizon top_k dates active_dates scorable_dates pending_dates unscorable_dates trades", "mean_gross mean_excess mean_net_base mean_net_stress mean_coverage positive_share") + " from sm",
)


def traded(s: SparkSession, d: str) -> DataFrame:
    """Simulated trades with the quality groups of their signals."""
    found, bars, bench = dense(s, d)
    found = staged(found, "signals")
    return O.simulated_trades(found, bars, bench).join(found.select("ticker", "date", "direction", "qc_flagged", "qc_volume").hint("merge"), ["ticker", "date", "direction"])


def _extra() -> dict:
    done = F.col("status") == "complete"
    return {
        "mean_r": F.avg(F.when(done, F.col("r_multiple"))), "stop_exits": F.count_if(done & F.col("exit_reason").startswith("stop")), "target_exits": F.count_if(done & F.col("exit_reason").startswith("target")),
        "mean_holding": F.avg(F.when(done, F.col("holding").cast("double"))),
    }


_EXTRA_SQL = {"mean_r": "avg(r_multiple) filter (where status = 'complete')", "stop_exits": "count(*) filter (where status = 'complete' and exit_reason like 'stop%')", "target_exits": "count(*) filter (where status = 'complete' and exit_reason like 'target%')", "mean_holding": "avg(holding) filter (where status = 'complete')"}
register(
    "agg_26_trade_portfolios", lambda s, d: A.slot_portfolios(traded(s, d), extra=_extra()),
    S.with_(*_DENSE, _TRADES, "tq as (select t.*, q.qc_flagged, q.qc_volume from trades t join quality q on q.ticker = t.ticker and q.date = t.date and q.direction = t.direction)", _slots("tq", _EXTRA_SQL)) + "select " + rounding(_SLOTS[0] + " stop_exits target_exits", _SLOTS[1] + " mean_r mean_holding") + " from slots",
)


def _boot_sql(source: str, value: str, by: str, tag: str, reps: int = 2500) -> str:
    """Interval of the circular block bootstrap by sums of ten consecutive values: table ci_<tag> with by, n, mean, lo, hi."""
    g = ", ".join(by.split())
    same = lambda a, b: " and ".join(f"{a}.{c} = {b}.{c}" for c in by.split())
    return f"""dv_{tag} as (select {g}, {value} as v, row_number() over (partition by {g} order by date) - 1 as p0, count(*) over (partition by {g}) as n from {source} where {value} is not null),
du_{tag} as (select * from dv_{tag} union all select {g}, v, p0 + n, n from dv_{tag} where p0 < 9),
bs_{tag} as (select *, sum(v) over (partition by {g} order by p0 rows between current row and 9 following) as whole, list(v) over (partition by {g} order by p0 rows between current row and 9 following) as l from du_{tag}),
sz_{tag} as (select {g}, count(*) as n, avg(v) as mean from dv_{tag} group by {g}),
dr_{tag} as (select z.*, rep, blk, cast('0x' || substr(md5('bootstrap|' || rep || '|' || blk), 1, 8) as bigint) % n as p0 from sz_{tag} z, (select unnest(range({reps})) as rep) r, (select unnest(range(1000)) as blk) b where n >= 20 and blk < ceil(n/10.0)),
ms_{tag} as (select {", ".join(f"d.{c}" for c in by.split())}, rep, sum(case when blk = ceil(d.n/10.0) - 1 then list_sum(l[1:cast(d.n - 10*(ceil(d.n/10.0) - 1) as int)]) else whole end)/any_value(d.n) as m from dr_{tag} d join bs_{tag} b on {same("d", "b")} and b.p0 = d.p0 group by {", ".join(f"d.{c}" for c in by.split())}, rep),
ci_{tag} as (select z.*, c.lo, c.hi from sz_{tag} z left join (select {g}, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from ms_{tag} group by {g}) c on {same("z", "c")})"""


_GROUP = "direction qc_group horizon top_k"


def net_results(daily: DataFrame) -> DataFrame:
    """One row a date, group and cost case (net): v, the mean net result."""
    cases = F.inline(F.array(*(F.struct(F.lit(c.name).alias("net"), F.col(f"mean_net_{c.name.lower()}").alias("v")) for c in COSTS)))
    return daily.select("date", *_GROUP.split(), cases)


_NETS = "nets as (" + " union all ".join(f"select date, {', '.join(_GROUP.split())}, '{c.name}' as net, mean_net_{c.name.lower()} as v from slots" for c in COSTS) + ")"
register(
    "agg_29_bootstrap", lambda s, d: A.bootstrap_interval(net_results(written_slots(s, d)), "v", *_GROUP.split(), "net"),
    S.with_(*_DENSE, _FIXED, _slots("fx"), _NETS, _boot_sql("nets", "v", _GROUP + " net", "a")) + f"select {', '.join(_GROUP.split())}, net, n, floor(mean*1e6+0.5)/1e6 as mean, floor(lo*1e6+0.5)/1e6 as ci_low, floor(hi*1e6+0.5)/1e6 as ci_high from ci_a",
)
register(
    "agg_30_evidence_gates", lambda s, d: (lambda x: A.evidence_gate(A.bootstrap_interval(net_results(x), "v", *_GROUP.split(), "net"), A.slot_summary(x)).select(*_GROUP.split(), "scorable_dates", "decision"))(written_slots(s, d)),
    S.with_(*_DENSE, _FIXED, _slots("fx"), _SUM, _boot_sql("slots", "mean_net_base", _GROUP, "a"), _boot_sql("slots", "mean_net_stress", _GROUP, "b"))
    + """select s.direction, s.qc_group, s.horizon, s.top_k, s.scorable_dates, case when scorable_dates < 200 then 'Collecting; need 200 scorable dates under both cost cases' when mean_net_base > 0 and mean_net_stress > 0 and a.lo > 0 and b.lo > 0 then 'Positive under both cost cases; still research-only and requires independent replication'
    else 'No confirmed positive net edge under both cost cases' end as decision from sm s join ci_a a using (direction, qc_group, horizon, top_k) join ci_b b using (direction, qc_group, horizon, top_k)""",
)
_PAN = (*S.BASE, S.PANEL)
register(
    "agg_22_information_coefficient", lambda s, d: A.information_coefficient(panel(s, d).where("rn > 220"), "raw_mom20", "fwd_excess_5"),
    S.with_(*_PAN, "e as (select date, raw_mom20 as a, fwd_excess_5 as b from panel where rn > 220 and raw_mom20 is not null and fwd_excess_5 is not null), r as (select date, rank() over (partition by date order by a) + (count(*) over (partition by date, a) - 1)/2.0 as x, rank() over (partition by date order by b) + (count(*) over (partition by date, b) - 1)/2.0 as y from e)")
    + "select date, count(*) as names, floor(corr(x, y)*1e6+0.5)/1e6 as ic from r group by 1 having count(*) >= 20",
)
register(
    "agg_23_ic_summary", lambda s, d: A.information_coefficient(panel(s, d).where("rn > 220"), "raw_mom20", "fwd_excess_5").agg(F.count("*").alias("dates"), F.avg("ic").alias("mean_ic"), F.expr("percentile(ic, 0.5)").alias("median_ic"), F.avg((F.round("ic", 9) > 0).cast("double")).alias("positive"), F.stddev_samp("ic").alias("std_ic"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("icir")),
    SQL["agg_22_information_coefficient"].replace("select date, count(*) as names, floor(corr(x, y)*1e6+0.5)/1e6 as ic from r", "select count(*) as dates, floor(avg(ic)*1e6+0.5)/1e6 as mean_ic, floor(quantile_cont(ic, 0.5)*1e6+0.5)/1e6 as median_ic, floor(avg(case when round(ic, 9) > 0 then 1.0 when ic is not null then 0.0 end)*1e6+0.5)/1e6 as positive, floor(stddev_samp(ic)*1e6+0.5)/1e6 as std_ic, floor(avg(ic)/nullif(stddev_samp(ic), 0)*1e6+0.5)/1e6 as icir from (select date, corr(x, y) as ic from r") + ") q",
)

_UNIVERSE = """u as (select case when p_partkey % 50 <> 0 then substr(p_brand, 1, 3) || ' ' || (p_partkey % 400) || case when p_partkey % 11 = 0 then '.A' when p_partkey % 13 = 0 then '$B' else '' end end as symbol,
  p_name || case p_partkey % 7 when 0 then ' Common Stock' when 1 then ' Ordinary Shares' when 2 then ' Warrants' when 3 then ' 5% Notes' when 4 then ' American Depositary Shares' when 5 then ' ETF' else ' Class A Common Stock' end as security_name,
  case when p_partkey % 7 = 5 then 'Y' when p_partkey % 9 <> 0 then 'N' end as etf, case when p_partkey % 17 = 0 then 'Y' else 'N' end as test_issue, p_partkey as source_order from part)"""
register(
    "flt_01_common_equity", lambda s, d: fixtures.universe(s, d).where(U.common_equity("security_name")).select("source_order", "security_name"),
    f"with {_UNIVERSE} select source_order, security_name from u where regexp_matches(upper(trim(security_name)), '(COMMON STOCK|COMMON SHARES|ORDINARY SHARES|AMERICAN DEPOSITARY SHARES)') and not regexp_matches(upper(trim(security_name)), '\\b(PREFERRED|WARRANTS?|RIGHTS?|UNITS?|NOTES?|BONDS?|DEBENTURES?|ETF|EXCHANGE TRADED FUND|FUND)\\b')",
)
register(
    "flt_02_listed", lambda s, d: U.listed(fixtures.universe(s, d)).select("symbol", "yahoo_symbol", "source_order"),
    f"with {_UNIVERSE}, k as (select *, row_number() over (partition by trim(symbol) order by source_order) as n from u where symbol is not null and coalesce(test_issue, 'N') <> 'Y' and coalesce(etf, 'N') <> 'Y' and symbol not like '%$%' and symbol not like '%^%') select trim(symbol) as symbol, replace(trim(symbol), '.', '-') as yahoo_symbol, source_order from k where n = 1",
)
_CAPS = "caps as (select cast(s_suppkey as varchar) as symbol, coalesce(case when s_suppkey % 3 <> 0 and s_acctbal > 0 then s_acctbal end, case when s_acctbal + 500 > 0 then s_acctbal + 500 end) as cap from supplier)"
register("src_07_market_caps", lambda s, d: U.market_cap(fixtures.market_caps(s, d)), f"with {_CAPS} select symbol, floor(cap*1e6+0.5)/1e6 as cap from caps")
register(
    "flt_08_cap_gate", lambda s, d: U.cap_status(historical(s, d).select("ticker", "date", "direction"), fixtures.market_caps(s, d), MIN_CAP).select("ticker", "date", "direction", "cap_status"),
    S.with_(*_SIG, _CAPS) + f"select ticker, date, direction, case when cap is null then 'unavailable' when cap >= {MIN_CAP} then 'qualified' else 'below' end as cap_status from signals left join caps on symbol = ticker",
)
register("smp_03_hash_sample", lambda s, d: A.hash_sample(fixtures.bars(s, d), "ticker", 20, "V17-EOD-SETUP|"), S.with_(S.BARS) + "select ticker from (select distinct ticker from bars) q order by sha256('V17-EOD-SETUP|' || ticker) limit 20")
register(
    "smp_01_evenly_spaced", lambda s, d: A.evenly_spaced(fixtures.bars(s, d), "ticker", 15),
    S.with_(S.BARS) + "select ticker from (select ticker, row_number() over (order by ticker) - 1 as idx, count(*) over () as n from (select distinct ticker from bars) q) z where idx in (select cast(round_even(i*(n-1)/14.0, 0) as bigint) from range(15) t(i))",
)
register("src_bars", lambda s, d: fixtures.bars(s, d), S.with_(S.BARS) + "select " + rounding("ticker date", "open high low close volume") + " from bars")
register("src_03_benchmark", lambda s, d: fixtures.bench(s, d), S.with_(S.BENCH) + "select " + rounding("date", "open high low close volume") + " from bench")
