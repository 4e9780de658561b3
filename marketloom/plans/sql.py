"""ANSI SQL of the derived tables and operators, for comparison in another engine."""

from __future__ import annotations

import math

from marketloom.params import EMA_SPANS, RANGE_LENGTHS, SETUP


def half_up(x: str, digits: int) -> str:
    return f"floor(({x})*1e{digits}+0.5)/1e{digits}"


def _bars(name: str, key: str, source: str = "lineitem") -> str:
    r = lambda e: half_up(e, 4)
    w = "over (partition by ticker order by date rows unbounded preceding)"
    return f"""
{name}_d as (select {key} as ticker, cast(l_shipdate as date) as date, cast(sum(cast(round(l_discount*100) as bigint)) as double)/(100*count(*)) as ad,
  cast(sum(cast(round(l_tax*100) as bigint)) as double)/(100*count(*)) as tx, sum(l_quantity) as volume from {source} group by 1, 2),
{name}_c as (select *, {r(f"100*exp(sum(0.4*(ad-0.05)) {w})")} as close from {name}_d),
{name}_o as (select *, {r("coalesce(lag(close) over (partition by ticker order by date), 100.0)*(1+0.25*(tx-0.04))")} as open from {name}_c),
{name} as (select ticker, date, open, {r("greatest(open,close)*(1+0.10*tx+0.001)")} as high, {r("least(open,close)*(1-0.10*ad-0.001)")} as low, close, volume from {name}_o)"""


BARS = _bars("bars", "cast(l_suppkey as varchar)")
DENSE = _bars("bars", "cast(l_suppkey % (select greatest(10, count(*)//10) from supplier) as varchar)")
WIDE = _bars("bars", "cast(l_suppkey % 10 as varchar)")
BENCH = _bars("bench", "'SPY'")
SECTORS = _bars("sectors", "'S' || n_regionkey", "lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey")


def _ema(x: str, span: int) -> str:
    a = 2.0 / (span + 1)
    rate = -math.log(1 - a)
    return f"case when rn >= {span} then exp({-rate!r}*rn)*sum(case when rn = 1 then {x} else {a!r}*{x} end*exp({rate!r}*rn)) over (partition by ticker order by date rows unbounded preceding) end as ema{span}"


def _full(x: str, n: int, agg: str = "avg", last: int = 0) -> str:
    frame = f"over (partition by ticker order by date rows between {n - 1 + last} preceding and {last} preceding)" if last else f"over (partition by ticker order by date rows {n - 1} preceding)"
    return f"case when count({x}) {frame} = {n} then {agg}({x}) {frame} end"


_O = "over (partition by ticker order by date)"
_NUMBERED = f"select *, row_number() {_O} as rn, lag(close) {_O} as prev_close from"

REGIME = f"""
reg_n as ({_NUMBERED} bench),
reg_e as (select *, {", ".join(_ema("close", n) for n in EMA_SPANS)}, ({_full("high-low", 20)})/close as vol, close/lag(close, 20) {_O} - 1 as bench_ret from reg_n),
regime as (select date, bench_ret, case when close > ema20 and ema20 > ema50 and ema50 > ema200 then 'Bullish' when close < ema20 and ema20 < ema50 and ema50 < ema200 then 'Bearish' else 'Neutral' end
  || case when vol > 0.025 then ' / High Vol' else '' end as regime from reg_e)"""

FEATURES = f"""
f0 as ({_NUMBERED} (select b.*, r.bench_ret, r.regime as reg from bars b left join regime r using (date)) q),
f1 as (select *, greatest(high-low, abs(high-prev_close), abs(low-prev_close)) as true_range from f0),
f2 as (select *, case when prev_close is not null then true_range end as tr, {", ".join(_ema("close", n) for n in EMA_SPANS)},
  {", ".join(f"{_full('true_range', n)} as atr{n}" for n in (10, 20, 40))}, volume/nullif({_full("volume", 20)}, 0) as rvol20, volume/nullif(lag(volume) {_O}, 0) as vol_accel,
  {_full("close*volume", 20)} as dv20, close/lag(close, 20) {_O} - 1 as ret20, open/prev_close - 1 as gap_pct,
  last_value(bench_ret ignore nulls) over (partition by ticker order by date rows unbounded preceding) as bench_filled,
  coalesce(last_value(reg ignore nulls) over (partition by ticker order by date rows unbounded preceding), 'Neutral') as regime,
  {", ".join(f"{_full('high', n, 'max', 1)} as hh_{n}, {_full('low', n, 'min', 1)} as ll_{n}" for n in RANGE_LENGTHS)} from f1),
features as (select *, tr/nullif(atr20, 0) as tr_atr20, (close-low)/nullif(high-low, 0) as close_loc, 1-atr10/nullif(atr40, 0) as atr_comp, atr20/close as atr20_pct,
  (close-ema20)/nullif(atr20, 0) as trend20, (ema20-ema50)/nullif(atr20, 0) as trend50, (ema50-ema200)/nullif(atr20, 0) as trend200, ret20-bench_filled as rs_spy_20,
  {", ".join(f"(hh_{n}-ll_{n})/prev_close as rng_{n}" for n in RANGE_LENGTHS)} from f2)"""

_BACKS, _AHEADS = (1, 3, 5, 10, 20, 60), (1, 3, 5, 10)
PANEL = f"""
pb as (select date, {", ".join(f"close/lag(close, {n}) over (order by date) - 1 as b_{n}" for n in _BACKS)}, {", ".join(f"lead(close, {n}) over (order by date)/lead(open, 1) over (order by date) - 1 as bf_{n}" for n in _AHEADS)} from bench),
p0 as (select f.*, pb.* exclude (date), close/prev_close - 1 as ret_1 from features f left join pb using (date)),
p1 as (select *, {", ".join(f"close/lag(close, {n}) {_O} - 1 as ret_{n}" for n in (3, 5, 10, 20, 60, 120, 252))}, {", ".join(f"close/ema{n} - 1 as ema_dist_{n}" for n in EMA_SPANS)},
  ema20/lag(ema20, 5) {_O} - 1 as ema_slope20_5, ema50/lag(ema50, 10) {_O} - 1 as ema_slope50_10, {_full("ret_1", 10, "stddev_samp")} as vol10, {_full("ret_1", 20, "stddev_samp")} as vol20,
  ({_full("volume", 5)})/nullif({_full("volume", 20)}, 0) as volume_trend5_20, ln(1+greatest(dv20, 0)) as dv20_log, {_full("high", 60, "max", 1)} as hh_60, {_full("low", 60, "min", 1)} as ll_60, {_full("close", 252, "max")} as high252,
  close/nullif(open, 0) - 1 as intraday_ret, tr/close as tr_pct, atr10/close as atr10_pct, {", ".join(f"lead(close, {n}) {_O}/lead(open, 1) {_O} - 1 as fwd_ret_{n}, lead(date, {n}) {_O} as fwd_exit_{n}" for n in _AHEADS)} from p0),
p2 as (select *, {", ".join(f"ret_{n}-b_{n} as excess_{n}" for n in _BACKS)}, {", ".join(f"fwd_ret_{n}-bf_{n} as fwd_excess_{n}" for n in _AHEADS)}, close/hh_20-1 as dist_high20, close/hh_60-1 as dist_high60, close/ll_20-1 as dist_low20, close/ll_60-1 as dist_low60,
  close/high252-1 as dist_high252, (close-ll_20)/nullif(hh_20-ll_20, 0) as close_loc20, (close-ll_60)/nullif(hh_60-ll_60, 0) as close_loc60 from p1),
panel as (select *, case when fwd_excess_5/nullif(atr20_pct*sqrt(5.0), 0) is not null then greatest(least(fwd_excess_5/nullif(atr20_pct*sqrt(5.0), 0), 3.0), -3.0) end as target_risk_adj5,
  excess_20/nullif(vol20*sqrt(20.0), 0) as risk_adj_mom20, excess_60/nullif(vol20*sqrt(60.0), 0) as risk_adj_mom60, excess_20 as raw_mom20 from p2)"""


def _side(long: bool) -> str:
    p, s = SETUP, "" if long else "-"
    at_least, most = ("loc >= 0.55", f"loc >= {p.location_long_min}") if long else ("loc <= 0.45", f"loc <= {p.location_short_max}")
    resistance, support = ("hh", "ll") if long else ("-ll", "-hh")
    high, low = ("high", "low") if long else ("-low", "-high")
    names = (
        ("Failed Breakdown Reversal", "VCP / Volatility Contraction Breakout", "Range Expansion", "Trend Continuation", "Consolidation Breakout")
        if long else ("Failed Breakout Reversal", "VCP / Volatility Contraction Breakdown", "Range Expansion Down", "Trend Breakdown", "Consolidation Breakdown")
    )
    return f"""select ticker, date, '{"Long" if long else "Short"}' as direction, ord, n, rng, atr10/nullif(atr40, 0) as comp, rvol20, atr20 as atr, close_loc as loc, tr_atr20 as t, regime, rs_spy_20, {1 if long else -1} as s,
  {s}close as c, {high} as h, {low} as l, {resistance} as res, {support} as sup, {s}ema20 as e20, {s}ema50 as e50, {s}ema200 as e200, ({at_least.replace("loc", "close_loc")}) as turned, ({most.replace("loc", "close_loc")}) as near,
  '{names[0]}' as n_rev, '{names[1]}' as n_vcp, '{names[2]}' as n_exp, '{names[3]}' as n_trend, '{names[4]}' as n_cons, '{"Bullish" if long else "Bearish"}' as friend from grid"""


_P = SETUP
SIGNALS = f"""
grid as (select f.*, x.ord, x.n, case x.n {" ".join(f"when {n} then hh_{n}" for n in _P.lengths)} end as hh, case x.n {" ".join(f"when {n} then ll_{n}" for n in _P.lengths)} end as ll, case x.n {" ".join(f"when {n} then rng_{n}" for n in _P.lengths)} end as rng
  from features f cross join (values {", ".join(f"({i}, {n})" for i, n in enumerate(_P.lengths))}) as x(ord, n) where rvol20 >= {_P.rvol_min} and close_loc is not null and atr20 > 0 and rn > {_P.warmup}),
sides as ({_side(True)} union all {_side(False)}),
s1 as (select *, coalesce(c > e20, false) as t1, coalesce(e20 > e50, false) as t2, coalesce(e50 > e200, false) as t3, rng <= {_P.range_max} and comp <= {_P.atr_ratio_max} as based from sides),
s2 as (select *, t1 and t2 and t3 as strong, coalesce(l < sup and c > sup and turned and (c-sup)/atr >= {_P.reversal_atr_min}, false) as rev, coalesce(c > res and near and (c-res)/atr >= {_P.breakout_atr_min}, false) as broke from s1),
s3 as (select *, case when coalesce(based and rng <= {_P.tight_range} and comp <= {_P.tight_atr_ratio}, false) then n_vcp when t >= {_P.range_expansion_min} then n_exp when strong then n_trend when coalesce(based, false) then n_cons end as family,
  strong and coalesce(t >= 1.0 and (c-e20)/atr >= {_P.reversal_atr_min}, false) as cont, coalesce(t >= {_P.range_expansion_min} and near, false) as expd from s2),
s4 as (select *, case when rev then n_rev when broke and family is not null then family when cont then n_trend when expd then n_exp end as setup,
  case when rev then (c-sup)/atr when broke and family is not null then (c-res)/atr when cont then (c-e20)/atr when expd then t end as trig,
  greatest(case when rev then l-{_P.buffer_atr}*atr else coalesce(sup-{_P.buffer_atr}*atr, c-{_P.stop_atr}*atr) end, c-{_P.stop_atr}*atr) as stp from s3),
s5 as (select *, c-stp as risk, floor((0.20*least(greatest(50+35*trig, 0), 100)
  + 0.20*case when rvol20 <= 1 then 25 when rvol20 <= 1.5 then 25+(rvol20-1)*60 when rvol20 <= 2 then 55+(rvol20-1.5)*40 when rvol20 <= 2.5 then 75+(rvol20-2)*30 when rvol20 <= 3 then 90+(rvol20-2.5)*20 else 100 end
  + 0.15*case when rng is not null then least(greatest(100-100*rng/{_P.range_max}, 0), 100) else 50 end + 0.15*((case when t1 then 1 else 0 end+case when t2 then 1 else 0 end+case when t3 then 1 else 0 end)*100/3.0)
  + 0.10*case when comp is not null then least(greatest(300*(1-comp), 0), 100) else 50 end + 0.10*case when rs_spy_20 is null then 0 else least(greatest(50+s*1000*rs_spy_20, 0), 100) end
  + 0.10*case when regime like '%' || friend || '%' then 80 else 45 end)*10+0.5)/10 as score from s4 where setup is not null),
s6 as (select *, row_number() over (partition by ticker, date, direction order by score desc, ord) as k from s5 where risk > 0),
signals as (select q.ticker, q.date, q.direction, setup, score as setup_score, {half_up("q.rvol20", 2)} as rvol20, vol_accel, n as base_days, {half_up("trig", 2)} as breakout_atr, case when strong then 'Strong' else 'Mixed' end as trend,
  rng as base_range_pct, f.atr20_pct, risk/atr as risk_atr, f.dv20, close as entry, s*stp as stop, s*(c+{_P.target_r}*risk) as target, risk, q.regime, f.rn,
  coalesce({half_up("f.atr_comp", 3)}, 0.0) as atr_compression, f.trend20, f.trend50, f.trend200, f.rs_spy_20, f.tr_atr20, f.close_loc, f.gap_pct
  from s6 q join features f on q.ticker = f.ticker and q.date = f.date where k = 1)"""

QUALITY = """
q0 as (select *, coalesce((regime like 'Bullish%' and direction = 'Short') or (regime like 'Bearish%' and direction = 'Long'), false) as qc_counter,
  coalesce(vol_accel >= 10, false) or coalesce(rvol20 >= 10, false) as qc_volume, coalesce(breakout_atr >= 4, false) or coalesce(atr20_pct >= 0.08, false) or coalesce(risk_atr < 0.5, false) as qc_risk,
  concat_ws('; ', case when vol_accel >= 10 then 'EXTREME VOLUME ACCELERATION (>=10x prior day)' when vol_accel >= 5 then 'HIGH VOLUME ACCELERATION (>=5x prior day)' end, case when rvol20 >= 10 then 'EXTREME RVOL (>=10x 20-day average)' end,
    case when breakout_atr >= 4 then 'EXTENDED TRIGGER (>=4 ATR)' end, case when atr20_pct >= 0.08 then 'HIGH VOLATILITY (ATR20 >=8% of price)' end, case when risk_atr < 0.5 then 'TIGHT REFERENCE STOP (<0.5 ATR)' end,
    case when coalesce((regime like 'Bullish%' and direction = 'Short') or (regime like 'Bearish%' and direction = 'Long'), false) then 'COUNTERTREND VS SPY REGIME' end) as flags from signals),
quality as (select * exclude (flags), case when flags = '' then 'No automatic QC flags' else flags end as quality_flags, flags <> '' as qc_flagged,
  case when qc_volume then 'CHECK — unusual volume; verify raw data' when qc_risk then 'CHECK — extension / volatility / stop distance' when qc_counter then 'COUNTERTREND — verify market context' else 'STANDARD REVIEW — still research only' end as quality_status,
  case when qc_counter then 'Countertrend vs SPY' else 'Aligned / neutral vs SPY' end as market_context from q0)"""


def with_(*parts: str) -> str:
    return "with " + ",".join(parts) + "\n"


BASE = (BARS, BENCH, REGIME, FEATURES)
DENSE_BASE = (DENSE, BENCH, REGIME, FEATURES)
