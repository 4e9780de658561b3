"""Queries over the ledger and market context, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import context, ledger
from marketloom.operators import outcomes as O
from marketloom.plans import sql as S
from marketloom.plans.daily import features, rounded
from marketloom.plans.studies import _DENSE, _FIXED, dense, fixed
from marketloom.sources import fixtures

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The day on which the ledger was first run.
DAY = "1997-06-30"
SECTORS = [f"S{i}" for i in range(5)]


def register(name: str, query, text: str | None = None) -> None:
    QUERIES[name] = lambda s, d: rounded(query(s, d))
    if text is not None:
        SQL[name] = text


def two_runs(s: SparkSession, d: str) -> DataFrame:
    """Outcomes after a run on the bars up to DAY and another on all bars; equal to one pass over all bars."""
    signals, bars, bench = dense(s, d)
    upto = lambda x: x.where(F.col("date") <= DAY)
    early = O.fixed_horizon(upto(signals), upto(bars), upto(bench))
    return ledger.mature(early, O.fixed_horizon(signals, bars, bench))


_COLUMNS = "ticker date direction horizon status".split()
register("led_04_maturing_outcomes", lambda s, d: two_runs(s, d).select(*_COLUMNS, "gross"), S.with_(*_DENSE, _FIXED) + "select ticker, date, direction, horizon, status, floor(gross*1e6+0.5)/1e6 as gross from fx")
register(
    "led_05_tracking_status", lambda s, d: ledger.tracking_status(fixed(s, d)),
    S.with_(*_DENSE, _FIXED) + "select date, ticker, direction, case when count(*) filter (where status = 'complete') = count(*) then 'complete' when count(*) filter (where status = 'complete') > 0 then 'partial' when count(*) filter (where status like 'pending%') > 0 then 'pending' else 'invalid' end as tracking_status, count(*) filter (where status = 'complete') as complete_horizons from fx group by 1, 2, 3",
)
register(
    "led_06_refresh_set", lambda s, d: ledger.refresh_set(fixed(s, d), dense(s, d)[0].where(F.col("date") > DAY)),
    S.with_(*_DENSE, _FIXED) + f"select ticker from fx where status <> 'complete' union select ticker from quality where date > date '{DAY}'",
)


def inserted(s: SparkSession, d: str) -> DataFrame:
    signals = dense(s, d)[0]
    first = ledger.insert(None, signals.where(F.col("date") <= DAY))
    return ledger.insert(first, signals)


register(
    "led_02_insert", lambda s, d: inserted(s, d).select("ticker", "date", "direction", "signal_rank"),
    S.with_(*_DENSE) + "select ticker, date, direction, row_number() over (partition by date, direction order by setup_score desc, ticker) as signal_rank from quality",
)
register(
    "led_01_admission", lambda s, d: ledger.admission(dense(s, d)[0].where(F.col("date") == DAY), fixtures.bench(s, d)),
    S.with_(*_DENSE) + f"select max(date) as signal_date, count(distinct date) = 1 and max(date) = (select max(date) from bench) as admitted, case when count(distinct date) <> 1 then 'snapshot does not hold exactly one signal date' when max(date) not in (select date from bench) then 'signal date is not in the market calendar' when max(date) <> (select max(date) from bench) then 'signal date is not the latest market date' else 'ok' end as reason from quality where date = date '{DAY}'",
)
_O = "over (partition by ticker order by date)"
_BREADTH = f"br as (select *, close/lag(close, 5) {_O} - 1 as ret5 from features)"
register(
    "ctx_01_breadth", lambda s, d: context.breadth(features(s, d)),
    S.with_(*S.BASE, _BREADTH) + "select date, count(*) as active, " + ", ".join(f"floor(count(*) filter (where close > ema{n})/nullif(count(ema{n}), 0)*1e6+0.5)/1e6 as above_ema{n}" for n in (20, 50, 200))
    + ", floor(count(*) filter (where ret5 > 0)/nullif(count(ret5), 0)*1e6+0.5)/1e6 as positive5, floor(count(*) filter (where ret20 > 0)/nullif(count(ret20), 0)*1e6+0.5)/1e6 as positive20, floor(quantile_cont(ret20, 0.5)*1e6+0.5)/1e6 as median_ret20, floor(stddev_samp(ret20)*1e6+0.5)/1e6 as std_ret20, floor(sum(volume) filter (where close > prev_close)/nullif(sum(volume) filter (where close < prev_close), 0)*1e6+0.5)/1e6 as up_down_volume from br group by 1",
)
_SECT = "sx as (select *, close/lag(close, 20) over (partition by ticker order by date) - 1 as ret20 from sectors)"
register(
    "ctx_04_sector_cross_section", lambda s, d: context.sector_cross_section(fixtures.bench_multi(s, d)),
    S.with_(S.SECTORS, _SECT) + "select date, floor(avg(case when ret20 > 0 then 1.0 else 0.0 end)*1e6+0.5)/1e6 as positive, floor(stddev_samp(ret20)*1e6+0.5)/1e6 as std_ret20, floor(quantile_cont(ret20, 0.5)*1e6+0.5)/1e6 as median_ret20, floor(max(ret20)*1e6+0.5)/1e6 as max_ret20, floor(min(ret20)*1e6+0.5)/1e6 as min_ret20 from sx group by 1",
)
register(
    "ctx_03_level_percentile", lambda s, d: context.level_percentile(fixtures.bench(s, d).withColumn("v", F.col("high") - F.col("low")), "v"),
    S.with_(S.BENCH) + ", v as (select date, high-low as level, row_number() over (order by date) as rn from bench) select a.date, floor(any_value(a.level)*1e6+0.5)/1e6 as level, case when count(*) >= 60 then floor(count(*) filter (where b.level <= a.level)/count(*)*1e6+0.5)/1e6 end as percentile from v a join v b on b.rn between a.rn - 251 and a.rn group by a.date",
)
_PROXY = f"""sr as (select date, {", ".join(f"max(r) filter (where ticker = '{x}') as {x}" for x in SECTORS)} from (select ticker, date, close/lag(close) {_O} - 1 as r from sectors) q group by 1),
px as (select b.ticker, b.date, b.r, s.* exclude (date) from (select ticker, date, close/lag(close) {_O} - 1 as r from bars) b join sr s using (date) where {" and ".join(f"{x} is not null" for x in SECTORS)}),
pc as (select ticker, date, count(r) over w as n, {", ".join(f"corr(r, {x}) over w as c{i}" for i, x in enumerate(SECTORS))} from px window w as (partition by ticker order by date rows 59 preceding)),
pl as (select ticker, date, n, x.i, x.sector, x.c from pc, lateral (values {", ".join(f"({i}, '{x}', c{i})" for i, x in enumerate(SECTORS))}) x(i, sector, c)),
pb as (select *, row_number() over (partition by ticker, date order by c desc nulls last, i) as k from pl where n >= 40)"""
register(
    "ctx_05_sector_proxy", lambda s, d: context.sector_proxy(fixtures.dense_bars(s, d), fixtures.bench_multi(s, d), SECTORS),
    S.with_(S.DENSE, S.SECTORS, _PROXY) + "select ticker, date, sector, floor(c*1e6+0.5)/1e6 as correlation from pb where k = 1",
)
register("joi_02_breadth_context", lambda s, d: dense(s, d)[0].select("ticker", "date", "direction").join(F.broadcast(context.breadth(features(s, d)).select("date", "active")), "date", "left"), S.with_(*_DENSE) + ", act as (select cast(l_shipdate as date) as date, count(distinct l_suppkey) as active from lineitem group by 1) select ticker, date, direction, active from quality left join act using (date)")
register("set_03_symbol_difference", lambda s, d: fixtures.market_caps(s, d).select("symbol").join(fixtures.dense_bars(s, d).select(F.col("ticker").alias("symbol")).distinct(), "symbol", "left_anti"), S.with_(S.DENSE) + "select cast(s_suppkey as varchar) as symbol from supplier where cast(s_suppkey as varchar) not in (select ticker from bars)")

