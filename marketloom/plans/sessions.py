"""Queries over five-minute bars, each with its SQL. Bars are derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.exprs import half_up
from marketloom.operators import intraday as I
from marketloom.plans import sql as S
from marketloom.plans.daily import rounded
from marketloom.sources import fixtures

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, query, text: str | None = None) -> None:
    QUERIES[name] = lambda s, d: rounded(query(s, d))
    if text is not None:
        SQL[name] = text


def r6(*names: str) -> str:
    return ", ".join(f"{S.half_up(n, 6)} as {n}" for n in names)


prepared = lambda s, d: I.prepare(fixtures.bars5m(s, d))


def signals(s: SparkSession, d: str) -> DataFrame:
    """A signal for each ticker and session: Long where the session closed above its open."""
    x = prepared(s, d).groupBy("ticker", F.col("session").alias("date")).agg(F.max_by("close", "ts").alias("c"), F.min_by("open", "ts").alias("o"))
    return x.select("ticker", "date", F.when(F.col("c") >= F.col("o"), "Long").otherwise("Short").alias("direction"))


def confirmed(s: SparkSession, d: str) -> DataFrame:
    p = prepared(s, d)
    return I.confirmed(I.next_session(signals(s, d), p), I.quarter_hours(p))


triggered = lambda s, d: I.triggers(confirmed(s, d), prepared(s, d))
stopped = lambda s, d: I.with_stops(triggered(s, d))

_W = "(partition by ticker, session order by ts"
M5 = f"""
m5_d as (select cast(user_id % (select greatest(2, count(*)//750) from customer) as varchar) as ticker, cast(ts as date) as session, cast(floor((extract(hour from ts)*60+extract(minute from ts))*390/1440/5) as int) as slot,
  cast(sum(cast(round(ln(1+value)*1e6) as bigint)) as double)/(1e6*count(*)) as a, count(*) as n from events group by 1, 2, 3),
m5_c as (select *, session + to_minutes(570+slot*5) as ts, {S.half_up("100*exp(sum(0.004*(a-3.42)) over (partition by ticker order by session, slot rows unbounded preceding))", 4)} as close from m5_d),
m5_o as (select *, coalesce(lag(close) over (partition by ticker order by ts), 100.0) as open from m5_c),
m5 as (select ticker, ts, open, {S.half_up("greatest(open, close)*(1+0.0002*(n%7))", 4)} as high, {S.half_up("least(open, close)*(1-0.0002*(n%5))", 4)} as low, close, cast(n as double) as volume from m5_o),
p0 as (select *, cast(ts as date) as session, cast(extract(hour from ts)*60+extract(minute from ts)-570 as int) as minute, lag(close) over (partition by ticker order by ts) as pc from m5),
p1 as (select *, greatest(high-low, abs(high-pc), abs(low-pc)) as tr from p0 where minute between 0 and 389),
prep as (select *, sum((high+low+close)/3.0*volume) over {_W} rows unbounded preceding)/nullif(sum(volume) over {_W} rows unbounded preceding), 0) as vwap,
  case when count(tr) over {_W} rows 13 preceding) >= 5 then avg(tr) over {_W} rows 13 preceding) end as atr14,
  volume/nullif(case when count(volume) over (partition by ticker, minute order by session rows between 20 preceding and 1 preceding) >= 5 then avg(volume) over (partition by ticker, minute order by session rows between 20 preceding and 1 preceding) end, 0) as tod_rvol from p1)"""
B15 = "b15 as (select ticker, session, time_bucket(interval '15 minutes', ts) as start, min_by(open, ts) as open, max(high) as high, min(low) as low, max_by(close, ts) as close, sum(volume) as volume, max_by(vwap, ts) as vwap from prep group by 1, 2, 3)"
OPENING = f"orr as (select ticker, session, max(high) filter (where k <= 6) as or_high, min(low) filter (where k <= 6) as or_low, count(*) as bars, (max(high) filter (where k <= 6) + min(low) filter (where k <= 6))/2.0 as or_mid from (select *, row_number() over {_W}) as k from prep) q group by 1, 2)"
SIG = """sg as (select ticker, session as date, case when max_by(close, ts) >= min_by(open, ts) then 'Long' else 'Short' end as direction from prep group by 1, 2),
ns as (select g.ticker, g.date, any_value(g.direction) as direction, min(p.session) as trade_session from sg g join (select distinct ticker, session from prep) p on p.ticker = g.ticker and p.session > g.date group by 1, 2)"""
CONFIRMED = """cf as (select n.*, q.start as confirm_ts from ns n join (select *, row_number() over (partition by ticker, session order by start) as k from b15) q on q.ticker = n.ticker and q.session = n.trade_session and k = 2
  where case when direction = 'Long' then close > vwap and close > open else close < vwap and close < open end)"""
TRIGGERS = f"""dy as (select *, min(low) over {_W} rows between 6 preceding and 1 preceding) as low6, max(high) over {_W} rows between 6 preceding and 1 preceding) as high6, count(*) over {_W} rows between 6 preceding and 1 preceding) as seen,
  lag(close) over {_W}) as close1, min(low) over {_W} rows between 3 preceding and 1 preceding) as swing_low, max(high) over {_W} rows between 3 preceding and 1 preceding) as swing_high from prep),
cd as (select c.ticker, c.date, c.direction, c.trade_session, o.or_high, o.or_low, o.or_mid, d.* exclude (ticker, session), max(d.high) over w as high3, min(d.low) over w as low3, count(*) over w as k3 from cf c join orr o on o.ticker = c.ticker and o.session = c.trade_session and bars >= 12 and or_high > or_low
  join dy d on d.ticker = c.ticker and d.session = c.trade_session and d.ts > c.confirm_ts window w as (partition by c.ticker, c.date, c.direction order by d.ts rows between 3 preceding and 1 preceding)),
ru as (select *, case when direction = 'Long' then close > vwap else close < vwap end as v, case when direction = 'Long' then close > or_high else close < or_low end as r1, k3 = 3 and case when direction = 'Long' then close > high3 else close < low3 end as r2,
  seen = 6 and case when direction = 'Long' then low6 < or_low and close1 > or_mid and close > or_mid else high6 > or_high and close1 < or_mid and close < or_mid end as r3 from cd where minute <= 180 and tod_rvol >= 1.2),
tg as (select *, row_number() over (partition by ticker, date, direction, rule order by ts) as k from (select *, 'ORB_VWAP' as rule from ru where v and r1 union all select *, 'PULLBACK_VWAP' from ru where v and r2 union all select *, 'REVERSAL_VWAP' from ru where v and r3) q),
tr as (select ticker, date, direction, rule, trade_session, ts as trigger_ts, minute, close as entry, atr14 as atr, swing_low, swing_high from tg where k = 1)"""
STOPS = """st as (select *, case when direction = 'Long' then swing_low - 0.1*atr else swing_high + 0.1*atr end as stop from tr where atr > 0),
rs as (select *, case when direction = 'Long' then entry - stop else stop - entry end as risk from st where case when direction = 'Long' then entry - stop else stop - entry end > 0 and case when direction = 'Long' then entry - stop else stop - entry end <= 2.0*atr)"""
_ALL = (M5, B15, OPENING, SIG, CONFIRMED, TRIGGERS)
_MINUTE = f"hour(trigger_ts) * 60 + minute(trigger_ts) - {I.OPEN_MINUTE} as minute"

register("itd_01_session_minutes", lambda s, d: prepared(s, d).select("ticker", "session", "minute", "close"), S.with_(M5) + f"select ticker, session, minute, {r6('close')} from prep")
register("itd_02_vwap", lambda s, d: prepared(s, d).select("ticker", "session", "minute", "vwap"), S.with_(M5) + f"select ticker, session, minute, {r6('vwap')} from prep")
register("itd_03_session_atr", lambda s, d: prepared(s, d).select("ticker", "session", "minute", "tr", "atr14"), S.with_(M5) + f"select ticker, session, minute, {r6('tr', 'atr14')} from prep")
register("itd_04_time_of_day_volume", lambda s, d: prepared(s, d).select("ticker", "session", "minute", "tod_rvol"), S.with_(M5) + f"select ticker, session, minute, {r6('tod_rvol')} from prep")
register(
    "itd_05_quarter_hours", lambda s, d: I.quarter_hours(prepared(s, d)).withColumn("minute", F.hour("start") * 60 + F.minute("start") - I.OPEN_MINUTE).drop("start"),
    S.with_(M5, B15) + f"select ticker, session, cast(extract(hour from start)*60+extract(minute from start)-570 as int) as minute, {r6('open', 'high', 'low', 'close', 'volume', 'vwap')} from b15",
)
register("itd_06_opening_range", lambda s, d: I.opening_range(prepared(s, d)), S.with_(M5, OPENING) + f"select ticker, session, bars, {r6('or_high', 'or_low', 'or_mid')} from orr")
register("itd_07_next_session", lambda s, d: I.next_session(signals(s, d), prepared(s, d)), S.with_(M5, SIG) + "select ticker, date, direction, trade_session from ns")
register("itd_08_confirmation", lambda s, d: confirmed(s, d).drop("confirm_ts"), S.with_(M5, B15, SIG, CONFIRMED) + "select ticker, date, direction, trade_session from cf")
register("itd_09_triggers", lambda s, d: triggered(s, d).selectExpr("ticker", "date", "direction", "rule", "trade_session", _MINUTE, "entry"), S.with_(*_ALL) + f"select ticker, date, direction, rule, trade_session, minute, {r6('entry')} from tr")
register("itd_10_stops", lambda s, d: stopped(s, d).select("ticker", "date", "direction", "rule", "entry", "stop", "risk"), S.with_(*_ALL, STOPS) + f"select ticker, date, direction, rule, {r6('entry', 'stop', 'risk')} from rs")
register(
    "itd_11_same_day", lambda s, d: I.same_day(stopped(s, d), prepared(s, d)),
    S.with_(*_ALL, STOPS) + """, ev as (select r.ticker, r.date, r.direction, r.rule, t.target_r, p.ts, case when direction = 'Long' then p.high >= entry + target_r*risk else p.low <= entry - target_r*risk end as won, case when direction = 'Long' then p.low <= entry - risk else p.high >= entry + risk end as lost
  from rs r cross join (values (cast(1.0 as double)), (1.5), (2.0)) t(target_r) join prep p on p.ticker = r.ticker and p.session = r.trade_session and p.ts >= r.trigger_ts),
    ft as (select ticker, date, direction, rule, target_r, coalesce(min_by(case when won and lost then 'same_bar_ambiguous' when won then 'target' else 'stop' end, ts) filter (where won or lost), 'eod_timeout') as reason from ev group by 1, 2, 3, 4, 5)
    select ticker, date, direction, rule, target_r, cast(reason = 'target' as int) as outcome, reason from ft""",
)
register(
    "src_04_intraday_bars", lambda s, d: I.read_bars(fixtures.raw5m(s, d)).select("ticker", F.to_date("ts").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"), "close", "volume"),
    """with e as (select cast(user_id as varchar) as ticker, timezone('America/New_York', timezone('UTC', ts)) as t, case when user_id % 10 = 3 then null else value end as v from events)
    select ticker, cast(t as date) as day, cast(extract(hour from t)*60+extract(minute from t) as int) as minute, floor(v*1e6+0.5)/1e6 as close, 1.0::double as volume from e where v is not null""",
)
