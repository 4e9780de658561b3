"""Queries over trade variants, gaps, contraction patterns and small table steps, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import context
from marketloom.operators import mechanics as M
from marketloom.operators import outcomes as O
from marketloom.operators import statistics as A
from marketloom.operators.outcomes import calendar
from marketloom.plans import sql as S
from marketloom.plans.daily import features, historical, quality, rounded
from marketloom.plans.ledgers import _PROXY, SECTORS
from marketloom.plans.studies import _CAL, _DENSE, _FIXED, _SIG, _TOUCH, _UNIVERSE, _labels, ahead, dense, fixed, labelled
from marketloom.sources import cleaning as C
from marketloom.sources import fixtures
from marketloom.sources.staging import staged

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Named windows of the derived calendar.
WINDOWS = (("1993", "1993-01-01", "1993-12-31"), ("1994", "1994-01-01", "1994-12-31"), ("1995", "1995-01-01", "1995-12-31"), ("1996+", "1996-01-01", "1998-12-31"))
#: Beside the usual detectors one that the derived bars can meet.
DETECTORS = (*M.DETECTORS, M.Contraction("VCP_Wide", 15, 3, 1.3, 1.5, 1.1))


def register(name: str, query, text: str | None = None) -> None:
    QUERIES[name] = lambda s, d: rounded(query(s, d))
    if text is not None:
        SQL[name] = text


def r6(*names: str) -> str:
    return ", ".join(f"{S.half_up(n, 6)} as {n}" for n in names)


traded = lambda s, d: M.traded(ahead(s, d), None)
_VALUES = ", ".join(f"('{v.name}', '{v.kind}', {v.atr!r}, {v.guard!r})" for v in M.VARIANTS)
_TRADED = f"""{_TOUCH}
va as (select f.*, v.*, case when direction = 'Long' then 1 else -1 end as sg, atr20_pct*entry as atr from fw f cross join (values {_VALUES}) v(variant, kind, m, guard) where nxt is not null),
vb as (select *, case when kind = 'close' then entry else nxt end as px, case when kind = 'atr' then m*atr else abs(entry-stop) end as unit from va),
vc as (select *, sg*px as e, sg*case when kind = 'fixed' then stop else px - sg*unit end as st, sg*case when kind = 'fixed' then target else px + sg*2.0*unit end as tg, case when sg = 1 then bh else -bl end as hi, case when sg = 1 then bl else -bh end as lo from vb),
vd as (select ticker, date, direction, setup, variant, kind, guard, entry as close, nxt, e, st, tg, sg, min_by(case when hi >= tg and lo <= st then 'same_bar_ambiguous' when hi >= tg then 'target' else 'stop' end, k) filter (where hi >= tg or lo <= st) as touch from vc group by all),
ve as (select *, -sg*(nxt/close-1) as adverse_gap, case when kind = 'guard' and -sg*(nxt/close-1) > guard then 'gap_filtered' when e = st then 'zero_risk' when e >= tg then 'target_at_open' when e <= st then 'stop_at_open' else coalesce(touch, 'timeout') end as reason from vd),
traded as (select *, cast(reason in ('target', 'target_at_open') as int) as outcome, case when reason in ('target_at_open', 'stop_at_open') then (e-sg*close)/abs(e-st) when reason = 'target' then 2.0 when reason not in ('gap_filtered', 'zero_risk') then -1.0 end as realized_r from ve)"""
_MECH = "count(*) as rows, count(*) filter (where reason <> 'gap_filtered') as n, avg(outcome) filter (where reason <> 'gap_filtered') as success_rate, 3*avg(outcome) filter (where reason <> 'gap_filtered') - 1 as expectancy, avg(realized_r) filter (where reason <> 'gap_filtered') as mean_r, quantile_cont(realized_r, 0.5) filter (where reason <> 'gap_filtered') as median_r, count(*) filter (where reason = 'gap_filtered') as gap_filtered, avg(case when reason = 'gap_filtered' then 1.0 else 0.0 end) as gap_filtered_share, count(*) filter (where reason = 'timeout') as timeouts"
register("out_04_trade_variants", lambda s, d: traded(s, d).drop("regime"), S.with_(*_SIG, _TRADED) + f"select ticker, date, direction, setup, variant, outcome, reason, {r6('realized_r', 'adverse_gap')} from traded")
for _name, _by in {"agg_09_mechanics": "variant direction", "agg_09_mechanics_by_setup": "variant direction setup"}.items():
    register(
        _name, lambda s, d, by=tuple(_by.split()): M.mechanics_summary(traded(s, d), *by),
        S.with_(*_SIG, _TRADED, f"ms as (select {', '.join(_by.split())}, {_MECH} from traded group by {', '.join(_by.split())})") + f"select {', '.join(_by.split())}, rows, n, gap_filtered, timeouts, {r6('success_rate', 'expectancy', 'mean_r', 'median_r', 'gap_filtered_share')} from ms",
    )
register(
    "agg_10_robust_variants", lambda s, d: M.robust(traded(s, d), WINDOWS),
    S.with_(*_SIG, _TRADED, f"wl as (select *, case {' '.join(f'''when date between '{a}' and '{b}' then '{n}' ''' for n, a, b in WINDOWS)} end as win from traded)", f"wm as (select variant, direction, win, {_MECH} from wl where win is not null group by 1, 2, 3)", f"ov as (select variant, direction, {_MECH} from traded group by 1, 2)",
            "pw as (select variant, direction, count(*) filter (where mean_r > 0) as positive_windows, count(*) as windows from wm group by 1, 2)")
    + f"select o.variant, o.direction, coalesce(positive_windows, 0) as positive_windows, coalesce(windows, 0) as windows, {r6('success_rate', 'mean_r')}, coalesce(windows >= 3 and positive_windows >= 3 and success_rate > 1/3.0 and mean_r > 0, false) as survivor from ov o left join pw p on p.variant = o.variant and p.direction = o.direction",
)


def gaps(s: SparkSession, d: str) -> DataFrame:
    return M.entry_gaps(labelled(s, d, reanchor=True))


_GAPS = f"""{_labels(True)},
gp as (select s.ticker, s.date, s.direction, l.outcome, l.entry_actual/s.entry - 1 as gap_pct, case when s.direction = 'Long' then 1 else -1 end*(l.entry_actual-s.entry)/s.risk as signed_gap_r from signals s join labels l on l.ticker = s.ticker and l.date = s.date and l.direction = s.direction),
gaps as (select *, greatest(0.0, -signed_gap_r) as adverse_gap_r from gp)"""
register("out_03_entry_gaps", gaps, S.with_(*_SIG, _GAPS) + f"select ticker, date, direction, outcome, {r6('gap_pct', 'signed_gap_r', 'adverse_gap_r')} from gaps")
register(
    "agg_18_gap_guards", lambda s, d: M.gap_guards(gaps(s, d)),
    S.with_(*_SIG, _GAPS, "tt as (select direction, count(*) as total from gaps group by 1)") + f"select g.direction, u.guard, count(*) as n, {S.half_up('avg(outcome)', 6)} as success_rate, {S.half_up('3*avg(outcome)-1', 6)} as expectancy, any_value(t.total) - count(*) as excluded from gaps g join tt t using (direction) cross join (values (null::double), (0.25), (0.5), (0.75), (1.0), (1.5)) u(guard) where u.guard is null or adverse_gap_r <= u.guard group by 1, 2",
)


def _contraction_sql(rules: tuple[M.Contraction, ...]) -> str:
    cols = []
    for base, phases in sorted({(r.base, r.phases) for r in rules}):
        chunk = base // phases
        for j in range(phases):
            w = f"over (partition by ticker order by date rows between {base - j * chunk} preceding and {base - (j + 1) * chunk + 1} preceding)"
            cols += [f"(max(high) {w} - min(low) {w})/avg(close) {w} as r_{base}_{phases}_{j}", f"avg(volume) {w} as v_{base}_{phases}_{j}"]
    picks = []
    for r in rules:
        calm = " and ".join([f"shrink <= {r.atr_ratio!r}", *(f"{c}_{r.base}_{r.phases}_{j + 1} <= {c}_{r.base}_{r.phases}_{j}*{d!r}" for c, d in (("r", r.range_decay), ("v", r.volume_decay)) for j in range(r.phases - 1))])
        for name, move, placed in (("Long", f"(close-hh_{r.base})/atr20", "close_loc >= 0.65"), ("Short", f"(ll_{r.base}-close)/atr20", "close_loc <= 0.35")):
            picks.append(f"select ticker, date, '{name}' as direction, '{r.name}' as rule, {move} as breakout_atr, 1-shrink as atr_compression, rn, atr20 from vw where {calm} and {move} > 0 and {move} >= {r.breakout!r} and {placed}")
    return f"vw0 as (select *, atr10/nullif(atr40, 0) as shrink, {', '.join(cols)} from features), vw as (select * from vw0 where rn > 220 and rvol20 >= 1.2 and atr20 > 0 and close_loc is not null), vcp as ({' union all '.join(picks)})"


for _name, _rules in {"sig_14_contractions": DETECTORS, "sig_15_contraction_rules": M.RULE_GRID}.items():
    register(
        _name, lambda s, d, r=_rules: M.contractions(features(s, d), r).select("ticker", "date", "direction", "rule", "breakout_atr", "atr_compression"),
        S.with_(*S.BASE, _contraction_sql(_rules)) + f"select ticker, date, direction, rule, {r6('breakout_atr', 'atr_compression')} from vcp",
    )

_CUT = f"{_CAL}, nn as (select count(*) as n from cal)"
register(
    "prt_03_calendar_cut", lambda s, d: A.calendar_partitions(dense(s, d)[0], calendar(fixtures.bench(s, d))).select("ticker", "date", "direction", "partition"),
    S.with_(*_DENSE, _CUT) + "select ticker, q.date, direction, case when pos < floor(0.6*n) then 'Train' when pos < floor(0.8*n) then 'Validation' else 'Holdout' end as partition from quality q join cal c on c.date = q.date cross join nn",
)
register(
    "prt_04_purged", lambda s, d: A.purged(fixed(s, d).where("status = 'complete'"), calendar(fixtures.bench(s, d))).select("ticker", "date", "direction", "horizon", "partition"),
    S.with_(*_DENSE, _FIXED, "nn as (select count(*) as n from cal)") + """, pz as (select f.ticker, f.date, f.direction, f.horizon, case when f.pos < floor(0.6*n) then 'Train' when f.pos < floor(0.8*n) then 'Validation' else 'Holdout' end as partition,
    case when f.pos+f.horizon < floor(0.6*n) then 'Train' when f.pos+f.horizon < floor(0.8*n) then 'Validation' else 'Holdout' end as ends from fx f cross join nn where status = 'complete') select ticker, date, direction, horizon, partition from pz where partition = ends""",
)
register(
    "prt_06_folds", lambda s, d: A.time_folds(staged(historical(s, d).select("ticker", "date", "direction"), "signals"), 5, ("ticker", "direction")).select("ticker", "date", "direction", "fold"),
    S.with_(*_SIG) + "select ticker, date, direction, cast(case when p0 >= n - 5*ts then (p0 - (n - 5*ts))//ts end as int) as fold from (select *, row_number() over (order by date, ticker, direction) - 1 as p0, count(*) over () as n, count(*) over ()//6 as ts from signals) q",
)

_RAW = """rawb as (select ticker, cast(date as varchar) || ' 16:00:00' as stamp, case when ticker = '3' then 'n/a' else cast(close as varchar) end as close, open, high, low, case when ticker = '5' then -volume else volume end as volume, 1 as seq from bars
  union all select ticker, cast(date as varchar), cast(close*1.01 as varchar), open, high, low, volume, 2 from bars where ticker = '7')"""
register(
    "flt_06_clean_bars", lambda s, d: C.clean_bars(fixtures.dirty_bars(s, d), "seq"),
    S.with_(S.BARS, _RAW) + f", cl as (select ticker, cast(substr(stamp, 1, 10) as date) as date, open, high, low, try_cast(close as double) as close, volume, row_number() over (partition by ticker, substr(stamp, 1, 10) order by seq desc) as k from rawb) select ticker, date, {r6('open', 'high', 'low', 'close', 'volume')} from cl where k = 1 and close > 0 and open > 0 and high > 0 and low > 0 and volume >= 0",
)
register("flt_05_keep_list", lambda s, d: C.keep_existing(fixtures.universe(s, d), ("symbol", "security_name", "market_category", "etf", "financial_status")), f"with {_UNIVERSE} select symbol, security_name, etf from u")
register(
    "flt_13_prepared_signals", lambda s, d: C.prepared_signals(historical(s, d)).select("ticker", "date", "direction", "close_signal", "atr20", "risk_per_share"),
    S.with_(*_SIG) + f"select ticker, date, direction, {S.half_up('entry', 6)} as close_signal, {S.half_up('atr20_pct*entry', 6)} as atr20, {S.half_up('abs(entry-stop)', 6)} as risk_per_share from signals where abs(entry-stop) > 0",
)
register(
    "flt_14_published", lambda s, d: C.published(quality(s, d)).select("ticker", "date", "direction", "SignalClose", "ResearchStatus"),
    S.with_(*_SIG) + f"select ticker, date, direction, {S.half_up('entry', 6)} as \"SignalClose\", 'Research only' as \"ResearchStatus\" from signals",
)
register(
    "flt_15_repaired_booleans", lambda s, d: C.repaired_booleans(quality(s, d).select("ticker", "date", "direction", F.when(F.col("qc_flagged"), " Yes ").when(F.col("qc_counter"), "1").alias("qc_flagged")), ("qc_flagged", "qc_volume")),
    S.with_(*_SIG, S.QUALITY) + "select ticker, date, direction, qc_flagged, false as qc_volume from quality",
)
register(
    "src_02_wide_bars", lambda s, d: C.long_bars(fixtures.wide_bars(s, d)),
    S.with_(S.WIDE) + f"select ticker, date, {r6('open', 'high', 'low', 'close', 'volume')} from bars",
)
register(
    "top_01_stable_order", lambda s, d: staged(quality(s, d).select("ticker", "date", "direction", "setup_score"), "signals").orderBy("direction", F.desc("setup_score"), "ticker", "date"),
    S.with_(*_SIG) + f"select ticker, date, direction, {r6('setup_score')} from signals order by direction, setup_score desc, ticker, date",
)
register(
    "top_06_latest_rows", lambda s, d: fixed(s, d).where("status = 'complete'").orderBy(F.desc("date"), "ticker", "direction", "horizon").limit(30).select("ticker", "date", "direction", "horizon", "gross"),
    S.with_(*_DENSE, _FIXED) + f"select ticker, date, direction, horizon, {r6('gross')} from fx where status = 'complete' order by date desc, ticker, direction, horizon limit 30",
)


def chunks(s: SparkSession, d: str) -> DataFrame:
    """Long and short signals found apart and put together again."""
    # read twice, so computed once
    found = staged(historical(s, d).select("ticker", "date", "direction", "setup"), "signals")
    return found.where("direction = 'Long'").unionByName(found.where("direction = 'Short'"))


register("set_01_union", chunks, S.with_(*_SIG) + "select ticker, date, direction, setup from signals")
register(
    "set_04_date_indexes", lambda s, d: context.date_indexes(fixtures.dense_bars(s, d).where("ticker = '1'"), fixtures.dense_bars(s, d).where("ticker = '2'")),
    S.with_(S.DENSE) + "select date, bool_or(ticker = '1') and bool_or(ticker = '2') as in_both from bars where ticker in ('1', '2') group by 1",
)
register(
    "ctx_02_benchmark_context", lambda s, d: context.benchmark_context(fixtures.bench(s, d), fixtures.bench_multi(s, d), "S1", "S2"),
    S.with_(S.BENCH, S.SECTORS) + """, b0 as (select *, lag(close) over (order by date) as pc, row_number() over (order by date) as rn from bench), b1 as (select *, greatest(high-low, abs(high-pc), abs(low-pc)) as t from b0),
    b2 as (select *, case when count(t) over (order by date rows 19 preceding) = 20 then avg(t) over (order by date rows 19 preceding) end as atr20 from b1),
    b3 as (select date, close/pc - 1 as spy_ret1, close/lag(close, 5) over (order by date) - 1 as spy_ret5, close/lag(close, 20) over (order by date) - 1 as spy_ret20, atr20/close as spy_atr20_pct, case when pc is not null then t end/nullif(atr20, 0) as spy_tr_atr20 from b2),
    q as (select date, close/lag(close, 5) over (order by date) - 1 as qqq_ret5, close/lag(close, 20) over (order by date) - 1 as qqq_ret20 from sectors where ticker = 'S1'), i as (select date, close/lag(close, 20) over (order by date) - 1 as iwm_ret20 from sectors where ticker = 'S2'),
    j as (select * from b3 full join q using (date) full join i using (date)) select date, """ + r6("spy_ret1", "spy_ret5", "spy_ret20", "spy_atr20_pct", "spy_tr_atr20", "qqq_ret5", "qqq_ret20", "iwm_ret20") + " from j",
)
_STRENGTH = f"""{_PROXY}, sx as (select ticker as sector, date, close/lag(close, 20) over (partition by ticker order by date) - 1 as ret20 from sectors),
tk as (select ticker, date, close/lag(close, 20) over (partition by ticker order by date) - 1 as own20 from bars),
ss as (select p.ticker, p.date, p.sector, x.ret20 as sector_ret20, t.own20 - x.ret20 as rs_sector_20 from pb p left join sx x on x.sector = p.sector and x.date = p.date left join tk t on t.ticker = p.ticker and t.date = p.date where k = 1),
sr2 as (select s.ticker, s.date, count(*) filter (where y.ret20 <= s.sector_ret20)/count(y.ret20) as rank_pct from ss s join sx y on y.date = s.date and y.ret20 is not null where s.sector_ret20 is not null group by 1, 2)"""
strength = lambda s, d: context.sector_strength(context.sector_proxy(fixtures.dense_bars(s, d), fixtures.bench_multi(s, d), SECTORS), fixtures.dense_bars(s, d), fixtures.bench_multi(s, d))
register(
    "ctx_06_sector_strength", strength,
    S.with_(S.DENSE, S.SECTORS, _STRENGTH) + f"select s.ticker, s.date, s.sector, {r6('sector_ret20', 'rs_sector_20')}, {S.half_up('rank_pct', 6)} as sector_rank_pct from ss s left join sr2 r on r.ticker = s.ticker and r.date = s.date",
)
register(
    "joi_03_sector_context", lambda s, d: dense(s, d)[0].select("ticker", "date", "direction").join(strength(s, d).select("ticker", "date", "sector").hint("merge"), ["ticker", "date"], "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown"))),
    S.with_(*_DENSE, S.SECTORS, _PROXY) + "select q.ticker, q.date, q.direction, coalesce(p.sector, 'Unknown') as sector from quality q left join pb p on p.ticker = q.ticker and p.date = q.date and p.k = 1",
)
register(
    "joi_10_symbol_map", lambda s, d: C.mapped_symbols(historical(s, d).select("ticker", "date", "direction"), fixtures.market_caps(s, d).where("fast_cap is not null").select(F.col("symbol").alias("ticker"), F.concat(F.lit("Y-"), "symbol").alias("yahoo_symbol"))),
    S.with_(*_SIG) + "select ticker, date, direction, coalesce(case when s_suppkey is not null then 'Y-' || ticker end, ticker) as yahoo_symbol from signals left join (select s_suppkey from supplier where s_suppkey % 3 <> 0) m on cast(s_suppkey as varchar) = ticker",
)
_LED3 = """sb as (select q.ticker, q.date, q.direction, case when b.close is null then case when l.last_bar is null or l.last_bar < q.date then 'pending' else 'invalid: no ticker bar on signal date' end
  when q.claimed > 0 and abs(b.close/q.claimed - 1) > 0.005 then 'invalid: signal close mismatch >0.5%' else 'valid' end as signal_bar_status
  from (select *, case when date_part('day', date) = 3 then entry*1.01 else entry end as claimed from quality) q left join (select * from bars where date_part('day', date) <> 7 and date <= date '1998-06-30') b on b.ticker = q.ticker and b.date = q.date left join (select ticker, max(date) as last_bar from bars where date_part('day', date) <> 7 and date <= date '1998-06-30' group by 1) l on l.ticker = q.ticker)"""


def signal_bars(s: SparkSession, d: str) -> DataFrame:
    """Signals against bars of which some days are missing, the last weeks have not come yet, and some closes differ."""
    from marketloom.operators import ledger

    found, bars, _ = dense(s, d)
    claimed = F.when(F.dayofmonth("date") == 3, F.col("entry") * 1.01).otherwise(F.col("entry"))
    return ledger.signal_bar_status(found.withColumn("signal_close", claimed), bars.where("dayofmonth(date) != 7 and date <= '1998-06-30'")).select("ticker", "date", "direction", "signal_bar_status")


register("led_03_signal_bars", signal_bars, S.with_(*_DENSE) + ", " + _LED3 + " select ticker, date, direction, signal_bar_status from sb")
