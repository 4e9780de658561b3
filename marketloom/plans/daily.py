"""Queries over daily bars: indicators, panel and signals, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.exprs import half_up
from marketloom.operators import indicators, signals
from marketloom.plans import sql as S
from marketloom.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Digits to which floating results are rounded on both sides.
DIGITS = 6
#: Liquidity threshold that suits the derived bars.
MIN_DOLLAR_VOLUME = 2000.0


def features(spark: SparkSession, sf_dir: str, tickers: int | None = None) -> DataFrame:
    return indicators.features(fixtures.bars(spark, sf_dir, tickers), fixtures.bench(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str, tickers: int | None = None) -> DataFrame:
    return indicators.panel(fixtures.bars(spark, sf_dir, tickers), fixtures.bench(spark, sf_dir))


def historical(spark: SparkSession, sf_dir: str, tickers: int | None = None) -> DataFrame:
    return signals.historical(features(spark, sf_dir, tickers))


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """All doubles rounded half up."""
    return df.select(*(half_up(F.col(n), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def sql_columns(columns: str | list[str], texts: tuple[str, ...] = ()) -> str:
    """Select list with all but the named columns rounded like rounded()."""
    names = columns.split() if isinstance(columns, str) else columns
    return ", ".join(n if n in texts else f"{S.half_up(n, DIGITS)} as {n}" for n in names)


TEXTS = (
    "ticker", "date", "direction", "setup", "trend", "regime", "base_days", "rn", "quality_flags", "quality_status", "market_context", "qc_flagged", "qc_volume", "qc_risk", "qc_counter", "top_quintile", "bottom_quintile",
    "fwd_exit_1", "fwd_exit_3", "fwd_exit_5", "fwd_exit_10",
)


def register(name: str, query: Query, text: str | None) -> None:
    QUERIES[name] = query
    if text is not None:
        SQL[name] = text


def _columns(name: str, source: Query, columns: str, parts: tuple[str, ...], table: str) -> None:
    names = ["ticker", "date", *columns.split()]
    register(name, lambda s, d: rounded(source(s, d).select(*names)), S.with_(*parts) + f"select {sql_columns(names, TEXTS)} from {table}")


_ranges = " ".join(f"hh_{n} ll_{n} rng_{n}" for n in indicators.RANGE_LENGTHS)
for _name, _cols in {
    "ind_01_ema": "ema20 ema50 ema200", "ind_02_true_range": "tr", "ind_03_atr": "atr10 atr20 atr40", "ind_04_rvol": "rvol20", "ind_05_volume_acceleration": "vol_accel", "ind_06_dollar_volume": "dv20",
    "ind_07_location": "tr_atr20 close_loc atr_comp", "ind_08_trend": "trend20 trend50 trend200", "ind_09_return_gap": "ret20 gap_pct", "ind_10_relative_strength": "rs_spy_20", "ind_11_ranges": _ranges, "ind_13_regime_on_bars": "regime",
}.items():
    _columns(_name, features, _cols, S.BASE, "features")
for _name, _cols in {
    "ind_14_returns": "ret_1 ret_3 ret_5 ret_10 ret_20 ret_60 ret_120 ret_252 excess_1 excess_3 excess_5 excess_10 excess_20 excess_60", "ind_15_ema_distance": "ema_dist_20 ema_dist_50 ema_dist_200 ema_slope20_5 ema_slope50_10",
    "ind_16_volatility": "atr20_pct atr10_pct vol10 vol20 volume_trend5_20 dv20_log", "ind_17_extremes": "dist_high20 dist_high60 dist_low20 dist_low60 dist_high252 close_loc20 close_loc60", "ind_18_intraday": "intraday_ret tr_pct",
    "ind_19_forward": "fwd_ret_1 fwd_ret_3 fwd_ret_5 fwd_ret_10 fwd_excess_1 fwd_excess_3 fwd_excess_5 fwd_excess_10 fwd_exit_1 fwd_exit_3 fwd_exit_5 fwd_exit_10", "ind_20_risk_adjusted": "target_risk_adj5 risk_adj_mom20 risk_adj_mom60 raw_mom20",
}.items():
    _columns(_name, panel, _cols, (*S.BASE, S.PANEL), "panel")
register("ind_12_regime", lambda s, d: indicators.regime(fixtures.bench(s, d)), S.with_(S.BENCH, S.REGIME) + "select date, regime from regime")
register(
    "ind_21_quintiles", lambda s, d: rounded(indicators.quintile_labels(panel(s, d).where("rn > 220").select("ticker", "date", "fwd_excess_5")).select("ticker", "date", "pct_rank", "top_quintile", "bottom_quintile")),
    S.with_(*S.BASE, S.PANEL) + """, e as (select ticker, date, fwd_excess_5 as v from panel where rn > 220), r as (select ticker, date, case when v is not null then (rank() over (partition by date order by v nulls last)
    + (count(*) over (partition by date, v) - 1)/2.0)/count(v) over (partition by date) end as pct_rank from e)
    select ticker, date, floor(pct_rank*1e6+0.5)/1e6 as pct_rank, case when pct_rank is not null then cast(pct_rank >= 0.8 as int) end as top_quintile, case when pct_rank is not null then cast(pct_rank <= 0.2 as int) end as bottom_quintile from r""",
)
_SIGNAL = "direction setup setup_score rvol20 vol_accel base_days breakout_atr trend base_range_pct atr20_pct risk_atr dv20 entry stop target risk regime"
_columns("sig_08_historical", historical, _SIGNAL, (*S.BASE, S.SIGNALS), "signals")
for _name, _where in {"sig_02_long_setups": "direction = 'Long'", "sig_03_short_setups": "direction = 'Short'"}.items():
    register(_name, lambda s, d, w=_where: rounded(historical(s, d).where(w).select("ticker", "date", "setup", "breakout_atr")), S.with_(*S.BASE, S.SIGNALS) + f"select {sql_columns('ticker date setup breakout_atr', TEXTS)} from signals where {_where}")
_columns("sig_04_levels", historical, "direction entry stop target risk risk_atr", (*S.BASE, S.SIGNALS), "signals")
_columns("sig_05_score", historical, "direction setup_score", (*S.BASE, S.SIGNALS), "signals")
_columns("sig_07_best_length", historical, "direction base_days base_range_pct", (*S.BASE, S.SIGNALS), "signals")
_QC = "direction quality_flags quality_status market_context qc_flagged qc_volume qc_risk qc_counter"
quality = lambda s, d: signals.quality(historical(s, d))
_columns("sig_10_quality_flags", quality, "direction quality_flags", (*S.BASE, S.SIGNALS, S.QUALITY), "quality")
_columns("sig_11_quality_status", quality, "direction quality_status market_context", (*S.BASE, S.SIGNALS, S.QUALITY), "quality")
_columns("sig_12_quality_booleans", quality, "direction qc_flagged qc_volume qc_risk qc_counter", (*S.BASE, S.SIGNALS, S.QUALITY), "quality")
register(
    "sig_01_volume_score", lambda s, d: rounded(features(s, d).where("rvol20 is not null").select("ticker", "date", signals.volume_score(F.col("rvol20")).alias("volume_score"))),
    S.with_(*S.BASE) + "select ticker, date, floor((case when rvol20 <= 1 then 25 when rvol20 <= 1.5 then 25+(rvol20-1)*60 when rvol20 <= 2 then 55+(rvol20-1.5)*40 when rvol20 <= 2.5 then 75+(rvol20-2)*30 when rvol20 <= 3 then 90+(rvol20-2.5)*20 else 100 end)*1e6+0.5)/1e6 as volume_score from features where rvol20 is not null",
)
register(
    "sig_06_why", lambda s, d: historical(s, d).select("ticker", "date", "direction", "why"),
    S.with_(*S.BASE, S.SIGNALS) + "select q.ticker, q.date, q.direction, n || 'd setup + ' || floor(q.rvol20*10+0.5)/10 || 'x RVOL + trigger ' || floor(trig*10+0.5)/10 || ' ATR + ' || lower(case when strong then 'Strong' else 'Mixed' end) || ' trend' as why from s6 q where k = 1",
)
register(
    "sig_13_ledger_booleans", lambda s, d: signals.reparsed_quality(quality(s, d)).select("ticker", "date", "direction", "ledger_flagged", "ledger_volume", "ledger_counter"),
    S.with_(*S.BASE, S.SIGNALS, S.QUALITY) + "select ticker, date, direction, quality_flags <> 'No automatic QC flags' as ledger_flagged, upper(quality_flags) like '%VOLUME%' and (upper(quality_flags) like '%HIGH%' or upper(quality_flags) like '%EXTREME%') as ledger_volume, upper(quality_flags) like '%COUNTERTREND%' as ledger_counter from quality",
)
register("sig_16_candidate_id", lambda s, d: signals.with_ids(historical(s, d)).select("candidate_id", "setup"), S.with_(*S.BASE, S.SIGNALS) + "select cast(date as varchar) || '|' || ticker || '|' || direction as candidate_id, setup from signals")


def latest(s: SparkSession, d: str, top: int | None = None) -> DataFrame:
    return signals.ranked(signals.quality(signals.latest(features(s, d), min_dollar_volume=MIN_DOLLAR_VOLUME)), top)


_LAST = f", latest as (select *, row_number() over (partition by direction order by setup_score desc, ticker) as signal_rank from quality q where date = (select max(b.date) from bars b where b.ticker = q.ticker) and dv20 >= {MIN_DOLLAR_VOLUME})"
_LATEST = "ticker date direction setup setup_score rvol20 base_days breakout_atr entry stop target regime quality_status signal_rank"
for _name, _top, _cols in (("sig_09_latest_scan", None, _LATEST), ("top_02_top40", 40, _LATEST), ("top_03_signal_rank", None, "ticker date direction setup_score signal_rank")):
    register(
        _name, lambda s, d, top=_top, cols=tuple(_cols.split()): rounded(latest(s, d, top).select(*cols)),
        S.with_(*S.BASE, S.SIGNALS, S.QUALITY) + _LAST + f" select {sql_columns(_cols, (*TEXTS, 'signal_rank'))} from latest" + (f" where signal_rank <= {_top}" if _top else ""),
    )
