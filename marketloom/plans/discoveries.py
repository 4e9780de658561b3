"""Queries over discovered rules, their confirmation and frozen candidates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import discovery as D
from marketloom.operators import mechanics as M
from marketloom.operators import outcomes as O
from marketloom.operators import statistics as A
from marketloom.plans import sql as S
from marketloom.plans.daily import features, rounded
from marketloom.plans.studies import _SIG, _TOUCH, _parts, ahead
from marketloom.plans.variants import _contraction_sql, r6
from marketloom.sources.staging import staged

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, query, text: str) -> None:
    QUERIES[name] = lambda s, d: rounded(query(s, d))
    SQL[name] = text


def featured(s: SparkSession, d: str) -> DataFrame:
    """First touches of every signal's levels, with its features."""
    found = staged(ahead(s, d, max(D.SESSIONS)), "signals")
    return D.with_signal_features(D.touches(found, None), found)


def _level(kind: str, t: float) -> str:
    low, high = f"bl <= nxt - {t}*risk", f"bh >= nxt + {t}*risk"
    return f"case when direction = 'Long' then {high if kind == 'target' else low} else {low if kind == 'target' else high} end"


def _touches(name: str, source: str, keys: str, targets: tuple[float, ...]) -> str:
    cols = ", ".join(f"min(k) filter (where {_level('target', t)}) as t{i}" for i, t in enumerate(targets))
    return f"{name} as (select {keys}, min(k) filter (where {_level('stop', 1.0)}) as stop_k, {cols} from {source} where risk > 0 and nxt is not null group by all)"


def _won(i: int, h: object) -> str:
    return f"coalesce(t{i} <= {h} and (stop_k is null or t{i} < stop_k), false)"


def _bins(edges: dict[str, tuple[float, ...]], source: str) -> str:
    case = lambda f, e: "case " + " ".join(f"when {f} > {a!r} and {f} <= {b!r} then {i}" for i, (a, b) in enumerate(zip(e, e[1:], strict=False))) + " end"
    return "db as (" + " union all ".join(f"select l.*, '{f}' as feature, {case(f, e)} as bin from {source} l" for f, e in edges.items()) + ")"


_KEYS = "ticker, date, direction, setup"
_JOINED = (*_SIG, _TOUCH.strip().removesuffix(","), _touches("dt", "fw", _KEYS, D.TARGETS), f"dj as (select dt.*, {', '.join(f's.{f}' for f in D.EDGES)} from dt left join signals s on s.ticker = dt.ticker and s.date = dt.date and s.direction = dt.direction and s.setup = dt.setup)")
_CELLS = [(i, t, h) for i, t in enumerate(D.TARGETS) for h in D.SESSIONS]
_COUNTS = ", ".join(f"count(*) filter (where partition = '{name}' and {_won(i, h)}) as {p}_{i}_{h}" for p, name in (("v", "Validation"), ("h", "Holdout")) for i, _, h in _CELLS)
_RULES = (
    *_JOINED, _parts(0.6, 0.75, "dj"), _bins(D.EDGES, "parts"),
    f"dg as (select direction, setup, feature, bin, count(*) filter (where partition = 'Validation') as n_v, count(*) filter (where partition = 'Holdout') as n_h, {_COUNTS} from db where bin is not null group by 1, 2, 3, 4 having n_v >= 100)",
    "du as (" + " union all ".join(f"select direction, setup, feature, bin, {t}::double as target_r, {h} as horizon, n_v as validation_n, v_{i}_{h}/n_v as validation_rate, n_h as holdout_n, h_{i}_{h}/nullif(n_h, 0) as holdout_rate from dg" for i, t, h in _CELLS) + ")",
    "rules as (select *, validation_rate*(1+target_r)-1 as validation_expectancy, holdout_rate*(1+target_r)-1 as holdout_expectancy from du)",
)
_RULE_COLS = "direction, setup, feature, bin, target_r, horizon, validation_n, holdout_n, " + r6("validation_rate", "holdout_rate", "validation_expectancy", "holdout_expectancy")
rules = lambda s, d: D.discovered_rules(A.date_partitions(featured(s, d)))
register(
    "joi_06_outcome_features", lambda s, d: D.outcome_grid(featured(s, d), *D.KEYS, "rvol20", "breakout_atr", "gap_pct"),
    S.with_(*_JOINED) + " union all ".join(f"select {_KEYS}, {r6('rvol20', 'breakout_atr', 'gap_pct')}, {t}::double as target_r, {h} as horizon, cast({_won(i, h)} as int) as outcome from dj" for i, t, h in _CELLS),
)
register("agg_08_discovered_rules", rules, S.with_(*_RULES) + f"select {_RULE_COLS} from rules")
register(
    "agg_08_best_rules", lambda s, d: D.best_rules(rules(s, d)),
    S.with_(*_RULES) + f"select {_RULE_COLS}, coalesce(holdout_n >= 50 and holdout_expectancy > 0, false) as holdout_pass from (select * from rules r order by r.validation_expectancy desc, r.validation_rate desc, r.validation_n desc, direction, setup, feature, bin, horizon, target_r limit 30) q",
)

_ONE, _TEN = D.TARGETS.index(1.0), 10
_HALVES = "select *, cast(year(date) as varchar) || case when month(date) <= 6 then '-H1' else '-H2' end as half"


def _persistence(source: str, by: str, target: str) -> str:
    return f"""hv as ({_HALVES} from {source}), hn as (select {by}, half, count(*) as hn, sum(outcome) as hw, sum(outcome)/count(*)*(1+{target})-1 as e from hv group by {by}, half),
pe as (select {by}, count(*) as halves_observed, count(*) filter (where e > 0) as positive_halves, avg(e) as mean_half_expectancy, cast(sum(hn) as bigint) as n, cast(sum(hw) as bigint) as wins from hn group by {by}),
ps as (select *, wins/n as success_rate, wins/n*(1+{target})-1 as expectancy from pe)"""


register(
    "agg_13_half_year_persistence", lambda s, d: D.persistence(featured(s, d).withColumn("outcome", D.won(f"t{_ONE}", _TEN).cast("int")), ["setup", "direction"], 1.0),
    S.with_(*_JOINED, f"oc as (select *, cast({_won(_ONE, _TEN)} as int) as outcome from dj)", _persistence("oc", "setup, direction", "1.0"))
    + f"select setup, direction, halves_observed, positive_halves, n, wins, {r6('mean_half_expectancy', 'success_rate', 'expectancy')}, positive_halves >= 3 and halves_observed >= 3 and success_rate > 0.5 and expectancy > 0 as robust from ps",
)


def contraction_results(s: SparkSession, d: str) -> DataFrame:
    """Results of the contraction rules by partition, at one risk (the average true range) and ten sessions."""
    # read for the dates, the validation and the holdout, so computed once, with the bars that follow
    ruled = M.contractions(O.with_ahead(features(s, d), _TEN), M.RULE_GRID).select("ticker", "date", "direction", F.col("rule").alias("setup"), "rn", F.col("atr20").alias("risk"), "ahead")
    found = A.date_partitions(staged(ruled, "contractions"))
    hits = D.touches(found, None, (*D.KEYS, "partition"), (1.0,)).withColumn("outcome", D.won("t0", _TEN).cast("int")).withColumnRenamed("setup", "rule")
    return D.partition_results(hits, ["rule", "direction"], 1.0)


_VCP = (
    *S.BASE, _contraction_sql(M.RULE_GRID), _parts(0.6, 0.75, "vcp"),
    "nb as (select ticker, date, open, high, low, close, row_number() over (partition by ticker order by date) as brn from bars)",
    "vf as (select p.ticker, p.date, p.direction, p.rule, p.partition, p.atr20 as risk, b.brn - p.rn as k, b.high as bh, b.low as bl, max(case when b.brn = p.rn + 1 then b.open end) over (partition by p.ticker, p.date, p.direction, p.rule) as nxt from parts p join nb b on b.ticker = p.ticker and b.brn between p.rn + 1 and p.rn + 10)",
    _touches("vt", "vf", "ticker, date, direction, rule, partition", (1.0,)),
    f"vs as (select rule, direction, partition, count(*) as n, avg(cast({_won(0, _TEN)} as int)) as rate from vt group by 1, 2, 3)",
    "vj as (select v.rule, v.direction, v.n, v.rate, v.rate*2.0-1 as expectancy, h.n as holdout_n, h.rate as holdout_rate, h.rate*2.0-1 as holdout_expectancy from vs v left join vs h on h.rule = v.rule and h.direction = v.direction and h.partition = 'Holdout' where v.partition = 'Validation' and v.n >= {least})",
)
_VCP_COLS = f"rule, direction, n, holdout_n, {r6('rate', 'expectancy', 'holdout_rate', 'holdout_expectancy')}"
_with_vcp = lambda least: S.with_(*_VCP[:-1], _VCP[-1].format(least=least))
register("joi_07_rules_with_holdout", lambda s, d: D.with_holdout(contraction_results(s, d), ["rule", "direction"], 1), _with_vcp(1) + f"select {_VCP_COLS} from vj")
register(
    "agg_14_validated_rules", lambda s, d: D.with_holdout(contraction_results(s, d), ["rule", "direction"], 30).orderBy(F.desc("expectancy"), F.desc("n"), "rule", "direction").limit(15),
    _with_vcp(30) + f"select {_VCP_COLS} from (select * from vj v order by v.expectancy desc, v.n desc, rule, direction limit 15) q",
)

_FROZEN_VALUES = ", ".join(f"({n}, '{a}', '{b}', '{f}', {D.EDGES[f].index(u) - 1}, {h}, {t}::double)" for n, (a, b, f, u, h, t) in enumerate(D.CANDIDATES, 1))
_OUTCOME = "cast(case target_r " + " ".join(f"when {t} then {_won(i, 'horizon')}" for i, t in enumerate(D.TARGETS)) + " end as int)"
_FROZEN = (*_JOINED, _bins(D.EDGES, "dj"), f"cd(candidate_id, direction, setup, feature, bin, horizon, target_r) as (values {_FROZEN_VALUES})", f"fc as (select b.ticker, b.date, cd.*, {_OUTCOME} as outcome from db b join cd on cd.direction = b.direction and cd.setup = b.setup and cd.feature = b.feature and cd.bin = b.bin)")
frozen = lambda s, d: D.frozen_candidates(featured(s, d))
_CANDIDATE = "candidate_id, direction, setup, feature, bin, horizon, target_r"
register("joi_09_frozen_candidates", frozen, S.with_(*_FROZEN) + f"select ticker, date, {_CANDIDATE}, outcome from fc")
register(
    "agg_17_confirmation_gate", lambda s, d: D.confirmed(frozen(s, d)),
    S.with_(
        *_FROZEN, _persistence("fc", _CANDIDATE, "target_r"),
        "p0s as (select *, 1/(1+target_r) as p0 from ps)",
        "pv as (select *, positive_halves/halves_observed as positive_half_rate, (select least(sum(exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln(p0)+(n-i)*ln(1-p0))), 1.0) from unnest(generate_series(wins, n)) as u(i)) as p_value from p0s)",
        "rk as (select *, row_number() over (order by p_value, candidate_id) as k, count(*) over () as m from pv)",
        "hp as (select *, max(least(1.0, (m-k+1)*p_value)) over (order by k rows unbounded preceding) as holm_p from rk)",
    )
    + f"select {_CANDIDATE}, n, wins, halves_observed, {r6('success_rate', 'expectancy', 'p_value', 'holm_p', 'positive_half_rate')}, n >= 100 and expectancy > 0 and holm_p < 0.05 and positive_half_rate >= 0.6 as confirmed from hp",
)
