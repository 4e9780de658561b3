"""Queries over fitted models; SQL where no fit is involved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import boosting, context, indicators
from marketloom.operators import models as L
from marketloom.operators import statistics as A
from marketloom.plans import sql as S
from marketloom.plans.comparisons import MOMENTUM, momentum
from marketloom.plans.daily import MIN_DOLLAR_VOLUME, features, panel, rounded
from marketloom.plans.ledgers import SECTORS
from marketloom.plans.studies import _LAB, labelled, parted
from marketloom.sources import fixtures
from marketloom.sources.staging import staged

QUERIES: dict = {}
SQL: dict[str, str] = {}
SIDES = ("Long", "Short")


def register(name: str, query, text: str | None = None) -> None:
    QUERIES[name] = lambda s, d: rounded(query(s, d))
    if text is not None:
        SQL[name] = text


def _r6(names: tuple[str, ...]) -> str:
    return ", ".join(f"{S.half_up(n, 6)} as {n}" for n in names)


_ROW = ("ticker", "date", "direction")
_REGIME = "case when regime like 'Bullish%' then 1.0 when regime like 'Bearish%' then -1.0 else 0.0 end as regime_num"
_PRESENT = lambda names: " and ".join(f"{n} is not null and isfinite({n}::double)" for n in names)
register(
    "mod_01_first_features", lambda s, d: L.first_features(labelled(s, d)).select(*_ROW, "outcome", *L.FIRST),
    S.with_(*_LAB, f"mf as (select *, {_REGIME} from lab)") + f"select {', '.join(_ROW)}, outcome, {_r6(L.FIRST)} from mf where {_PRESENT(L.FIRST)}",
)
register(
    "mod_02_second_features", lambda s, d: L.second_features(labelled(s, d)).select(*_ROW, "outcome", *L.NUMERIC, *L.CATEGORICAL),
    S.with_(*_LAB, "mf as (select * exclude (regime, trend, setup), coalesce(regime, 'nan') as regime, coalesce(trend, 'nan') as trend, coalesce(setup, 'nan') as setup, ln(1+greatest(dv20, 0.0)) as dv20_log from lab)")
    + f"select {', '.join(_ROW)}, outcome, {_r6(L.NUMERIC)}, {', '.join(L.CATEGORICAL)} from mf where {_PRESENT(L.NUMERIC)}",
)


def training(s: SparkSession, d: str) -> DataFrame:
    """Labelled signals with the features of all models and partition, written once."""
    rows = L.second_features(L.first_features(parted(s, d)))
    return staged(rows.select(*_ROW, "outcome", "partition", *dict.fromkeys((*L.FIRST, *L.NUMERIC, *L.CATEGORICAL))), "training")


def by_side(rows: DataFrame, work) -> DataFrame:
    """work(side's rows) for both directions side by side, with direction."""
    found = L._side_by_side(lambda side: work(rows.where(F.col("direction") == side), side), list(SIDES))
    return found[0].unionByName(found[1])


def scores(s: SparkSession, d: str, fit) -> DataFrame:
    """Probabilities of all rows after training by a model fitted on training rows, for each direction."""

    def one(rows: DataFrame, side: str) -> DataFrame:
        later = rows.where("partition != 'Train'")
        scored = L.margin(fit(rows.where("partition = 'Train'")), later)
        return scored.select(*_ROW, "partition", "outcome", (1 / (1 + F.exp(-F.col("margin")))).alias("p"))

    return by_side(training(s, d), one)


register("mod_03_logistic", lambda s, d: scores(s, d, lambda r: L.fit_logistic(r, "outcome", L.FIRST)))
register("mod_04_one_hot_logistic", lambda s, d: scores(s, d, lambda r: L.fit_logistic(r, "outcome", L.NUMERIC, L.CATEGORICAL)))


def boosted_scores(s: SparkSession, d: str) -> DataFrame:
    """As scores(), by boosted trees; both directions are fitted in the same passes."""
    rows = training(s, d)
    made = boosting.fit(rows, "outcome", [((F.col("direction") == side) & (F.col("partition") == "Train"), L.NUMERIC) for side in SIDES], L.CATEGORICAL)
    each = [L.margin(m, rows.where((F.col("direction") == side) & (F.col("partition") != "Train"))) for m, side in zip(made, SIDES, strict=True)]
    return each[0].unionByName(each[1]).select(*_ROW, "partition", "outcome", (1 / (1 + F.exp(-F.col("margin")))).alias("p"))


register("mod_05_boosting", boosted_scores)
register(
    "mod_06_calibrated",
    lambda s, d: by_side(training(s, d), lambda rows, side: L.calibrated(rows.where("partition = 'Train'"), "outcome", lambda r: L.fit_logistic(r, "outcome", L.FIRST)).predict(rows.where("partition != 'Train'")).select(*_ROW, "partition", "outcome", "p")),
)


def _groups(rows: DataFrame) -> dict[str, DataFrame]:
    """The rows to fit on for each direction and scored partition."""
    return {f"{side}|{part}": rows.where(F.col("direction") == side).where(upto) for side in SIDES for part, upto in L.STAGES.items()}


def selection(s: SparkSession, d: str) -> DataFrame:
    """Metrics of the candidates and of the chosen one; the models of a kind of all directions, partitions and folds are fitted in the same passes."""
    rows = training(s, d)
    groups = _groups(rows)
    boosted = L.calibrated_boosting(groups, "outcome", {"V2": L.NUMERIC}, L.CATEGORICAL)
    logistic = L.calibrated_logistic(groups, "outcome", L.LOGISTIC)
    of = lambda models, side, name: {part: models[f"{side}|{part}", name] for part in L.STAGES}
    return by_side(rows, lambda x, side: L.selected(x, L.candidates({name: of(logistic, side, name) for name in L.LOGISTIC}, of(boosted, side, "V2")))[2].withColumn("direction", F.lit(side)))


register("mod_07_selection", selection)


def enriched(s: SparkSession, d: str) -> DataFrame:
    """Labelled signals with the context of their date and sector and their partition, complete in all features, written once.

    Tables by date have one row a session, which bounds the broadcasts. Breadth is over all series; the sector proxy is found on the signal's own series.
    """
    bars, bench, sectors = fixtures.bars(s, d), fixtures.bench(s, d), fixtures.bench_multi(s, d)
    proxies = staged(context.sector_proxy(bars, sectors, SECTORS), "proxies")
    cross = context.sector_cross_section(sectors)
    level = context.level_percentile(bench.withColumn("v", F.col("high") - F.col("low")), "v")
    by_date = [
        context.breadth(features(s, d)).drop("active"),
        context.benchmark_context(bench, sectors, "S1", "S2"),
        level.select("date", F.col("level").alias("vix_level"), F.col("percentile").alias("vix_percentile")),
        cross.select("date", *(F.col(c).alias(f"sector_{c}") for c in cross.columns if c != "date")),
    ]
    by_ticker = context.sector_strength(proxies, bars, sectors).drop("sector").join(proxies.select("ticker", "date", F.col("correlation").alias("sector_correlation")).hint("merge"), ["ticker", "date"])
    x = L.second_features(labelled(s, d)).select(*_ROW, "outcome", *L.NUMERIC, *L.CATEGORICAL)
    x = reduce(lambda rows, dates: rows.join(F.broadcast(dates), "date"), by_date, x).join(by_ticker.hint("merge"), ["ticker", "date"])
    x = staged(L.complete(x, L.CONTEXT).select(*_ROW, "outcome", *L.NUMERIC, *L.CATEGORICAL, *L.CONTEXT), "enriched")
    return staged(A.date_partitions(x), "enriched")


def study(s: SparkSession, d: str) -> DataFrame:
    """Both feature sets with both kinds of model on validation and holdout, for each direction, with deltas."""
    rows = enriched(s, d)
    sets = {"Baseline": L.NUMERIC, "Context": L.NUMERIC + L.CONTEXT}
    groups = _groups(rows)
    models = {(g, name, "HistGradientBoosting"): m for (g, name), m in L.calibrated_boosting(groups, "outcome", sets, L.CATEGORICAL, least=60).items()}
    models |= {(*k, "Logistic"): m for k, m in L.calibrated_logistic(groups, "outcome", {name: (numeric, L.CATEGORICAL) for name, numeric in sets.items()}).items()}
    scored = []
    for (g, name, kind), model in models.items():
        side, part = g.split("|")
        x = model.predict(rows.where((F.col("direction") == side) & (F.col("partition") == part)))
        scored.append(x.select("direction", "partition", F.lit(name).alias("feature_set"), F.lit(kind).alias("model"), "outcome", "p"))
    table = staged(reduce(DataFrame.unionByName, scored), "scored")
    results = L.metrics(table, "outcome", "direction", "feature_set", "model", "partition", fractions=(0.05, 0.10, 0.20, 0.30))
    return L.study_deltas(staged(results, "study"))


register("mod_08_feature_set_study", study)


#: Labels of the panel's rows by direction of the trade.
QUINTILES = {"Long": "top_quintile", "Short": "bottom_quintile"}
_FORWARD = tuple(f"fwd_{k}_{h}" for k in ("ret", "excess") for h in (1, 3, 5, 10))


#: Excess returns, by the return and the benchmark's that they are the difference of.
_EXCESS = {f"excess_{n}": (f"ret_{n}", f"b_{n}") for n in indicators.BACKS} | {f"fwd_excess_{n}": (f"fwd_ret_{n}", f"bf_{n}") for n in indicators.AHEADS}


def eligible(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Panel rows after the warm-up that are liquid, with partition by date and `columns` (labels among them), complete in features and outcomes; written once.

    Rows with all their columns are not dealt by date: a date's bounds and its partition are one row a session, found from dates and outcomes alone, and come
    back by broadcast. What is written is `columns` without the excess returns, which are taken again from returns and the benchmark's, and without the forward
    returns of training rows, which no ranking looks at: these are null.
    """
    x = panel(s, d).where(f"rn > 220 and dv20 >= {MIN_DOLLAR_VOLUME}")
    needed = tuple(dict.fromkeys((*L.RANKING, "target_risk_adj5", "risk_adj_mom20", *_FORWARD)))
    dates = staged(bounds_by_date(x), "dates")
    x = indicators.bounded_labels(x, dates).join(F.broadcast(A.date_cuts(dates.select("date"), 0.60, 0.80)), "date")
    kept = dict.fromkeys(_EXCESS[c][0] if c in _EXCESS else c for c in columns)
    rows = staged(L.complete(x, needed).select("ticker", "date", "partition", *(F.when(F.col("partition") != "Train", F.col(c)).alias(c) if c in _FORWARD else c for c in kept)), "panel")
    moves = staged(indicators.bench_moves(fixtures.bench(s, d)), "moves")
    return rows.join(F.broadcast(moves), "date").select("ticker", "date", "partition", *((F.col(_EXCESS[c][0]) - F.col(_EXCESS[c][1])).alias(c) if c in _EXCESS else c for c in columns))


def bounds_by_date(x: DataFrame) -> DataFrame:
    """One row for each date of x, with the bounds of its quintiles."""
    return indicators.quintile_bounds(x.select("date", "fwd_excess_5"))


def ranked_panel(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """By direction, rows after training with labels, outcomes, the model's score and the momentum baseline; written once, without the features."""
    rows = eligible(s, d, *QUINTILES.values(), *L.RANKING, *_FORWARD)
    train = rows.where("partition = 'Train'")
    models = {side: L.fit_logistic_in_passes(train.where(F.col(label).isNotNull()), label, L.RANKING, c=0.25) for side, label in QUINTILES.items()}
    scored = reduce(lambda x, side: L.margin(models[side], x).withColumnRenamed("margin", f"margin_{side}"), SIDES, rows.where("partition != 'Train'"))
    table = staged(scored.select("ticker", "date", "partition", *QUINTILES.values(), *_FORWARD, "excess_20", *(f"margin_{side}" for side in SIDES)), "ranked")
    return {side: table.where(F.col(label).isNotNull()).withColumns({"model": F.col(f"margin_{side}"), "momentum": (1.0 if side == "Long" else -1.0) * F.col("excess_20")}) for side, label in QUINTILES.items()}


def rankings(s: SparkSession, d: str) -> DataFrame:
    """Results of model and momentum by direction, partition, K and horizon."""
    out = None
    for side, rows in ranked_panel(s, d).items():
        for part in ("Validation", "Holdout"):
            for score in ("model", "momentum"):
                x = L.ranking_results(rows.where(F.col("partition") == part), score, side).withColumns({"direction": F.lit(side), "partition": F.lit(part), "ranking": F.lit(score)})
                out = x if out is None else out.unionByName(x)
    return out


def ridge(s: SparkSession, d: str) -> DataFrame:
    """The ridge model's score of every row after training, with its target."""
    rows = eligible(s, d, *L.RANKING, "target_risk_adj5")
    model = L.fit_ridge(rows.where("partition = 'Train'"), "target_risk_adj5")
    return model.transform(rows.where("partition != 'Train'")).select("ticker", "date", "partition", "target_risk_adj5", F.col("prediction").alias("score"))


def intervals(s: SparkSession, d: str) -> DataFrame:
    found = [L.paired_interval(rows.where("partition = 'Holdout'"), "model", "momentum", side).withColumn("direction", F.lit(side)) for side, rows in ranked_panel(s, d).items()]
    return found[0].unionByName(found[1]).withColumn("supported", F.coalesce(F.col("ci_low") > 0, F.lit(False)))


def choice(s: SparkSession, d: str) -> DataFrame:
    """The ranking that is better on validation at 40 names and five sessions, with its holdout results."""
    found = staged(rankings(s, d).where("top_k = 40 and horizon = 5"), "rankings")
    best = L.chosen_ranking(found.where("partition = 'Validation'"), "direction")
    return found.where("partition = 'Holdout'").join(F.broadcast(best), ["direction", "ranking"]).select("direction", "ranking", "n", "trade_return", "trade_excess", "hit_rate")


register("mod_09_ranking_model", rankings)
register("mod_10_ridge", ridge)
register("mod_13_model_against_momentum", intervals)
register("mod_15_chosen_ranking", choice)


def model_coefficients(s: SparkSession, d: str) -> DataFrame:
    """Daily information coefficients of the ridge model's score beside the momentum scores, after training."""
    rows = momentum(eligible(s, d, *L.RANKING, "target_risk_adj5")).where(" and ".join(f"{c} is not null" for c in MOMENTUM))
    model = L.fit_ridge(rows.where("partition = 'Train'"), "target_risk_adj5")
    later = model.transform(rows.where("partition != 'Train'")).withColumn("model_score", F.col("prediction"))
    return A.score_coefficients(later, ("model_score", *MOMENTUM), "target_risk_adj5")


register("agg_22_model_coefficients", model_coefficients)
