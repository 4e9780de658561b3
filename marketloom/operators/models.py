"""Models of a signal's success and of forward returns, on MLlib, our boosted trees and regressions fitted together: features, balanced fits, calibration by time folds, selection and rankings.

Fits are distributed; the driver holds coefficients, trees and calibration curves only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.exprs import finite, half_up
from marketloom.operators import boosting, linear
from marketloom.operators import statistics as A
from marketloom.sources.staging import staged

# Feature lists of the models.
FIRST = ("setup_score", "rvol20", "vol_accel", "base_days", "breakout_atr", "atr_compression", "trend20", "trend50", "trend200", "rs_spy_20", "tr_atr20", "close_loc", "regime_num")
BASELINE = ("setup_score", "rvol20", "base_days", "breakout_atr", "atr_compression", "trend20", "trend50", "trend200", "rs_spy_20", "tr_atr20", "regime_num")
NUMERIC = ("setup_score", "rvol20", "vol_accel", "base_days", "breakout_atr", "atr_compression", "trend20", "trend50", "trend200", "rs_spy_20", "tr_atr20", "close_loc", "base_range_pct", "atr20_pct", "risk_atr", "dv20_log", "gap_pct")
CATEGORICAL = ("setup", "regime", "trend")
CONTEXT = (
    "above_ema20", "above_ema50", "above_ema200", "positive5", "positive20", "median_ret20", "std_ret20", "up_down_volume", "spy_ret1", "spy_ret5", "spy_ret20", "spy_atr20_pct", "spy_tr_atr20", "qqq_ret5", "qqq_ret20", "iwm_ret20",
    "vix_level", "vix_percentile", "sector_positive", "sector_std_ret20", "sector_median_ret20", "sector_max_ret20", "sector_min_ret20", "sector_correlation", "sector_ret20", "rs_sector_20", "sector_rank_pct",
)
RANKING = (
    "ret_1", "ret_3", "ret_5", "ret_10", "ret_20", "ret_60", "ret_120", "ret_252", "excess_1", "excess_3", "excess_5", "excess_10", "excess_20", "excess_60", "ema_dist_20", "ema_dist_50", "ema_dist_200", "ema_slope20_5", "ema_slope50_10",
    "atr20_pct", "atr10_pct", "atr_comp", "vol10", "vol20", "rvol20", "vol_accel", "volume_trend5_20", "dv20_log", "close_loc20", "close_loc60", "dist_high20", "dist_high60", "dist_high252", "dist_low20", "dist_low60", "gap_pct", "intraday_ret", "tr_pct",
    "trend20", "trend50", "trend200",
)
#: Digits to which margins are rounded before calibration: its table is bounded by the range of margins, whatever the number of rows.
MARGIN_DIGITS = 3


def regime_number(regime: Column) -> Column:
    """1 for bullish, -1 for bearish, else 0; unknown is 0."""
    return F.when(regime.startswith("Bullish"), 1.0).when(regime.startswith("Bearish"), -1.0).otherwise(0.0)


def first_features(rows: DataFrame, features: tuple[str, ...] = FIRST) -> DataFrame:
    """rows with regime_num; those with a missing or non-finite feature are left out."""
    return complete(rows.withColumn("regime_num", regime_number(F.col("regime"))), features)


def second_features(rows: DataFrame) -> DataFrame:
    """rows with dv20_log, the logarithm of 1 and the dollar volume, and texts for unknown categories; rows with a missing or non-finite feature are left out."""
    x = rows.withColumn("dv20_log", F.log1p(F.greatest(F.col("dv20"), F.lit(0.0))))
    return complete(x.withColumns({c: F.coalesce(F.col(c), F.lit("nan")) for c in CATEGORICAL}), NUMERIC)


def complete(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return rows.withColumns({c: finite(F.col(c)) for c in features}).na.drop(subset=list(features))


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight n / (2 n of the class); the class counts, two numbers, are constants of the plan."""
    counts = {int(r[label]): r["count"] for r in rows.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.coalesce(*(F.when(F.col(label) == c, F.lit(total / (2.0 * n))) for c, n in counts.items()), F.lit(1.0))
    return rows.withColumn("weight", weight).withColumn("label", F.col(label).cast("double"))


def _assembled(numeric: tuple[str, ...], categorical: tuple[str, ...], scaled: bool) -> list:
    """Stages from columns to `features`: scaled numbers and one column a known category; unknown categories are all zeros."""
    stages = [VectorAssembler(inputCols=list(numeric), outputCol="_numbers", handleInvalid="keep")]
    if scaled:
        stages.append(StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True))
    parts = ["_scaled" if scaled else "_numbers"]
    if categorical:
        index, hot = [f"_i_{c}" for c in categorical], [f"_h_{c}" for c in categorical]
        stages += [StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep"), OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)]
        parts += hot
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def fit_logistic(rows: DataFrame, label: str, numeric: tuple[str, ...], categorical: tuple[str, ...] = (), c: float = 1.0) -> PipelineModel:
    """Balanced logistic regression on scaled features with penalty 1 / (2c) of the squared coefficients."""
    x = balanced(rows, label)
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / (c * max(x.count(), 1)), standardization=False, maxIter=300, tol=1e-7)
    return Pipeline(stages=[*_assembled(numeric, categorical, True), model]).fit(x)


def fit_logistic_in_passes(rows: DataFrame, label: str, numeric: tuple[str, ...], c: float = 1.0) -> PipelineModel | linear.Linear:
    """What fit_logistic() fits, by Newton's steps: each pass reads the written table again, where MLlib keeps a copy of all features on the executors' disks. Rows of one class only are left to MLlib."""
    try:
        return linear.fit(rows, label, [(F.lit(True), numeric, ())], c)[0]
    except linear.OneClass:
        return fit_logistic(rows, label, numeric, c=c)


def fit_ridge(rows: DataFrame, target: str, features: tuple[str, ...] = RANKING, alpha: float = 25.0) -> linear.Ridge:
    """Ridge regression of target on scaled features, with alpha on the sum of squares of the coefficients. Rows are read once."""
    return linear.fit_ridge(rows, target, features, alpha)


Model = PipelineModel | boosting.Boosted | linear.Linear
Fit = Callable[[DataFrame], PipelineModel]


def margin(model: Model, rows: DataFrame) -> DataFrame:
    """rows with margin, the log odds that the model gives; none of its helper columns."""
    if _plain(model):
        return rows.withColumn("margin", half_up(model.margin(), MARGIN_DIGITS))
    return model.transform(rows).select(*(F.col(c) for c in rows.columns), half_up(vector_to_array("rawPrediction")[1], MARGIN_DIGITS).alias("margin"))


Member = tuple[Model, list[float], list[float]]


class Calibrated:
    """Models of expanding time folds, each with a monotone curve from margin to rate fitted on its fold; the probability is their mean."""

    def __init__(self, members: list[Member]):
        self.members = members

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with p."""
        if all(_plain(model) for model, *_ in self.members):
            return self._predict_at_once(rows)
        names, x = rows.columns, rows
        parts = []
        for i, (model, edges, rates) in enumerate(self.members):
            x = margin(model, x).withColumn(f"_p{i}", _curve(edges, rates)("margin")).drop("margin")
            parts.append(F.col(f"_p{i}"))
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return x.select(*names, (total / len(parts)).alias("p"))


    def _predict_at_once(self, rows: DataFrame) -> DataFrame:
        """predict() by one function of a row's features, not one for each model and each curve after another."""
        columns, margins = _margins([model for model, *_ in self.members])
        curves = [(np.array(edges, float), np.array(rates, float)) for _, edges, rates in self.members]

        @F.pandas_udf("double")
        def p(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            values = np.stack(x.to_list()).astype(float)
            return pd.Series(sum((np.interp(of(values), *curve) for of, curve in zip(margins, curves, strict=True)), np.zeros(len(x))) / len(curves))

        return rows.withColumn("p", p(columns))


def _plain(model: Model) -> bool:
    return isinstance(model, boosting.Boosted | linear.Linear)


def _margins(models: list) -> tuple[Column, list[Callable[[np.ndarray], np.ndarray]]]:
    """An array column with the features of all plain models, and for each a function from its rows to margins as margin() rounds them."""
    numeric = tuple(dict.fromkeys(c for m in models for c in m.numeric))
    categories = tuple(dict.fromkeys(c for m in models for c in m.categories))

    def one(model) -> Callable[[np.ndarray], np.ndarray]:
        own, of = [*map(numeric.index, model.numeric), *(len(numeric) + categories.index(c) for c in model.categories)], model.margins()
        return lambda x: np.floor(of(x[:, own]) * 10.0**MARGIN_DIGITS + 0.5) / 10.0**MARGIN_DIGITS

    return boosting.vector(numeric, categories), [one(m) for m in models]


def _curve(edges: list[float], rates: list[float]) -> Callable[[str], Column]:
    """Linear interpolation within the curve, constant beyond its ends: edges are searched by halves and travel with the function, not in the plan."""
    xs, ys = np.array(edges, float), np.array(rates, float)

    @F.pandas_udf("double")
    def rate(value: pd.Series) -> pd.Series:
        return pd.Series(np.interp(value.to_numpy(dtype=float), xs, ys))

    return rate


def _fitted_curve(model: Model, rows: DataFrame, label: str) -> Member:
    """The model with its isotonic curve on rows; margins are grouped first, so the curve's input is bounded by their range."""
    table = margin(model, rows).groupBy("margin").agg(F.avg(F.col(label).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(table)
    return model, list(map(float, curve.boundaries)), list(map(float, curve.predictions))


def _fitted_curves(models: list[Model], table: DataFrame, folds: list[tuple[str, int]], label: str) -> list[Member]:
    """As _fitted_curve() for each plain model on the rows of its _group and fold, in one pass over table. A model's table of margins, bounded by their range, is pooled in one group."""
    if not models:
        return []
    columns, margins = _margins(models)
    of = {key: [i for i, k in enumerate(folds) if k == key] for key in folds}
    names = {g: j for j, g in enumerate(dict.fromkeys(g for g, _ in folds))}
    group = F.coalesce(*(F.when(F.col("_group") == g, j) for g, j in names.items()))
    rows = table.where(F.col("fold").isNotNull()).select(columns.alias("x"), group.alias("g"), "fold", F.col(label).cast("double").alias("y")).where("g is not null")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            g, fold, y = (b.column(i).to_numpy() for i in (1, 2, 3))
            for (name, k), own in of.items():
                at = np.flatnonzero((g == names[name]) & (fold == k))
                for i in own if len(at) else ():
                    yield pa.RecordBatch.from_pydict({"model": np.full(len(at), i, np.int32), "margin": margins[i](x[at]), "y": y[at]})

    table = rows.mapInArrow(scored, "model int, margin double, y double").groupBy("model", "margin").agg(F.sum("y").alias("y"), F.count("*").alias("n"))

    def pool(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("margin")
        blocks: list[list[float]] = []  # lowest and highest margin, successes, rows
        for at, y, n in zip(x["margin"].tolist(), x["y"].tolist(), x["n"].tolist(), strict=True):
            blocks.append([at, at, y, n])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
                _, high, y, n = blocks.pop()
                blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + y, blocks[-1][3] + n]
        ends = [(b[i], b[2] / b[3]) for b in blocks for i in ((0, 1) if b[0] < b[1] else (0,))]
        return pd.DataFrame({"model": [int(x["model"].iloc[0])], "edges": [[e for e, _ in ends]], "rates": [[r for _, r in ends]]})

    found = {r.model: r for r in table.groupBy("model").applyInPandas(pool, "model int, edges array<double>, rates array<double>").collect()}
    return [(model, list(found[i].edges), list(found[i].rates)) for i, model in enumerate(models)]


def _usable(sizes: dict[tuple[int | None, int], int], folds: int) -> list[int]:
    """Folds that follow rows of both classes, of the counts by fold and class. Raises ValueError if there is none."""
    seen = lambda k, y: sum(n for (f, c), n in sizes.items() if c == y and (f is None or f < k))
    found = [k for k in range(folds) if seen(k, 0) and seen(k, 1) and any(f == k for f, _ in sizes)]
    if not found:
        raise ValueError("no fold follows rows of both classes")
    return found


def calibrated(rows: DataFrame, label: str, fit: Fit, folds: int = 5, ties: tuple[str, ...] = ("ticker", "direction")) -> Calibrated:
    """Fits on the rows before each of the expanding folds in order of date, and calibrates on the fold by isotonic regression.

    Folds run side by side. Rows should be a written table: every fold reads them again. Folds without rows of both classes before them are left out;
    raises ValueError if none is left.
    """
    parted = A.time_folds(rows, folds, ties)
    usable = _usable({(r.fold, int(r[label])): r["count"] for r in parted.groupBy("fold", label).count().collect()}, folds)

    def member(k: int) -> Member:
        model = fit(parted.where(F.col("fold").isNull() | (F.col("fold") < k)).drop("fold"))
        return _fitted_curve(model, parted.where(F.col("fold") == k).drop("fold"), label)

    return Calibrated(_side_by_side(member, usable))


def _folded(groups: dict[str, DataFrame], label: str, folds: int, ties: tuple[str, ...]) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The folds of all groups as one written table with _group and fold, and each group with its usable folds.

    Raises ValueError for a group of which no fold follows rows of both classes.
    """
    table = staged(reduce(DataFrame.unionByName, (A.time_folds(rows, folds, ties).withColumn("_group", F.lit(g)) for g, rows in groups.items())), "folds")
    counts = table.groupBy("_group", "fold", label).count().collect()
    return table, [(g, k) for g in groups for k in _usable({(r.fold, int(r[label])): r["count"] for r in counts if r["_group"] == g}, folds)]


def _before(g: str, k: int) -> Column:
    """The rows of group g that precede its fold k."""
    return (F.col("_group") == g) & (F.col("fold").isNull() | (F.col("fold") < k))


def _calibrated(table: DataFrame, label: str, keys: list[tuple[str, str, int]], models: list[Model]) -> dict[tuple[str, str], Calibrated]:
    """The models by group and name, calibrated on their folds: keys are group, name and fold of each."""
    members = _fitted_curves(models, table, [(g, k) for g, _, k in keys], label)
    return {pair: Calibrated([m for m, key in zip(members, keys, strict=True) if key[:2] == pair]) for pair in dict.fromkeys(key[:2] for key in keys)}


def calibrated_boosting(groups: dict[str, DataFrame], label: str, sets: dict[str, tuple[str, ...]], categorical: tuple[str, ...], trees: int = 250, least: int = 40, folds: int = 5, ties: tuple[str, ...] = ("ticker", "direction")) -> dict[tuple[str, str], Calibrated]:
    """Boosted trees calibrated as in calibrated(), for each group of rows and each set of numeric features.

    The folds of all groups are one written table, on which the models of all groups, sets and folds are fitted in the same passes. Raises
    ValueError for a group of which no fold follows rows of both classes.
    """
    table, usable = _folded(groups, label, folds, ties)
    keys = [(g, name, k) for g, k in usable for name in sets]
    models = boosting.fit(table, label, [(_before(g, k), sets[name]) for g, name, k in keys], categorical, trees=trees, least=least)
    return _calibrated(table, label, keys, models)


def calibrated_logistic(groups: dict[str, DataFrame], label: str, sets: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], folds: int = 5, ties: tuple[str, ...] = ("ticker", "direction")) -> dict[tuple[str, str], Calibrated]:
    """What calibrated() makes of fit_logistic(), for each group of rows and each set of numeric and categorical features, in the same passes. Raises ValueError as calibrated_boosting()."""
    table, usable = _folded(groups, label, folds, ties)
    keys = [(g, name, k) for g, k in usable for name in sets]
    return _calibrated(table, label, keys, linear.fit(table, label, [(_before(g, k), *sets[name]) for g, name, k in keys]))


def _side_by_side(work: Callable, items: list) -> list:
    pool = ThreadPool(max(1, min(len(items), 8)))
    try:
        return pool.map(inheritable_thread_target(work), items)
    finally:
        pool.close()


def metrics(scored: DataFrame, label: str, *by: str, fractions: tuple[float, ...] = (0.10, 0.20, 0.30)) -> DataFrame:
    """n, success rate, Brier score, AUC, and rate and expectancy of the best scored shares, by group.

    Ranks come from counts by distinct score and label (scores to 6 digits), not from a sort of all rows; rows of equal score count
    with their mean rate where a share's edge falls among them.
    """
    s, keys = half_up(F.col("p"), 6), list(by)
    x = scored.withColumns({"_s": s, "_y": F.col(label).cast("double"), "_b": F.pow(F.col("p") - F.col(label), 2)})
    levels = x.groupBy(*keys, "_s").agg(F.count("*").alias("c"), F.sum("_y").alias("y"), F.sum("_b").alias("b"))
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumns({"above": F.coalesce(F.sum("c").over(down), F.lit(0)), "wins_above": F.coalesce(F.sum("y").over(down), F.lit(0.0)), "total": F.sum("c").over(w)})
    share = lambda f: F.greatest(F.lit(1), F.floor(F.lit(f) * F.col("total")))
    taken = lambda f: F.greatest(F.lit(0), F.least(F.col("c"), share(f) - F.col("above")))
    n, wins = F.sum("c"), F.sum("y")
    pairs = F.sum((F.col("c") - F.col("y")) * (F.col("wins_above") + F.col("y") / 2))
    tops = [c for f in fractions for c in (F.sum(taken(f) * F.col("y") / F.col("c")) / F.sum(taken(f)),)]
    out = levels.groupBy(*keys).agg(n.alias("n"), (wins / n).alias("success_rate"), (F.sum("b") / n).alias("brier"), (pairs / F.nullif(wins * (n - wins), F.lit(0.0))).alias("auc"), *(t.alias(f"top{round(f * 100)}_rate") for f, t in zip(fractions, tops, strict=True)))
    return out.withColumns({f"top{round(f * 100)}_expectancy": 3 * F.col(f"top{round(f * 100)}_rate") - 1 for f in fractions})


#: Rows to fit on before the validation, and before the holdout.
STAGES = {"Validation": "partition = 'Train'", "Holdout": "partition in ('Train', 'Validation')"}
Candidates = dict[str, Callable[[str], Calibrated]]


#: Features of the regressions to choose from.
LOGISTIC = {"Logistic V1 Baseline": (BASELINE, ()), "Logistic V2": (NUMERIC, CATEGORICAL)}


def candidates(logistic: dict[str, dict[str, Calibrated]], boosted: dict[str, Calibrated]) -> Candidates:
    """The models to choose from: name to what gives the model for scoring a partition. logistic: by name and partition; boosted: by partition."""
    return {**{name: models.__getitem__ for name, models in logistic.items()}, "HistGradientBoosting V2": boosted.__getitem__}


def selected(rows: DataFrame, models: Candidates) -> tuple[str, Calibrated, DataFrame]:
    """The candidate that is best on validation, fitted on training and validation rows, with metrics of all on validation and of it on the holdout.

    rows: outcome, partition and features. Best: expectancy of the top tenth, then of the top fifth, then the lower Brier score. The holdout is
    looked at once, by the chosen model only. Metrics have model, partition and chosen.
    """
    scored = lambda model, part: metrics(model.predict(rows.where(F.col("partition") == part)), "outcome").first()
    found = _side_by_side(lambda m: scored(models[m]("Validation"), "Validation"), list(models))
    key = lambda r: (r.top10_expectancy, r.top20_expectancy, -r.brier) if r else (float("-inf"),) * 3
    name = max(zip(models, found, strict=True), key=lambda item: key(item[1]))[0]
    model = models[name]("Holdout")
    table = [(m, "Validation", m == name, r) for m, r in zip(models, found, strict=True)] + [(name, "Holdout", True, scored(model, "Holdout"))]
    fields = ["n", "success_rate", "brier", "auc", *(f"top{k}_{c}" for k in (10, 20, 30) for c in ("rate", "expectancy"))]
    schema = "model string, partition string, chosen boolean, " + ", ".join(f"{f} {'long' if f == 'n' else 'double'}" for f in fields)
    return name, model, rows.sparkSession.createDataFrame([(m, p, c, *(r[f] for f in fields)) for m, p, c, r in table if r], schema)


DELTAS = ("auc", "brier", "top10_expectancy", "top20_expectancy")


def study_deltas(results: DataFrame) -> DataFrame:
    """results (direction, feature_set Baseline or Context, model, partition, metrics) with chosen, paired deltas and deltas against the best baseline.

    chosen: the context model of a direction with the highest expectancy of the top tenth on validation, then the lower Brier score. delta_x: the
    context row's x minus that of the baseline of the same model and partition. best_delta_x, on the chosen model's holdout row: minus that of the
    baseline with the highest expectancy of the top tenth on the holdout, then the lower Brier score. Null elsewhere. Equal ones: the first name.
    """
    context, baseline = F.col("feature_set") == "Context", results.where("feature_set = 'Baseline'")
    best = lambda x, what: x.groupBy("direction").agg(F.min_by(what, F.struct(-F.col("top10_expectancy"), "brier", "model")).alias("_best"))
    choice = best(results.where(context & (F.col("partition") == "Validation")), F.col("model")).withColumnRenamed("_best", "_choice")
    held = best(baseline.where("partition = 'Holdout'"), F.struct(*DELTAS))
    pairs = baseline.select("direction", "model", "partition", F.struct(*DELTAS).alias("_base"))
    # one row a direction, and a few a direction
    x = results.join(F.broadcast(pairs), ["direction", "model", "partition"], "left").join(F.broadcast(choice), "direction", "left").join(F.broadcast(held), "direction", "left")
    chosen = context & (F.col("model") == F.col("_choice"))
    x = x.withColumns({"chosen": chosen, **{f"delta_{m}": F.when(context, F.col(m) - F.col(f"_base.{m}")) for m in DELTAS}, **{f"best_delta_{m}": F.when(chosen & (F.col("partition") == "Holdout"), F.col(m) - F.col(f"_best.{m}")) for m in DELTAS}})
    return x.drop("_base", "_choice", "_best")


def ranking_results(scored: DataFrame, score: str, direction: str, top_k: tuple[int, ...] = (10, 20, 40), horizons: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """The best K names of each date by score: by K and horizon n, mean trade return and excess, hit rate and share of the label. Ties by ticker."""
    sign = 1.0 if direction == "Long" else -1.0
    label = "top_quintile" if direction == "Long" else "bottom_quintile"
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "ticker"))
    x = scored.withColumn("_r", rank).where(F.col("_r") <= max(top_k)).withColumn("top_k", F.explode(F.array(*map(F.lit, top_k)))).where("_r <= top_k")
    cells = F.array(*(F.struct(F.lit(h).alias("horizon"), (sign * F.col(f"fwd_ret_{h}")).alias("r"), (sign * F.col(f"fwd_excess_{h}")).alias("x")) for h in horizons))
    x = x.withColumn("_c", F.explode(cells)).select("top_k", "_c.*", label)
    return x.groupBy("top_k", "horizon").agg(F.count("*").alias("n"), F.avg("r").alias("trade_return"), F.avg("x").alias("trade_excess"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.avg(F.col(label).cast("double")).alias("label_rate"))


def daily_excess(scored: DataFrame, score: str, direction: str, top_k: int = 40, horizon: int = 5) -> DataFrame:
    """date and mean_excess of the best K names by score, in the direction of the trade."""
    sign = 1.0 if direction == "Long" else -1.0
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "ticker"))
    return scored.withColumn("_r", rank).where(F.col("_r") <= top_k).groupBy("date").agg(F.avg(sign * F.col(f"fwd_excess_{horizon}")).alias("mean_excess"))


def paired_interval(scored: DataFrame, model: str, base: str, direction: str, top_k: int = 40, horizon: int = 5, block: int = 5, reps: int = 4000) -> DataFrame:
    """Bootstrap interval of the daily excess of model, of base, and of their difference on shared dates: ranking, n, mean, ci_low, ci_high."""
    a, b = daily_excess(scored, model, direction, top_k, horizon), daily_excess(scored, base, direction, top_k, horizon)
    both = a.join(b.withColumnRenamed("mean_excess", "base_excess").hint("merge"), "date")
    parts = [(model, a), (base, b), (f"{model}_minus_{base}", both.withColumn("mean_excess", F.col("mean_excess") - F.col("base_excess")))]
    rows = [x.select(F.lit(name).alias("ranking"), "date", "mean_excess") for name, x in parts]
    return A.bootstrap_interval(rows[0].unionByName(rows[1]).unionByName(rows[2]), "mean_excess", "ranking", block=block, reps=reps, min_n=10, seed=f"ranking|{direction}")


def chosen_ranking(results: DataFrame, *by: str) -> DataFrame:
    """The ranking with the higher mean excess, ties by hit rate, of results(ranking, trade_excess, hit_rate, by)."""
    return results.groupBy(*by).agg(F.max_by("ranking", F.struct(half_up(F.col("trade_excess"), 9), "hit_rate", "ranking")).alias("ranking"))


def save(model: Calibrated, folder: str, about: DataFrame) -> None:
    """Writes the members, their curves, and one JSON row about the model below folder."""
    spark, rows = about.sparkSession, []
    for i, (member, edges, rates) in enumerate(model.members):
        plain = not isinstance(member, PipelineModel)
        if not plain:
            member.write().overwrite().save(f"{folder}/member-{i}")
        rows.append((i, edges, rates, json.dumps(asdict(member)) if plain else None))
    spark.createDataFrame(rows, "member int, edges array<double>, rates array<double>, trees string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/curves")
    about.coalesce(1).write.mode("overwrite").json(f"{folder}/about")


def load(spark, folder: str) -> Calibrated:
    def member(r) -> Model:
        if r.trees is None:
            return PipelineModel.load(f"{folder}/member-{r.member}")
        x = json.loads(r.trees)
        if "trees" not in x:
            return linear.Linear(tuple(x["numeric"]), tuple(map(tuple, x["categories"])), x["coefficients"], x["intercept"])
        return boosting.Boosted(tuple(x["numeric"]), tuple(map(tuple, x["categories"])), x["edges"], [tuple(t) for t in x["trees"]])

    return Calibrated([(member(r), list(r.edges), list(r.rates)) for r in spark.read.parquet(f"{folder}/curves").orderBy("member").collect()])
