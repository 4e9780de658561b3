"""Fits against closed forms and plain gradient descent, metrics against plain counts, models written and read back, CSV sources."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import boosting
from marketloom.operators import models as L
from marketloom.operators import statistics as A
from marketloom.sources.delimited import read_csv


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1.0, 5.0, 0.2] + [0.0, 2.0, 1.0]
    z = 0.9 * x[:, 0] - 0.3 * x[:, 1]
    y = (rng.random(600) < 1 / (1 + np.exp(-z))).astype(int)
    kind = ["a" if v > 0 else "b" for v in x[:, 0] + rng.normal(size=600)]
    rows = [(f"t{i % 7}", i, *map(float, x[i]), kind[i], int(y[i]), float(z[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "ticker string, i int, x1 double, x2 double, x3 double, kind string, outcome int, z double")
    return df.withColumns({"date": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("i") / 4).cast("int")), "direction": F.lit("Long")}), x, y, z


def test_ridge_is_the_closed_form(table):
    df, x, _, z = table
    got = np.array([r.prediction for r in L.fit_ridge(df, "z", ("x1", "x2", "x3"), 25.0).transform(df).orderBy("i").collect()])
    s = (x - x.mean(0)) / x.std(0, ddof=1)
    b = np.linalg.solve(s.T @ s + 25.0 * np.eye(3), s.T @ (z - z.mean()))
    assert np.allclose(got, s @ b + z.mean(), atol=0.02)


def test_logistic_is_the_penalised_optimum(table):
    df, x, y, _ = table
    got = np.array([r.margin for r in L.margin(L.fit_logistic(df, "outcome", ("x1", "x2", "x3"), c=0.25), df).orderBy("i").collect()])
    s = np.c_[(x - x.mean(0)) / x.std(0, ddof=1), np.ones(len(x))]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-s @ b))
        pull = np.r_[b[:3], 0] / 0.25
        hess = (s * (w * p * (1 - p))[:, None]).T @ s + np.diag([4.0, 4.0, 4.0, 0.0])
        b -= np.linalg.solve(hess, s.T @ (w * (p - y)) + pull)
    assert np.allclose(got, s @ b, atol=0.01)


def test_unknown_categories_count_for_nothing(table, spark):
    df = table[0]
    model = L.fit_logistic(df, "outcome", ("x1",), ("kind",))
    rows = spark.createDataFrame([(0.5, "a"), (0.5, "b"), (0.5, "never seen")], "x1 double, kind string")
    a, b, unseen = (r.margin for r in L.margin(model, rows).collect())
    assert min(a, b) < unseen < max(a, b)


def test_calibrated_models_are_monotone_and_return_from_disk(table, spark, tmp_path):
    df = table[0]
    model = L.calibrated(df, "outcome", lambda r: L.fit_logistic(r, "outcome", ("x1", "x2", "x3")))
    assert len(model.members) == 5 and all(list(y) == sorted(y) for _, _, y in model.members)
    before = [r.p for r in model.predict(df).orderBy("i").collect()]
    assert all(0 <= p <= 1 for p in before)
    L.save(model, f"file://{tmp_path}/m", spark.createDataFrame([("Long", 600)], "direction string, n int"))
    after = [r.p for r in L.load(spark, f"file://{tmp_path}/m").predict(df).orderBy("i").collect()]
    assert before == after


def test_calibrated_boosting_shares_folds_and_returns_from_disk(table, spark, tmp_path):
    df = table[0]
    groups = {"all": df, "early": df.where("i < 400")}
    made = L.calibrated_boosting(groups, "outcome", {"one": ("x1",), "three": ("x1", "x2", "x3")}, ("kind",), trees=4, least=20, folds=2)
    assert set(made) == {(g, n) for g in groups for n in ("one", "three")} and all(len(m.members) == 2 for m in made.values())
    alone = L.calibrated_boosting({"early": groups["early"]}, "outcome", {"one": ("x1",)}, ("kind",), trees=4, least=20, folds=2)["early", "one"]
    model = made["all", "three"]
    before = [r.p for r in model.predict(df).orderBy("i").collect()]
    assert len(set(before)) > 3 and all(0 <= p <= 1 for p in before)
    parted = A.time_folds(groups["early"], 2, ("ticker", "direction"))
    folds = [F.col("fold").isNull(), F.col("fold").isNull() | (F.col("fold") < 1)]
    assert [m[0] for m in alone.members] == boosting.fit(parted, "outcome", [(c, ("x1",)) for c in folds], ("kind",), trees=4, least=20)
    L.save(model, f"file://{tmp_path}/b", spark.createDataFrame([("Long", 600)], "direction string, n int"))
    assert before == [r.p for r in L.load(spark, f"file://{tmp_path}/b").predict(df).orderBy("i").collect()]


def test_curve_is_a_lookup_outside_the_plan(spark):
    edges = [i / 7 for i in range(5000)]
    rates = [i / 5000 for i in range(5000)]
    rows = spark.createDataFrame([(-1.0,), (0.0,), (1.5,), (700.0,), (9999.0,)], "margin double")
    x = rows.select("margin", L._curve(edges, rates)("margin").alias("p"))
    assert len(x._jdf.queryExecution().toString()) < 5000
    assert np.allclose([r.p for r in x.collect()], np.interp([-1.0, 0.0, 1.5, 700.0, 9999.0], edges, rates))
    assert [r.p for r in rows.select(L._curve([0.5], [0.3])("margin").alias("p")).collect()] == [0.3] * 5


class _Known:
    """A model whose probabilities are a column of the rows."""

    def __init__(self, column):
        self.column = column

    def predict(self, rows):
        return rows.withColumn("p", F.col(self.column))


def test_selection_is_by_validation_alone(spark):
    rows = [(part, y, good, 1 - good) for part, good, y in [("Validation", i / 20, int(i >= 10)) for i in range(20)] + [("Holdout", i / 20, int(i < 10)) for i in range(20)]]
    df = spark.createDataFrame(rows, "partition string, outcome int, up double, down double")
    asked = []
    models = {name: lambda part, c=c, name=name: asked.append((name, part)) or _Known(c) for name, c in (("worse", "down"), ("better", "up"))}
    name, model, table = L.selected(df, models)
    assert name == "better" and model.column == "up" and sorted(asked) == [("better", "Holdout"), ("better", "Validation"), ("worse", "Validation")]
    found = {(r.model, r.partition): (r.chosen, r.top10_expectancy, r.auc) for r in table.collect()}
    assert found == {("worse", "Validation"): (False, -1.0, 0.0), ("better", "Validation"): (True, 2.0, 1.0), ("better", "Holdout"): (True, -1.0, 0.0)}


def test_study_deltas_by_hand(spark):
    names = "direction feature_set model partition auc brier top10_expectancy top20_expectancy".split()
    cells = [
        ("Long", "Baseline", "A", "Validation", 0.50, 0.30, 0.1, 0.1), ("Long", "Baseline", "B", "Validation", 0.52, 0.29, 0.2, 0.1),
        ("Long", "Context", "A", "Validation", 0.55, 0.28, 0.5, 0.2), ("Long", "Context", "B", "Validation", 0.60, 0.20, 0.5, 0.3),
        ("Long", "Baseline", "A", "Holdout", 0.51, 0.31, 0.4, 0.2), ("Long", "Baseline", "B", "Holdout", 0.53, 0.27, 0.1, 0.0),
        ("Long", "Context", "A", "Holdout", 0.70, 0.10, 0.9, 0.9), ("Long", "Context", "B", "Holdout", 0.54, 0.26, 0.3, 0.1),
    ]
    found = {(r.feature_set, r.model, r.partition): r for r in L.study_deltas(spark.createDataFrame(cells, names)).collect()}
    assert [k for k, r in found.items() if r.chosen] == [k for k in found if k[:2] == ("Context", "B")] and len(found) == 8
    r = found["Context", "B", "Holdout"]
    assert np.allclose([r.delta_auc, r.delta_brier, r.delta_top10_expectancy, r.best_delta_auc, r.best_delta_brier, r.best_delta_top10_expectancy, r.best_delta_top20_expectancy], [0.01, -0.01, 0.2, 0.03, -0.05, -0.1, -0.1])
    assert all(r.delta_auc is None for k, r in found.items() if k[0] == "Baseline") and sum(r.best_delta_auc is not None for r in found.values()) == 1


@pytest.fixture(scope="module")
def ranked(spark):
    rng = np.random.default_rng(5)
    rows = [(f"2021-01-{d:02d}", f"t{i}", *(float(v) for v in rng.normal(size=6).round(3)), *(float(v) for v in rng.normal(size=4).round(3)), bool(i % 2), bool(i % 3)) for d in range(1, 15) for i in range(12)]
    fields = "date string, ticker string, model double, momentum double, fwd_ret_1 double, fwd_ret_3 double, fwd_ret_5 double, fwd_ret_10 double, fwd_excess_1 double, fwd_excess_3 double, fwd_excess_5 double, fwd_excess_10 double, top_quintile boolean, bottom_quintile boolean"
    return spark.createDataFrame(rows, fields)


@pytest.mark.parametrize(("direction", "sign", "label"), [("Long", 1, "top_quintile"), ("Short", -1, "bottom_quintile")])
def test_ranking_results_are_the_plain_means(ranked, direction, sign, label):
    x = ranked.toPandas().sort_values(["date", "model", "ticker"], ascending=[True, False, True])
    for r in L.ranking_results(ranked, "model", direction, top_k=(3, 40), horizons=(1, 5)).collect():
        best = x.groupby("date").head(r.top_k)
        got = (r.n, r.trade_return, r.trade_excess, r.hit_rate, r.label_rate)
        assert np.allclose(got, (len(best), (sign * best[f"fwd_ret_{r.horizon}"]).mean(), (sign * best[f"fwd_excess_{r.horizon}"]).mean(), (sign * best[f"fwd_ret_{r.horizon}"] > 0).mean(), best[label].mean()))


def test_paired_interval_is_about_the_plain_difference(ranked):
    x = ranked.toPandas()
    daily = {c: x.sort_values(["date", c, "ticker"], ascending=[True, False, True]).groupby("date").head(3).groupby("date")["fwd_excess_5"].mean() for c in ("model", "momentum")}
    want = {**daily, "model_minus_momentum": daily["model"] - daily["momentum"]}
    rows = {r.ranking: r for r in L.paired_interval(ranked, "model", "momentum", "Long", top_k=3, reps=200).collect()}
    assert set(rows) == set(want)
    for name, series in want.items():
        r = rows[name]
        assert r.n == 14 and math.isclose(r["mean"], series.mean(), abs_tol=1e-6) and series.min() <= r.ci_low <= r["mean"] <= r.ci_high <= series.max()


def test_chosen_ranking_breaks_ties_by_hit_rate(spark):
    rows = [("Long", "model", 0.01, 0.5), ("Long", "momentum", 0.01, 0.6), ("Short", "model", 0.02, 0.1), ("Short", "momentum", 0.01, 0.9)]
    found = L.chosen_ranking(spark.createDataFrame(rows, "direction string, ranking string, trade_excess double, hit_rate double"), "direction").collect()
    assert {(r.direction, r.ranking) for r in found} == {("Long", "momentum"), ("Short", "model")}


def test_regressions_fitted_together_are_those_fitted_alone(table, spark, tmp_path):
    df = table[0]
    groups = {"all": df, "early": df.where("i < 400")}
    sets = {"plain": (("x1", "x2", "x3"), ()), "kinds": (("x1",), ("kind",))}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("together", "together")
    made = L.calibrated_logistic(groups, "outcome", sets, folds=3)
    spark.sparkContext.setJobGroup("apart", "apart")
    assert set(made) == {(g, n) for g in groups for n in sets} and all(len(m.members) == 3 for m in made.values())
    alone = L.calibrated(groups["early"], "outcome", lambda r: L.fit_logistic(r, "outcome", *sets["kinds"]), folds=3)
    for rows in (df, df.withColumn("kind", F.lit("never seen"))):
        for (a, *_), (b, *_) in zip(made["early", "kinds"].members, alone.members, strict=True):
            assert np.allclose([r.margin for r in L.margin(a, rows).orderBy("i").collect()], [r.margin for r in L.margin(b, rows).orderBy("i").collect()], atol=0.002)
    assert len(jobs.getJobIdsForGroup("together")) < 60
    before = [r.p for r in made["all", "plain"].predict(df).orderBy("i").collect()]
    L.save(made["all", "plain"], f"file://{tmp_path}/l", spark.createDataFrame([("Long", 600)], "direction string, n int"))
    assert before == [r.p for r in L.load(spark, f"file://{tmp_path}/l").predict(df).orderBy("i").collect()]


def test_curves_fitted_together_are_isotonic(spark):
    rng = np.random.default_rng(9)
    rows = [(float(m), int(rng.random() < 1 / (1 + np.exp(-m)))) for m in rng.normal(size=400).round(1)]
    df = spark.createDataFrame(rows, "x double, outcome int")
    model = L.linear.Linear(("x",), (), [1.0], 0.0)
    _, edges, rates = L._fitted_curve(model, df, "outcome")
    table = df.withColumns({"_group": F.lit("g"), "fold": F.lit(0)}).unionByName(df.where("x > 0").withColumns({"_group": F.lit("h"), "fold": F.lit(2)}))
    found = L._fitted_curves([model, model], table, [("g", 0), ("h", 2)], "outcome")
    for (_, e, r), want in zip(found, ((edges, rates), L._fitted_curve(model, df.where("x > 0"), "outcome")[1:]), strict=True):
        at = np.linspace(-4, 4, 161)
        assert np.allclose(np.interp(at, e, r), np.interp(at, *want)) and list(r) == sorted(r)


def test_members_are_scored_at_once(table, spark):
    df = table[0]
    made = L.calibrated_boosting({"g": df}, "outcome", {"s": ("x1", "x2")}, ("kind",), trees=3, least=20, folds=2)["g", "s"]
    lines = L.calibrated_logistic({"g": df}, "outcome", {"s": (("x3", "x1"), ("kind",))}, folds=2)["g", "s"]
    both = L.Calibrated([*made.members, *lines.members])
    x, parts = df, []
    for i, (model, edges, rates) in enumerate(both.members):
        x = L.margin(model, x).withColumn(f"p{i}", L._curve(edges, rates)("margin")).drop("margin")
        parts.append(f"p{i}")
    want = [sum(r[p] for p in parts) / len(parts) for r in x.orderBy("i").collect()]
    got = both.predict(df)
    assert np.allclose([r.p for r in got.orderBy("i").collect()], want, rtol=0, atol=1e-14)
    assert str(got._jdf.queryExecution().optimizedPlan()).count("ArrowEvalPython") == 1


def test_no_fold_with_both_classes_is_an_error(table):
    with pytest.raises(ValueError):
        L.calibrated(table[0].where("outcome = 1"), "outcome", lambda r: L.fit_logistic(r, "outcome", ("x1",)))


def test_metrics_are_plain_counts(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.5, 1), (0.4, 0), (0.4, 1), (0.2, 0), (0.1, 0), (0.1, 0), (0.0, 1)]
    r = L.metrics(spark.createDataFrame(rows, "p double, outcome int"), "outcome").first()
    auc = sum((p > q) + (p == q) / 2 for p, y in rows if y for q, o in rows if not o) / 25
    assert math.isclose(r.auc, auc) and math.isclose(r.brier, sum((p - y) ** 2 for p, y in rows) / 10)
    assert (r.top10_rate, r.top20_rate, round(r.top30_rate, 6)) == (1.0, 0.75, round(2 / 3, 6))


def test_binomial_tail_is_the_plain_sum(spark):
    cases = [(10, 0), (10, 4), (10, 10), (1000, 300), (1000, 360), (5000, 1900)]
    got = A.binomial_tail(spark.createDataFrame(cases, "n long, wins long"), "n", "wins", 1 / 3).collect()
    for r in got:
        want = math.fsum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(1 / 3) + (r.n - i) * math.log(2 / 3)) for i in range(r.wins, r.n + 1))
        assert math.isclose(r.p_value, want, rel_tol=1e-7, abs_tol=1e-10), r


def test_csv_has_its_schema_and_required_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ticker,price\nA,1.5\nB,oops\n,2.0\n")
    rows = read_csv(spark, f"file://{tmp_path}/a.csv", "ticker string, price double", ("ticker",)).orderBy("ticker").collect()
    assert [(r.ticker, r.price) for r in rows] == [("A", 1.5), ("B", None)]
