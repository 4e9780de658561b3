"""Models of a size that was passed over in blocks, or staged and shuffled with all columns, before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import boosting as B


def test_a_model_that_fits_a_task_needs_no_pass_a_tree(spark):
    df = spark.range(0, 300_000, numPartitions=4).select((F.col("id") % 61).cast("double").alias("x1"), (F.col("id") % 7).cast("double").alias("x2"), (F.hash("id") % 100 < F.col("id") % 61).cast("int").alias("outcome"))
    spark.sparkContext.setJobGroup("whole", "whole")
    made = B.fit(df, "outcome", [(F.lit(True), ("x1", "x2"))], trees=4, leaves=6)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("whole")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(made[0].trees) == 4 and max(made[0].trees[0][0]) >= 0
    assert len(jobs) < 15  # 300,000 rows are more than a task took; four trees of six leaves then took more


@pytest.mark.parametrize("heavy", [1.0, 40.0])
def test_bins_counted_by_pairs_are_the_plain_sums(monkeypatch, heavy):
    rng = np.random.default_rng(4)
    bins = rng.integers(0, B.BINS, (9000, 5)).astype(np.uint8)
    y = (rng.random(9000) < 1 / (1 + np.exp(-np.sin(bins[:, 1] / 8)))).astype(np.int8)
    monkeypatch.setattr(B, "CHUNK", 2500)
    monkeypatch.setattr(B, "PAIRED", 3000)
    weights = np.array([[1.1, heavy]])  # heavy rows leave no room for a count beside the hessian
    held, margins = B._Rows([bins[:4000], bins[4000:]], y, weights[0], np.array([0, 1, 3, 4])), rng.normal(size=9000)
    held.margins[:] = margins
    tree, allowed = B.Growing(), np.array([False, True, False, True, True])
    held.plant(tree)
    assert held.counted == (heavy == 1.0)
    for _ in range(5):
        taken, need = tree.next(8, 20)
        plain = {node: sums for (_, node), sums in B._measured([(bins, y, np.ones((9000, 1), bool), margins[:, None])], [(0, tree.arrays(taken), need)], weights)}
        for node, sums in held.measured(need):
            assert (sums[:, held.used] == plain[node][:, held.used]).all() and not sums[:, 2].any()
            tree.known[node], tree.totals[node] = B._best(sums, allowed, 20, 1.0)
    assert len(taken) > 3


def test_rows_are_scored_as_trees_are_walked(monkeypatch):
    rng = np.random.default_rng(8)
    bins = rng.integers(0, B.BINS, (5000, 6)).astype(np.uint8)
    y = (rng.random(5000) < 1 / (1 + np.exp(-np.sin(bins[:, 0] / 8) - bins[:, 1] / 60))).astype(np.int8)
    monkeypatch.setattr(B, "CHUNK", 1200)
    trees = [t for leaves in (2, 15, 16, 30) for t in next(B._grown(iter([(0, (bins, y))]), np.ones((1, 6), bool), np.ones((1, 2)), 3, 0.05, leaves, 20, 1.0))[1]]
    trees += [tuple(a.tolist() for a in B.Growing().arrays([]))]
    assert {sum(f >= 0 for f in t[0]) + 1 for t in trees} == {1, 2, 15, 16, 30}
    want = np.zeros(5000)
    for t in trees:
        tree = tuple(np.array(a) for a in t)
        want = want + tree[3][B._ends(tree, bins)]
    assert (B._scorer(trees)(bins) == want).all() and B._scorer(trees)(bins[:0]).shape == (0,)


def test_windows_of_sector_correlations_are_plain(spark):
    from marketloom.operators import context

    rng = np.random.default_rng(6)
    days = [f"2020-{m:02d}-{d:02d}" for m in range(1, 6) for d in range(1, 29)]
    walk = lambda: (100 * np.exp(np.cumsum(rng.normal(size=len(days)) * 0.01))).round(4)
    # A and B are one series, so A is first; C stands still for a while
    a, c = walk(), walk()
    c[30:110] = c[30]
    sectors = [(n, d, float(v)) for n, x in (("A", a), ("B", a), ("C", c)) for d, v in zip(days, x, strict=True)]
    own = {"t1": walk(), "t2": (c * 1.01).round(4), "t3": np.full(len(days), 7.0)}
    own["t2"][30:110] = walk()[:80]
    bars = [(t, d, float(v)) for t, x in own.items() for d, v in zip(days, x, strict=True) if t != "t1" or d != days[20]]
    x = context.sector_proxy(spark.createDataFrame(bars, "ticker string, date string, close double"), spark.createDataFrame(sectors, "symbol string, date string, close double"), ["A", "B", "C"], sessions=30, least=20)
    assert "Window" in str(x._jdf.queryExecution().optimizedPlan()) and "covar_pop" not in str(x._jdf.queryExecution().optimizedPlan())  # frames of 60 rows were added up for each row and sector
    found = {(r.ticker, r.date): (r.sector, r.correlation) for r in x.collect()}
    returns = {n: dict(zip(days[1:], x[1:] / x[:-1] - 1, strict=True)) for n, x in (("A", a), ("B", a), ("C", c))}
    for t in own:
        rows = [(d, v) for n, d, v in bars if n == t]
        steps = [(d, v / rows[i - 1][1] - 1 if i else None) for i, (d, v) in enumerate(rows) if d in returns["A"]]
        for k, (d, _) in enumerate(steps):
            part = [(e, v) for e, v in steps[max(0, k - 29) : k + 1] if v is not None]
            if len(part) < 20:
                assert (t, d) not in found
                continue
            r, best = np.array([v for _, v in part]), (None, None)
            for n in "ABC":
                s = np.array([returns[n][e] for e, _ in part])
                if len(set(r)) > 1 and len(set(s)) > 1 and (best[0] is None or np.corrcoef(r, s)[0, 1] > best[1] + 1e-12):
                    best = (n, np.corrcoef(r, s)[0, 1])
            assert found[t, d][0] == best[0] and (best[0] is None or abs(found[t, d][1] - best[1]) < 1e-9), (t, d)
    assert {s for s, _ in found.values()} == {"A", "C", None}


def test_ridge_in_one_pass_is_the_closed_form(spark):
    from marketloom.operators import models as L

    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 4)) * [1.0, 5.0, 0.2, 0.0] + [0.0, 200.0, -3.0, 2.0]
    y = x @ [0.7, -0.1, 2.0, 0.0] + rng.normal(size=700)
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, c double, d double, y double").repartition(5)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ridge", "ridge")
    model = L.fit_ridge(df, "y", ("a", "b", "c", "d"), 25.0)
    assert len(jobs.getJobIdsForGroup("ridge")) < 4  # the rows were read by one job after another
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    s = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0, ddof=1)
    want = s @ np.linalg.solve(s.T @ s + 25.0 * np.eye(3), s.T @ (y - y.mean())) + y.mean()
    assert np.allclose([r.prediction for r in model.transform(df).orderBy("i").collect()], want, atol=1e-9)
    with pytest.raises(ValueError):
        L.fit_ridge(df.where("i < 0"), "y", ("a",))


def test_labels_from_bounds_are_those_of_ranks(spark):
    from marketloom.operators import indicators

    rng = np.random.default_rng(13)
    rows = [(f"d{d}", i, None if rng.random() < 0.1 else round(float(rng.normal()), 1)) for d, n in (("1", 1), ("2", 4), ("3", 57), ("4", 300)) for i in range(n)]
    rows += [("same", i, 1.5) for i in range(10)] + [("none", 1, None), ("nan", 1, 1.0), ("nan", 2, float("nan")), ("nan", 3, 2.0)] + [("zero", i, v) for i, v in enumerate((0.0, -0.0, 1.0, 2.0, 3.0))]
    df = spark.createDataFrame(rows, "date string, i int, fwd_excess_5 double")
    key = lambda x: sorted((r.date, r.i, r.top_quintile, r.bottom_quintile) for r in x.collect())
    plain = {(d, i): (a, b) for d, i, a, b in key(indicators.quintile_labels(df)) if d}
    bounds = indicators.quintile_bounds(df)
    got = {(d, i): (a, b) for d, i, a, b in ((r.date, r.i, r.top_quintile, r.bottom_quintile) for r in indicators.bounded_labels(df, bounds).collect())}
    assert got == plain and len(got) == len(rows) and bounds.count() == 8


def test_panel_is_not_dealt_by_date_nor_written_with_all_columns(spark, sf_small, monkeypatch):
    from marketloom.plans import modelling as M

    wide, written = [], {}

    def kept(df, name, keep=M.staged):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        wide.extend(line for line in plan.splitlines() if name == "panel" and "Window" in line and "rank(fwd_excess_5" in line)
        written.setdefault(name, []).append(df.columns)
        return keep(df, name)

    monkeypatch.setattr(M, "staged", kept)
    rows = M.eligible(spark, sf_small, *M.L.RANKING, "target_risk_adj5")
    assert not wide  # the wide rows were dealt by date for their labels
    assert set(rows.columns) == {"ticker", "date", "partition", *M.L.RANKING, "target_risk_adj5"}
    assert len(written["panel"][0]) == 3 + len(M.L.RANKING) - 6 + 1 and written["dates"] == [["date", "low", "high"]]


def test_logistic_in_passes_is_the_penalised_optimum(spark):
    from marketloom.operators import models as L

    rng = np.random.default_rng(14)
    x = rng.normal(size=(500, 3)) * [1.0, 5.0, 0.2] + [0.0, 2.0, 1.0]
    y = (rng.random(500) < 1 / (1 + np.exp(-x[:, 0] + 0.2 * x[:, 1]))).astype(int)
    df = spark.createDataFrame([(*map(float, v), int(t)) for v, t in zip(x, y, strict=True)], "a double, b double, c double, y int")
    model = L.fit_logistic_in_passes(df, "y", ("a", "b", "c"), c=0.25)
    s = np.c_[(x - x.mean(0)) / x.std(0, ddof=1), np.ones(500)]
    w, b = np.where(y == 1, 500 / (2 * y.sum()), 500 / (2 * (1 - y).sum())), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-s @ b))
        b -= np.linalg.solve((s * (w * p * (1 - p))[:, None]).T @ s + np.diag([4.0, 4.0, 4.0, 0.0]), s.T @ (w * (p - y)) + np.r_[b[:3], 0] * 4)
    assert np.allclose(model.margins()(x), s @ b, atol=1e-6)  # MLlib stops farther away, and keeps a copy of the rows on disk
    assert L.fit_logistic_in_passes(df.where("y = 1"), "y", ("a",)).stages  # one class: as before
