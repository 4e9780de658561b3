"""Boosted trees against a plain numpy version of the same growth, for several models fitted in the same passes."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import boosting as B


def plain(x, y, edges, trees, leaves, least, l2=1.0, rate=0.05):
    """Margins of the training rows; every leaf that may be split is measured at once."""
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    margin = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def best(rows):
            found = (0.0, None, None)
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
            for j, cuts in enumerate(edges):
                for cut in cuts:
                    a, b = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    if min(len(a), len(b)) >= least:
                        gain = round(score(a) + score(b) - score(rows), 9)
                        if gain > found[0]:
                            found = (gain, a, b)
            return found

        everything = np.arange(len(y))
        ends, heap, count = [], [(-best(everything)[0], 0, everything)], 1
        while heap:
            gain, _, rows = heapq.heappop(heap)
            if gain >= 0 or len(ends) + len(heap) + 1 >= leaves:
                ends.append(rows)
                continue
            for part in best(rows)[1:]:
                heapq.heappush(heap, (-best(part)[0], count, part))
                count += 1
        for rows in ends:
            margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return margin


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3))
    kind = np.where(x[:, 0] > 0.4, "a", "b")
    z = np.sin(3 * x[:, 0]) + x[:, 1] * (kind == "a")
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * z))).astype(int)
    rows = [(i, *map(float, x[i]), str(kind[i]), int(y[i])) for i in range(400)]
    return spark.createDataFrame(rows, "i int, x1 double, x2 double, x3 double, kind string, outcome int").repartition(3), x, (kind == "a").astype(float), y


def test_models_fitted_together_are_the_plain_trees(table):
    df, x, kind, y = table
    models = [(F.col("i") < 300, ("x1", "x2", "x3")), (F.lit(True), ("x2", "x3"))]
    made = B.fit(df, "outcome", models, ("kind",), trees=13, leaves=6, least=15)
    for model, upto, own in zip(made, (300, 400), ((0, 1, 2), (1, 2)), strict=True):
        got = np.array([r.m for r in df.select("i", model.margin().alias("m")).orderBy("i").collect()])[:upto]
        at = [model.numeric.index(f"x{j + 1}") for j in own]
        edges = [np.array(model.edges[k]) for k in at] + [np.array([0.0])]
        # the indicators of two categories split alike, so the first decides
        want = plain(np.c_[x[:upto, list(own)], kind[:upto]], y[:upto], edges, 13, 6, 15)
        assert np.allclose(got, want, atol=1e-4)
        assert max(sum(f >= 0 for f in t[0]) for t in model.trees) <= 5


def test_result_does_not_depend_on_partitions(table):
    df = table[0]
    one, many = (B.fit(d, "outcome", [(F.lit(True), ("x1", "x2"))], trees=4, least=10)[0] for d in (df.coalesce(1), df.repartition(7)))
    assert one == many


def test_margin_of_other_rows(table, spark):
    model = B.fit(table[0], "outcome", [(F.lit(True), ("x1",))], ("kind",), trees=3, least=10)[0]
    rows = spark.createDataFrame([(0.1, "never seen"), (0.1, None), (9.0, "a")], "x1 double, kind string")
    a, b, c = (r.m for r in rows.select(model.margin().alias("m")).collect())
    assert a == b and np.isfinite([a, c]).all()
    assert rows.where("x1 > 100").select(model.margin().alias("m")).collect() == []


def test_one_class_or_no_rows_give_margin_0(table):
    df = table[0]
    made = B.fit(df, "outcome", [(F.col("outcome") == 1, ("x1",)), (F.lit(False), ("x1",))], trees=2)
    assert [r.m for m in made for r in df.limit(3).select(m.margin().alias("m")).collect()] == [0.0] * 6
    empty = B.fit(df.where("i < 0"), "outcome", [(F.lit(True), ("x1",))], ("kind",), trees=2)
    assert [r.m for r in df.limit(2).select(empty[0].margin().alias("m")).collect()] == [0.0, 0.0]


def test_models_in_one_task_are_those_of_the_passes_and_need_few_jobs(table, spark):
    df = table[0]
    models = [(F.col("i") < 300, ("x1", "x2")), (F.lit(True), ("x2", "x3")), (F.col("outcome") == 1, ("x1",))]
    passed = B.fit(df, "outcome", models, ("kind",), trees=5, leaves=6, least=15, whole=0)
    mixed = B.fit(df, "outcome", models, ("kind",), trees=5, leaves=6, least=15, whole=300)
    spark.sparkContext.setJobGroup("alone", "small models")
    alone = B.fit(df, "outcome", models, ("kind",), trees=5, leaves=6, least=15)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("alone")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert alone == passed == mixed
    assert len(jobs) < 15  # the passes of 5 trees alone take more


def test_a_task_adds_up_the_smaller_of_two_siblings(monkeypatch):
    rng = np.random.default_rng(2)
    bins = rng.integers(0, B.BINS, (3000, 4)).astype(np.uint8)
    y = (rng.random(3000) < 1 / (1 + np.exp(-np.sin(bins[:, 0] / 8)))).astype(np.int8)
    allowed, weights, seen = np.array([[False, True, True, True]]), np.array([[1.1, 0.9]]), []
    kept = B._Rows.added
    monkeypatch.setattr(B._Rows, "added", lambda self, node: seen.append(len(self.at(node))) or kept(self, node))
    _, trees = next(B._grown(iter([(0, (bins[:1000], y[:1000])), (0, (bins[1000:], y[1000:]))]), allowed, weights, 3, 0.05, 8, 20, 1.0))
    # whole roots, and never more than half of a node that is split
    assert seen.count(3000) == 3 and sum(seen) < 3 * 3000 * 2.5 and all(sum(f >= 0 for f in t[0]) == 7 for t in trees)
    blocks = [(bins, y, np.ones((3000, 1), bool), np.zeros((3000, 1)))]
    tree, held = B.Growing(), B._Rows(bins, y, weights[0], np.arange(4))
    held.plant(tree)
    for _ in range(4):
        taken, need = tree.next(8, 20)
        plain = {node: sums for (_, node), sums in B._measured(blocks, [(0, tree.arrays(taken), need)], weights)}
        for node, sums in held.measured(need):
            assert (sums == plain[node]).all()
            tree.known[node], tree.totals[node] = B._best(sums, np.ones(4, bool), 20, 1.0)
