"""Balanced logistic regressions with a penalty on scaled coefficients, many models in the same passes; ridge regression in one pass.

A pass adds up the loss, its gradient and its curvature of all models in the tasks; groups of a model's sums are added by Spark, and the driver, which
holds a matrix of (features + 1) squared a model, takes Newton's next step. That takes some ten passes whatever the rows and the models, where
a fit of its own takes a job for each of some hundred steps. Each pass reads the table again; nothing else is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.boosting import vector

#: Newton's decrement, in units of the loss of all rows, at which a model has arrived; its last step is still taken.
ARRIVED = 1e-9
#: Passes after which a model stays where it is.
MOST_PASSES = 60


class OneClass(ValueError):
    """A model lacks rows of both classes."""


@dataclass
class Linear:
    """A logistic model on columns as they are. Plain values, so it can be pickled and written as JSON."""

    numeric: tuple[str, ...]
    categories: tuple[tuple[str, str], ...]
    coefficients: list[float]
    intercept: float

    def margins(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from rows of vector(numeric, categories) to their log odds, added up in the order of margin()."""

        def of(x: np.ndarray) -> np.ndarray:
            total = np.full(len(x), self.intercept)
            for i, b in enumerate(self.coefficients):
                total = total + x[:, i] * b
            return total

        return of

    def margin(self) -> Column:
        """The log odds of each row. Categories that were not known count as none."""
        total, n = F.lit(self.intercept), len(self.numeric)
        for c, b in zip(self.numeric, self.coefficients, strict=False):
            total = total + F.col(c).cast("double") * b
        for (c, v), b in zip(self.categories, self.coefficients[n:], strict=True):
            total = total + F.when(F.col(c) == v, b).otherwise(0.0)
        return total


def _added(rows: DataFrame, sums, length: dict[int, int]) -> dict[int, np.ndarray]:
    """The sums of each model over rows(x, y, member): sums(model, x, y) of some rows gives an array of length[model]."""
    schema = pa.schema([("model", pa.int32()), ("sums", pa.binary())])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {m: np.zeros(n) for m, n in length.items()}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x, member = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for i in (0, 2))
            y = b.column(1).to_numpy()
            for m in held:
                at = np.flatnonzero(member[:, m])
                if len(at):
                    held[m] += sums(m, x[at], y[at])
        yield pa.RecordBatch.from_pydict({"model": list(held), "sums": [v.tobytes() for v in held.values()]}, schema=schema)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in table.column("sums"))
        return pa.Table.from_pydict({"model": table.column("model")[:1], "sums": [total.tobytes()]}, schema=schema)

    found = rows.mapInArrow(some, "model int, sums binary").groupBy("model").applyInArrow(add, "model int, sums binary").collect()
    return {r.model: np.frombuffer(r.sums) for r in found}


def fit(rows: DataFrame, label: str, models: list[tuple[Column, tuple[str, ...], tuple[str, ...]]], c: float = 1.0) -> list[Linear]:
    """One model for each (condition for its training rows, its numeric features, its categorical features).

    rows: a written table with a label of 0 and 1 and features without nulls. The classes of a model's rows weigh the same, and 1 / (2c) of the squared
    coefficients of numbers scaled by the deviation of its rows, and of a 0 or 1 for each category, is the penalty. A number that is one
    value in all rows of a model, and a category that none has, gets no coefficient. Raises ValueError for a model without rows of both classes.
    """
    numeric = tuple(dict.fromkeys(f for _, features, _ in models for f in features))
    categorical = tuple(dict.fromkeys(f for _, _, features in models for f in features))
    x = rows.withColumn("_member", F.array(*(F.coalesce(k, F.lit(False)) for k, _, _ in models))).where(F.exists("_member", lambda m: m))
    aggs = [f(F.col(n).cast("double")).alias(f"{k}{i}") for i, n in enumerate(numeric) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    about = x.agg(F.count("*").alias("n"), *aggs, *(F.array_sort(F.collect_set(F.col(f).cast("string"))).alias(f"c_{f}") for f in categorical)).first()
    categories = tuple((f, v) for f in categorical for v in about[f"c_{f}"])
    size = len(numeric) + len(categories)
    shift, scale = np.zeros(size), np.ones(size)
    for i in range(len(numeric)):
        shift[i], scale[i] = about[f"m{i}"] or 0.0, about[f"s{i}"] or 1.0
    own = [np.array([*(numeric.index(f) for f in nums), *(len(numeric) + j for j, (f, _) in enumerate(categories) if f in cats)], int) for _, nums, cats in models]
    table = x.select(vector(numeric, categories).alias("x"), F.col(label).cast("int").alias("y"), "_member")

    def moments(m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = (x[:, own[m]] - shift[own[m]]) / scale[own[m]]
        return np.concatenate([[np.sum(y == 0), np.sum(y == 1)], z.sum(0), (z * z).sum(0)])

    found = _added(table, moments, {m: 2 + 2 * len(k) for m, k in enumerate(own)})
    if any(m not in found or not found[m][:2].all() for m in range(len(models))):
        raise OneClass("a model has no rows of both classes")
    weights, pull = [], []
    for m, k in enumerate(own):
        n, (first, second) = found[m][:2].sum(), np.split(found[m][2:], 2)
        weights.append(n / (2 * found[m][:2]))
        variance = np.maximum(second - first**2 / n, 0.0) / max(n - 1, 1)
        variance[variance < 1e-14 * np.maximum(second / n, 1e-30)] = 0.0
        flag = k >= len(numeric)
        pull.append(np.where(flag, np.where(second > 0, 1.0, 0.0), variance) / c)

    def newton(at: dict[int, np.ndarray]):
        def sums(m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.c_[(x[:, own[m]] - shift[own[m]]) / scale[own[m]], np.ones(len(x))]
            odds, w = z @ at[m], weights[m][y]
            p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            bend = (z * (w * p * (1 - p))[:, None]).T @ z
            return np.concatenate([[np.sum(w * (np.logaddexp(0, odds) - y * odds))], z.T @ (w * (p - y)), bend.ravel()])

        return sums

    here = {m: np.zeros(len(k) + 1) for m, k in enumerate(own)}
    best: dict[int, float] = {}
    step = {m: np.zeros(len(k) + 1) for m, k in enumerate(own)}
    done: dict[int, np.ndarray] = {}
    for _ in range(MOST_PASSES):
        open_ = [m for m in here if m not in done]
        if not open_:
            break
        at = {m: here[m] + step[m] for m in open_}
        for m, s in _added(table, newton(at), {m: 1 + len(at[m]) + len(at[m]) ** 2 for m in open_}).items():
            n = len(at[m])
            pulls = np.append(pull[m], 0.0)
            loss = s[0] + (pulls * at[m] ** 2).sum() / 2
            if m in best and not loss <= best[m] + 1e-12 * abs(best[m]):
                step[m] = step[m] / 2  # too far
                continue
            used = np.append(pull[m] > 0, True)
            slope, bend = (s[1 : n + 1] + pulls * at[m])[used], (s[n + 1 :].reshape(n, n) + np.diag(pulls))[np.ix_(used, used)]
            here[m], best[m], step[m] = at[m], loss, np.zeros(n)
            step[m][used] = -np.linalg.solve(bend, slope)
            if -slope @ step[m][used] < ARRIVED:
                done[m] = here[m] + step[m]
    out = []
    for m, k in enumerate(own):
        b = done.get(m, here[m])
        plain = b[:-1] / scale[k]
        numbers = tuple(numeric[i] for i in k if i < len(numeric))
        out.append(Linear(numbers, tuple(categories[i - len(numeric)] for i in k if i >= len(numeric)), plain.tolist(), float(b[-1] - plain @ shift[k])))
    return out


#: Parts that tasks' moments are pooled in before the driver adds them up.
POOLS = 32


@dataclass
class Ridge:
    """A linear model on columns as they are."""

    features: tuple[str, ...]
    coefficients: list[float]
    intercept: float

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with prediction."""
        total = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients, strict=True):
            total = total + F.col(c).cast("double") * b
        return rows.withColumn("prediction", total)


def _pooled(a: tuple, b: tuple) -> tuple:
    """Rows, means and sums of products about the means, of two sets together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def fit_ridge(rows: DataFrame, target: str, features: tuple[str, ...], alpha: float) -> Ridge:
    """Least squares with alpha on the squared coefficients of features scaled by their deviation, and an intercept.

    One pass adds up the products of features and target about their means, of which the driver holds a matrix; a feature that is one value has no
    coefficient. Raises ValueError without rows, or with values that are missing or not finite.
    """
    size = len(features) + 1
    schema = pa.schema([("pool", pa.int32()), ("moments", pa.binary())])

    def packed(pool: int, held: tuple) -> dict:
        return {"pool": [pool], "moments": [np.concatenate([[held[0]], held[1], held[2].ravel()]).tobytes()]}

    def unpacked(b: bytes) -> tuple:
        v = np.frombuffer(b)
        return v[0], v[1 : size + 1], v[size + 1 :].reshape(size, size)

    nothing = (0.0, np.zeros(size), np.zeros((size, size)))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = nothing
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                mean = x.mean(0)
                held = _pooled(held, (float(len(x)), mean, (x - mean).T @ (x - mean)))
        yield pa.RecordBatch.from_pydict(packed(TaskContext.get().partitionId() % POOLS, held), schema=schema)

    def pool(table: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(packed(table.column("pool")[0].as_py(), reduce(_pooled, (unpacked(v.as_py()) for v in table.column("moments")))), schema=schema)

    kind = "pool int, moments binary"
    x = rows.select(F.array(*(F.col(c).cast("double") for c in (*features, target))).alias("x"))
    found = x.mapInArrow(some, kind).groupBy("pool").applyInArrow(pool, kind).collect()
    n, mean, products = reduce(_pooled, (unpacked(r.moments) for r in sorted(found, key=lambda r: r.pool)), nothing)
    if not n or not np.isfinite(products).all():
        raise ValueError("no rows to fit, or values that are missing or not finite")
    deviation = np.sqrt(np.diag(products)[:-1] / max(n - 1, 1))
    used = deviation > 0
    scale = np.where(used, deviation, 1.0)
    cross, with_target = products[:-1, :-1] / np.outer(scale, scale), products[:-1, -1] / scale
    plain = np.where(used, np.linalg.solve(cross + alpha * np.eye(size - 1), with_target), 0.0) / scale
    return Ridge(features, plain.tolist(), float(mean[-1] - plain @ mean[:-1]))
