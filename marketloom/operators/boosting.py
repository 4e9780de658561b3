"""Boosted trees on histograms with a cap on leaves and a penalty on leaf values, many models in the same passes.

Rows become one byte a feature and stay where they are, in blocks; a pass adds up gradients and hessians by (model, node, feature, bin) in the
tasks, reduces them by (model, node), and sends home one split a node. Trees grow best first: a pass measures all nodes that the growth can
reach by what is known so far, of all models at once, so a tree takes about as many passes as it is deep, however many models there are.
This is the imperative loop over partitions for which the blocks are an RDD: planning a query a pass would take longer than the pass.

A pass costs two small jobs, however few its rows. So a model whose rows take at most WHOLE bytes, a bounded share of a task's memory, gets them into
one task that cuts each node's rows from its parent's; models side by side, the largest first. Larger ones are passed over in blocks. Both ways give
the same trees.

Sums are whole numbers (gradients in units of 2^-20), so that trees don't depend on the order in which tasks end. The driver holds edges, trees
and the best splits, whose size is set by parameters. Margins are checkpointed every CUT trees, which bounds what a lost executor costs.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.sources import files
from marketloom.sources.staging import new_path, shared_folder

#: Bins of a numeric feature; a byte holds a bin.
BINS = 64
#: Trees between two checkpoints of the margins.
CUT = 10
#: Bytes of a model that one task may hold: a byte a feature and BESIDE more a row; larger models stay in blocks of all tasks.
WHOLE, BESIDE = 480 << 20, 30
#: Units of gradients and hessians.
UNIT = float(1 << 20)
#: Rows that are added up at once, and least rows of a node for which the bins of two features are counted together.
CHUNK, PAIRED = 1 << 16, 1 << 13
#: A row's hessian carries this much more as its count; sums of CHUNK rows stay exact in a double if hessians are below HESSIAN.
COUNT, HESSIAN = float(1 << 36), float(1 << 20)


@dataclass
class Split:
    """The best split of a node and what lies on its sides: gradient, hessian and rows. No gain: a leaf."""

    gain: float
    feature: int = -1
    bin: int = -1
    sides: tuple = ()
    children: tuple[int, int] | None = None


@dataclass
class Growing:
    """A tree on its way: splits by node, and the totals of every node; nodes are numbered as they are opened."""

    known: dict[int, Split] = field(default_factory=dict)
    totals: list[tuple | None] = field(default_factory=lambda: [None])

    def next(self, leaves: int, least: int) -> tuple[list[int], list[int]]:
        """The nodes that best-first growth splits by what is known, and those to be measured first; without the latter the tree is done."""
        if 0 not in self.known:
            return [], [0]
        heap, taken, need = [(-self.known[0].gain, 0)], [], []
        while heap and len(taken) < leaves - 1:
            gain, node = heapq.heappop(heap)
            if gain >= 0:
                break
            taken.append(node)
            split = self.known[node]
            if split.children is None:
                split.children = (len(self.totals), len(self.totals) + 1)
                self.totals += split.sides
            for child in split.children:
                if child not in self.known and self.totals[child][2] < 2 * least:
                    self.known[child] = Split(0.0)
                if child in self.known:
                    heapq.heappush(heap, (-self.known[child].gain, child))
                elif len(taken) < leaves - 1:
                    need.append(child)
        return taken, need

    def arrays(self, taken: list[int], rate: float = 0.0, l2: float = 0.0) -> tuple[np.ndarray, ...]:
        """feature (-1 at the ends), bin, left and value by node, of the tree that the taken nodes make; its right child follows a left one."""
        n = len(self.totals)
        feature, bins, left, value = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
        for node in taken:
            s = self.known[node]
            feature[node], bins[node], left[node] = s.feature, s.bin, s.children[0]
        for node in range(n):
            if feature[node] < 0 and self.totals[node] is not None:
                g, h, _ = self.totals[node]
                value[node] = -rate * g / (h + l2)
        return feature, bins, left, value


def _ends(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    feature, at_bin, left, _ = tree
    node = np.zeros(len(bins), np.int32)
    rows = np.arange(len(bins))
    while True:
        inner = feature[node] >= 0
        if not inner.any():
            return node
        step = left[node] + (bins[rows, np.maximum(feature[node], 0)] > at_bin[node])
        node = np.where(inner, step, node)


def _scorer(trees: list[tuple]) -> Callable[[np.ndarray], np.ndarray]:
    """A function from rows of bins to the sums of the trees' values, added in their order.

    A tree of at most 16 leaves is not walked: a row's leaves are bits, from the left; each split that a row passes to the right strikes those on its
    left out, and the first that remains is the row's.
    """
    ready = []
    for t in trees:
        feature, at_bin, left, value = tree = tuple(np.asarray(a) for a in t)
        splits: list[tuple[int, int, int]] = []
        ends: list[int] = []

        def walk(node: int, feature=feature, at_bin=at_bin, left=left, splits=splits, ends=ends) -> None:
            if feature[node] < 0:
                ends.append(node)
                return
            first = len(ends)
            walk(int(left[node]))
            splits.append((int(feature[node]), int(at_bin[node]), ((1 << len(ends)) - 1) ^ ((1 << first) - 1)))
            walk(int(left[node]) + 1)

        walk(0)
        ready.append((tree, splits, value[ends]))
    first = np.array([(i & -i).bit_length() - 1 for i in range(1, 1 << 16)], np.int8) if any(len(values) <= 16 for _, _, values in ready) else None

    def score(bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for start in range(0, len(bins), CHUNK):
            some = bins[start : start + CHUNK]
            columns, total = np.ascontiguousarray(some.T), out[start : start + CHUNK]
            for tree, splits, values in ready:
                if len(values) > 16:
                    total += tree[3][_ends(tree, some)]
                    continue
                gone = np.zeros(len(some), np.uint16)
                for f, b, mask in splits:
                    gone |= (columns[f] > b) * np.uint16(mask)
                total += values[first[~gone - np.uint16(1)]]
        return out

    return score


def _measured(blocks: Iterator, plan: list, weights: np.ndarray) -> Iterator:
    """((model, node), int64 sums by gradient, hessian, rows; feature; bin) of one partition."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for bins, y, member, margins in blocks:
        n_features = bins.shape[1]
        for model, tree, nodes in plan:
            rows = np.flatnonzero(member[:, model])
            slots = np.full(len(tree[0]), -1, np.int32)
            slots[nodes] = np.arange(len(nodes))
            at = slots[_ends(tree, bins[rows])]
            rows, at = rows[at >= 0], at[at >= 0]
            if not len(rows):
                continue
            p = 1.0 / (1.0 + np.exp(-margins[rows, model]))
            w = weights[model][y[rows]]
            flat = ((at[:, None] * n_features + np.arange(n_features)) * BINS + bins[rows]).ravel()
            shape = (len(nodes), n_features, BINS)
            parts = [np.bincount(flat, None if v is None else np.repeat(v, n_features), minlength=int(np.prod(shape))).reshape(shape) for v in (np.rint(w * (p - y[rows]) * UNIT), np.rint(w * p * (1 - p) * UNIT), None)]
            sums = np.stack(parts, axis=1).astype(np.int64)
            for i, node in enumerate(nodes):
                key = (model, node)
                found[key] = found[key] + sums[i] if key in found else sums[i]
    yield from found.items()


def _best(sums: np.ndarray, allowed: np.ndarray, least: int, l2: float) -> tuple[Split, tuple]:
    """The split of highest gain (ties: first feature, then lowest bin) with so many rows on both sides, and the node's totals."""
    left = np.cumsum(sums, axis=2)
    total = left[:, 0, -1]
    g, h, n = left[0] / UNIT, left[1] / UNIT, left[2]
    tg, th, tn = total[0] / UNIT, total[1] / UNIT, int(total[2])
    gain = g**2 / (h + l2) + (tg - g) ** 2 / (th - h + l2) - tg**2 / (th + l2)
    fits = (n >= least) & (tn - n >= least) & (h >= 1e-3) & (th - h >= 1e-3) & allowed[:, None]
    gain = np.where(fits, np.round(gain, 9), 0.0)
    at = int(gain.argmax())
    feature, where = divmod(at, gain.shape[1])
    totals = (float(tg), float(th), tn)
    if gain[feature, where] <= 0:
        return Split(0.0), totals
    a = (float(g[feature, where]), float(h[feature, where]), int(n[feature, where]))
    return Split(float(gain[feature, where]), feature, where, (a, (totals[0] - a[0], totals[1] - a[1], totals[2] - a[2]))), totals


def _moved(blocks: Iterator, trees: list) -> Iterator:
    """Blocks with the margins after one more tree of every model."""
    for bins, y, member, margins in blocks:
        margins = margins.copy()
        for model, tree in trees:
            rows = np.flatnonzero(member[:, model])
            margins[rows, model] += tree[3][_ends(tree, bins[rows])]
        yield bins, y, member, margins


class _Rows:
    """The rows of one model, by node of the tree on its way: a node's rows are cut from its parent's, and of two siblings only the smaller one is added up."""

    def __init__(self, bins: np.ndarray | list[np.ndarray], y: np.ndarray, weights: np.ndarray, used: np.ndarray):
        blocks = bins if isinstance(bins, list) else [bins]
        self.features = blocks[0].shape[1]
        # the bins of two features, column by column: BINS * first + second
        self.pairs = np.zeros(((self.features + 1) // 2, len(y)), np.uint16)
        at = 0
        for b in blocks:
            to = slice(at, at := at + len(b))
            self.pairs[:, to] = b[:, 0::2].T.astype(np.uint16) * BINS
            self.pairs[: self.features // 2, to] += b[:, 1::2].T
        self.y, self.weights, self.used = y, weights, used
        self.margins, self.g, self.h = np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y))

    def bins(self, feature: int, rows: np.ndarray) -> np.ndarray:
        both = self.pairs[feature // 2].take(rows)
        return both % BINS if feature % 2 else both // BINS

    def plant(self, tree: Growing) -> None:
        """Begins a tree: its gradients and hessians, as whole numbers, so that what a sibling leaves of its parent is exact."""
        for start in range(0, len(self.y), CHUNK):
            some = slice(start, start + CHUNK)
            y = self.y[some]
            w, p = self.weights[y], 1.0 / (1.0 + np.exp(-self.margins[some]))
            self.g[some], self.h[some] = np.rint(w * (p - y) * UNIT), np.rint(w * p * (1 - p) * UNIT)
        self.tree, self.parent, self.sums = tree, {}, {}
        # a node's rows are a range of order
        self.order, self.span = np.arange(len(self.y), dtype=np.int32 if len(self.y) < 1 << 31 else np.int64), {0: (0, len(self.y))}
        self.counted = not len(self.h) or self.h.max() < HESSIAN
        if self.counted:
            self.h += COUNT

    def up(self, node: int) -> int:
        """The node's parent; those opened since are looked up first."""
        if node not in self.parent:
            self.parent = {child: i for i, s in self.tree.known.items() if s.children for child in s.children}
        return self.parent[node]

    def at(self, node: int) -> np.ndarray:
        if node not in self.span:
            up = self.up(node)
            split, rows = self.tree.known[up], self.at(up)
            right = self.bins(split.feature, rows) > split.bin
            left, (start, end) = split.children[0], self.span[up]
            ones, others = rows[~right], rows[right]
            middle = start + len(ones)
            self.order[start:middle], self.order[middle:end] = ones, others
            self.span[left], self.span[left + 1] = (start, middle), (middle, end)
        start, end = self.span[node]
        return self.order[start:end]

    def added(self, node: int) -> np.ndarray:
        """int64 sums by gradient, hessian, rows; feature; bin, as _measured() gives them; features that are not used stay 0."""
        rows = self.at(node)
        paired = np.unique(np.asarray(self.used) // 2)
        out = np.zeros((3, len(paired), 2, BINS), np.int64)
        for start in range(0, len(rows), CHUNK):
            some = rows[start : start + CHUNK].astype(np.intp)
            values = [self.g.take(some), self.h.take(some)] + ([] if self.counted else [None])
            if len(rows) >= PAIRED:
                sums = np.empty((len(values), len(paired), BINS * BINS))
                for j, p in enumerate(paired):
                    both = self.pairs[p].take(some).astype(np.intp)
                    for k, v in enumerate(values):
                        sums[k, j] = np.bincount(both, v, BINS * BINS)
                grid = sums.reshape(len(values), len(paired), BINS, BINS)
                sums = np.stack([grid.sum(3), grid.sum(2)], axis=2)
            else:
                sums = np.empty((len(values), len(paired), 2, BINS))
                for j, p in enumerate(paired):
                    both = self.pairs[p].take(some).astype(np.intp)
                    for side, bins in enumerate((both // BINS, both % BINS)):
                        for k, v in enumerate(values):
                            sums[k, j, side] = np.bincount(bins, v, BINS)
            if self.counted:
                n = np.floor(sums[1] / COUNT)
                sums = np.stack([sums[0], sums[1] - n * COUNT, n])
            out += sums.astype(np.int64)
        whole = np.zeros((3, len(self.pairs), 2, BINS), np.int64)
        whole[:, paired] = out
        whole = whole.reshape(3, -1, BINS)[:, : self.features]
        whole[:, np.setdiff1d(np.arange(self.features), self.used)] = 0
        return whole

    def measured(self, need: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        for node in need:
            if node not in self.sums and node:
                left = self.tree.known[self.up(node)].children[0]
                small = min((left, left + 1), key=lambda i: self.tree.totals[i][2])
                self.sums[small] = self.added(small)
                self.sums[2 * left + 1 - small] = self.sums[self.up(node)] - self.sums[small]
            elif node not in self.sums:
                self.sums[node] = self.added(node)
            yield node, self.sums[node]

    def move(self, made: tuple[np.ndarray, ...]) -> None:
        """Adds the tree's values to the margins."""
        feature, _, left, value = made
        nodes = [0]
        for node in nodes:
            if feature[node] >= 0:
                nodes += (int(left[node]), int(left[node]) + 1)
            else:
                self.margins[self.at(node)] += value[node]


def _grown(rows: Iterator, allowed: np.ndarray, weights: np.ndarray, trees: int, rate: float, leaves: int, least: int, l2: float) -> Iterator:
    """(model, trees as arrays) of the one model whose (model, (bins, y)) this partition holds."""
    parts = list(rows)
    if not parts:
        return
    model = parts[0][0]
    # only the model's features are held; a node's totals are read from the first one
    used = np.union1d([0], np.flatnonzero(allowed[model])).astype(int)
    held = _Rows([bins[:, used] for _, (bins, _) in parts], np.concatenate([y for _, (_, y) in parts]), weights[model], np.arange(len(used)))
    del parts
    out = []
    for _ in range(trees):
        tree = Growing()
        held.plant(tree)
        while True:
            taken, need = tree.next(leaves, least)
            if not need:
                break
            for node, sums in held.measured(need):
                tree.known[node], tree.totals[node] = _best(sums, allowed[model][used], least, l2)
        made = tree.arrays(taken, rate, l2)
        held.move(made)
        out.append(tuple(a.tolist() for a in (np.where(made[0] < 0, -1, used[made[0]]), *made[1:])))
    yield model, out


@dataclass
class Boosted:
    """Trees over columns: their features, known categories, edges by feature, and trees as arrays. Plain values, so it can be pickled and written as JSON."""

    numeric: tuple[str, ...]
    categories: tuple[tuple[str, str], ...]
    edges: list[list[float]]
    trees: list[tuple[list, list, list, list]]

    def margins(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from rows of vector(numeric, categories) to their log odds."""
        edges, score = [np.array(e) for e in self.edges], _scorer(self.trees)
        return lambda x: score(binned(x, edges))

    def margin(self) -> Column:
        """The log odds of each row. Categories that were not known count as none; features must be numbers."""
        of = self.margins()

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(of(np.stack(x.to_list()).astype(float)) if len(x) else [], dtype="float64")

        return score(vector(self.numeric, self.categories))


def vector(numeric: tuple[str, ...], categories: tuple[tuple[str, str], ...]) -> Column:
    """Numbers as they are, then a 0 or 1 for each known category."""
    return F.array(*(F.col(c).cast("double") for c in numeric), *(F.coalesce(F.col(c) == v, F.lit(False)).cast("double") for c, v in categories))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of edges below each value; a value equal to an edge stays below it."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def _edges(rows: DataFrame, numeric: tuple[str, ...]) -> list[np.ndarray]:
    cuts = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    found = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), cuts, F.lit(10_000)).alias(f"e{i}") for i, c in enumerate(numeric))).first() if numeric else ()
    return [np.unique(np.array(e if e is not None else [0.0], float)) for e in found]


def fit(rows: DataFrame, label: str, models: list[tuple[Column, tuple[str, ...]]], categorical: tuple[str, ...] = (), trees: int = 250, rate: float = 0.05, leaves: int = 15, least: int = 40, l2: float = 1.0, whole: int | None = None) -> list[Boosted]:
    """One model for each (condition for its training rows, its numeric features), side by side: those of at most `whole` rows (by default as many as
    WHOLE holds) in a task each, the others in the same passes.

    rows: a label of 0 and 1 and features without nulls; rows that no model trains on are left out, also of the bins' edges, which all models
    share. The classes of a model's rows weigh the same. A model without rows of both classes has trees without splits and a margin of 0.
    Columns of other names are not read.
    """
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    numeric = tuple(dict.fromkeys(f for _, features in models for f in features))
    member = F.array(*(F.coalesce(c, F.lit(False)) for c, _ in models))
    x = rows.withColumn("_member", member).where(F.exists("_member", lambda m: m))
    known = x.agg(*(F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in categorical)).first() if categorical else {}
    categories = tuple((c, v) for c in categorical for v in known[c])
    edges = _edges(x, numeric) + [np.array([0.0])] * len(categories)
    allowed = np.array([[f in features for f in numeric] + [True] * len(categories) for _, features in models])
    y = F.col(label).cast("int")
    counts = x.agg(*(F.count_if(F.col("_member")[i] & (y == c)).alias(f"n{i}_{c}") for i in range(len(models)) for c in (0, 1))).first()
    sizes = np.array([[counts[f"n{i}_{c}"] for c in (0, 1)] for i in range(len(models))], float)
    both = (sizes > 0).all(axis=1, keepdims=True)
    weights = np.where(both, sizes.sum(axis=1, keepdims=True) / (2 * np.maximum(sizes, 1)), 0.0)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n:
                values = binned(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), edges)
                members = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"n": [n], "bins": [values.tobytes()], "y": [b.column(1).to_numpy(zero_copy_only=False).astype(np.int8).tobytes()], "member": [members.tobytes()]}, schema=pa.schema([("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("member", pa.binary())]))

    path, schema = new_path(spark, "bins"), "n int, bins binary, y binary, member binary"
    x.select(vector(numeric, categories).alias("x"), y.alias("y"), "_member").mapInArrow(block, schema).write.parquet(path)
    m = len(models)

    def arrays(r) -> tuple:
        return np.frombuffer(r.bins, np.uint8).reshape(r.n, -1), np.frombuffer(r.y, np.int8), np.frombuffer(r.member, np.uint8).reshape(r.n, m).astype(bool), np.zeros((r.n, m))

    small = sizes.sum(axis=1) <= (WHOLE // (len(numeric) + len(categories) + BESIDE) if whole is None else whole)
    # tasks start in this order
    place = {int(i): k for k, i in enumerate(sorted(np.flatnonzero(both[:, 0] & small), key=lambda i: -sizes[i].sum()))}
    out = [[] for _ in models]

    def own(r) -> Iterator:
        bins, label, members, _ = arrays(r)
        for i in place:
            at = np.flatnonzero(members[:, i])
            if len(at):
                yield i, (bins[at], label[at])

    blocks = spark.read.schema(schema).parquet(path).rdd
    if place:
        apart = blocks.flatMap(own).partitionBy(len(place), place.__getitem__)
        for i, made in apart.mapPartitions(lambda b: _grown(b, allowed, weights, trees, rate, leaves, least, l2)).collect():
            out[i] = made
    passed = both[:, 0] & ~small
    if not passed.any():
        files.delete(spark, path)
        stump = [tuple(a.tolist() for a in Growing().arrays([], rate, l2)) for _ in range(trees)]
        return [Boosted(numeric, categories, [e.tolist() for e in edges], trees_of or stump) for trees_of in out]
    sc.setCheckpointDir(shared_folder(spark))
    state = blocks.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)
    older, cuts = None, []
    for t in range(trees):
        growing = [Growing() for _ in models]
        while True:
            steps = [g.next(leaves, least) for g in growing]
            plan = [(i, growing[i].arrays(taken), need) for i, (taken, need) in enumerate(steps) if need and passed[i]]
            if not plan:
                break
            measured = state.mapPartitions(lambda b, plan=plan: _measured(b, plan, weights)).reduceByKey(np.add)
            found = measured.map(lambda kv: (kv[0], _best(kv[1], allowed[kv[0][0]], least, l2))).collect()
            for (i, node), (split, totals) in found:
                growing[i].known[node], growing[i].totals[node] = split, totals
            for i, _, need in plan:
                for node in need:
                    growing[i].known.setdefault(node, Split(0.0))
            if older is not None:
                older.unpersist()
                older = None
        made = [g.arrays(steps[i][0], rate, l2) for i, g in enumerate(growing)]
        for i, tree in enumerate(made):
            if i not in place:
                out[i].append(tuple(a.tolist() for a in tree))
        if t + 1 == trees:
            break
        shift = [(i, tree) for i, tree in enumerate(made) if passed[i]]
        older, state = state, state.mapPartitions(lambda b, shift=shift: _moved(b, shift)).persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % CUT == 0:
            state.checkpoint()
            state.count()
            cuts.append(state.getCheckpointFile())
            for old in cuts[:-1]:
                files.delete(spark, old)
            cuts = cuts[-1:]
    state.unpersist()
    for old in cuts:
        files.delete(spark, old)
    files.delete(spark, path)
    return [Boosted(numeric, categories, [e.tolist() for e in edges], trees_of) for trees_of in out]
