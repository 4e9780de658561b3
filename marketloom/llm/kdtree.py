"""Exact top-k inner-product search with a KD-tree per shard.

Vectors are dealt to shards by median splits fitted on a bounded sample (SAMPLE_ROWS), so that a shard holds neighbours; a cell with
more rows than a shard may hold is cut further by hash. Each shard becomes one row with its KD-tree (median
splits on the widest side, a tight bounding box per node) and its own box. Queries travel in blocks of bounded size.

A query visits its own shard first. The score of its k-th neighbour there removes all shards whose box cannot hold a better one; the others
are visited in order of their bound, one, then two, then four and so on, and each round starts from the k-th score
that the rounds before have reached. Within a shard nodes are taken best bound first, with that score as the floor.
A query's best of all shards are merged by a grouped sort of k rows a shard.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.storage import scratch, written

SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 4096, 64, 256
#: Vectors that the splits between shards are fitted on, cells that these make at most, and boxes of shards that meet a block of queries at once.
SAMPLE_ROWS, MOST_CELLS, BLOCK_BOXES = 20_000, 1024, 1024


class KDTree:
    """Median splits down to leaves; boxes are tight around each node's points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        order, self.nodes = np.argsort(ids, kind="stable"), []
        ids, points = ids[order], points[order]
        at = np.arange(len(ids))
        low, high = [], []

        def build(begin: int, end: int) -> int:
            own, node = points[at[begin:end]], len(self.nodes)
            self.nodes.append(None)
            low.append(own.min(0))
            high.append(own.max(0))
            side = int((high[node] - low[node]).argmax())
            if end - begin <= leaf or high[node][side] == low[node][side]:
                self.nodes[node] = (begin, end, -1, -1)
                return node
            middle = (end - begin) // 2
            at[begin:end] = at[begin:end][np.argpartition(own[:, side], middle)]
            self.nodes[node] = (begin, end, build(begin, begin + middle), build(begin + middle, end))
            return node

        build(0, len(ids))
        self.ids, self.points, self.low, self.high = ids[at], points[at], np.array(low), np.array(high)
        self.exact = float(np.abs(self.points).max(initial=0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, a score that no point of the node exceeds."""
        high = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        return high if self._fits(queries) else high + np.abs(high) * 1e-9 + 1

    def _fits(self, queries: np.ndarray) -> bool:
        """Whether all inner products are exact in doubles."""
        return self.exact * float(np.abs(queries).max(initial=0)) * queries.shape[1] < 2**52

    def search(self, names: np.ndarray, queries: np.ndarray, reach: list, k: int) -> list[tuple[int, int, int]]:
        """(query, vector, score) of the k best for each query, but itself, that reach its bound (None: none yet)."""
        integers, exact, out = self.points.astype(np.int64), self._fits(queries), []
        for name, query, limits, least in zip(names.tolist(), queries, self.bounds(queries), reach, strict=True):
            best: list[tuple[int, int]] = []  # (score, -id), the worst first
            heap = [(-limits[0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if (least is not None and -bound < least) or (len(best) == k and -bound < best[0][0]):
                    break
                begin, end, left, right = self.nodes[node]
                if left >= 0:
                    heapq.heappush(heap, (-limits[left], left))
                    heapq.heappush(heap, (-limits[right], right))
                    continue
                scores = (self.points[begin:end] @ query).astype(np.int64) if exact else integers[begin:end] @ query.astype(np.int64)
                floor = max(-(2**63) if least is None else least, best[0][0] if len(best) == k else -(2**63))
                for i in np.flatnonzero(scores >= floor).tolist():
                    found = (int(scores[i]), -int(self.ids[begin + i]))
                    if -found[1] == name:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
            out += ((name, -i, s) for s, i in best)
        return out


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, dim, v: floor(scale * component) in whole doubles. Rows that are null, or hold null or non-finite components, are left out."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(ok)
    return rows.select(F.col("vec_id").cast("long"), F.size("embedding").alias("dim"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Cells:
    """Median splits of a sample on its widest sides: a number for every vector, near for near ones."""

    def __init__(self, points: np.ndarray, cells: int):
        self.splits: list[tuple[int, float, int, int]] = []  # side, value, below, above; -1 - number for a cell
        self.count = 0

        def build(own: np.ndarray, cells: int) -> int:
            side = int(np.ptp(own, axis=0).argmax()) if len(own) else 0
            if cells < 2 or len(own) < 4 or np.ptp(own[:, side]) == 0:
                self.count += 1
                return -self.count
            middle = float(np.median(own[:, side]))
            below = own[:, side] < middle
            if not below.any():
                middle = float(own[:, side][own[:, side] > middle].min())
                below = own[:, side] < middle
            at = len(self.splits)
            self.splits.append((side, middle, 0, 0))
            self.splits[at] = (side, middle, build(own[below], cells // 2), build(own[~below], cells - cells // 2))
            return at

        self.root = build(points, cells)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root)
        while (some := np.flatnonzero(node >= 0)).size:
            for at in np.unique(node[some]).tolist():
                here = some[node[some] == at]
                side, value, below, above = self.splits[at]
                node[here] = np.where(points[here, side] < value, below, above)
        return -1 - node


def _dealt(rows: DataFrame, shard_rows: int) -> DataFrame:
    """rows(vec_id, dim, v) with `shard`; shards hold about `shard_rows` rows of one dim."""
    n = rows.count()
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("dim", "v").toArrow()
    dims, points, cells = some.column("dim").to_numpy(), some.column("v").to_pylist(), {}
    for dim in np.unique(dims).tolist():
        own = np.array([p for p, d in zip(points, dims.tolist(), strict=True) if d == dim])
        cells[dim] = Cells(own, max(1, min(MOST_CELLS, round(len(own) / len(dims) * n / shard_rows))))

    def number(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            out = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                if dim in cells:  # a length that is not in the sample is one cell
                    own = np.flatnonzero(dims == dim)
                    out[own] = cells[dim].of(_matrix(batch.column(2).take(pa.array(own)), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["vec_id", "dim", "v", "cell"])

    dealt = written(rows.select("vec_id", "dim", "v").mapInArrow(number, "vec_id long, dim int, v array<double>, cell long"), "cells")
    sizes = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(1.5 * shard_rows)).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts"))
    return dealt.join(F.broadcast(sizes), ["dim", "cell"]).select("vec_id", "dim", "v", (F.col("cell") * F.lit(1 << 32) + part).alias("shard"))  # MOST_CELLS rows a vector length at most


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k vectors of highest integer inner product for each query row, but itself: query_id, rank, vec_id, score.

    vectors(vec_id, embedding, ...); is_query is a condition on vec_id. Components become floor(scale * x). Scores are
    exact; ties go to the smaller vec_id. Vectors that are null, or hold null or non-finite components, take no part; vectors of
    different length are never compared. With fewer than k others a query has them all, with none no row. A vec_id that
    repeats counts once for each different vector, and never for itself. Other columns are ignored; no rows give no rows.
    """
    with scratch(vectors.sparkSession):
        rows = written(_dealt(written(integer_vectors(vectors, scale).where("dim > 0").distinct(), "vectors"), shard_rows), "shards")
        queries = rows.where(is_query)
        blocks = max(1, -(-queries.count() // block_queries))
        trees = written(_trees(rows), "trees")

        def visit(asked: DataFrame) -> DataFrame:
            return _visited(_packed(asked, ["dim", "shard"], blocks), trees, k)

        by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

        def best(found: DataFrame) -> DataFrame:
            """The k best so far, and in `reach` the score that a better one must have."""
            return written(found.distinct().withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).drop("rank"), "best")

        def reach(found: DataFrame) -> DataFrame:
            return found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("reach")).withColumnRenamed("query_id", "vec_id")

        found = best(visit(queries.withColumn("reach", F.lit(None).cast("long"))))
        asked = queries.withColumnRenamed("shard", "home").join(reach(found).hint("merge"), "vec_id", "left")
        order = Window.partitionBy("vec_id", "home").orderBy(F.desc("bound"), "shard")
        plan = _bounded(asked, trees, blocks).withColumn("turn", F.floor(F.log2(F.row_number().over(order))).cast("int"))
        plan = written(plan, "plan")
        for turn in range((plan.agg(F.max("turn")).first()[0] or 0) + 1):
            now = plan.where(F.col("turn") == turn).join(reach(found).hint("merge"), "vec_id", "left").where("reach is null or bound >= reach")
            now = now.join(queries.withColumnRenamed("shard", "home").hint("merge"), ["vec_id", "home"])
            found = best(found.unionByName(visit(now.select("vec_id", "dim", "v", "reach", "shard"))))
        return written(found.select("query_id", F.row_number().over(by_query).cast("int").alias("rank"), "vec_id", "score"), "top", keep=True)


def _trees(rows: DataFrame) -> DataFrame:
    """dim, shard, tree, and the shard's box: low, high."""

    def tree(table):
        dim = table.column("dim")[0].as_py()
        built = KDTree(table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim))
        box = [pa.array([x[0].tolist()], pa.list_(pa.float64())) for x in (built.low, built.high)]
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(built)], pa.binary()), "low": box[0], "high": box[1]})

    return rows.groupBy("dim", "shard").applyInArrow(tree, "dim int, shard long, tree binary, low array<double>, high array<double>")


def _packed(asked: DataFrame, by: list[str], blocks: int) -> DataFrame:
    """asked(vec_id, dim, v, reach, ...) in blocks of queries that have the columns `by` in common: these and `queries`."""

    def block(table):
        dim = table.column("dim")[0].as_py()
        body = {c: table.column(c).to_numpy() for c in table.column_names if c in ("vec_id", "home")}
        body |= {"v": _matrix(table.column("v"), dim), "reach": table.column("reach").to_pylist()}
        keys = {c: pa.array([table.column(c)[0].as_py()], pa.int32() if c == "dim" else pa.int64()) for c in by}
        return pa.table(keys | {"queries": pa.array([pickle.dumps(body)], pa.binary())})

    types = dict(asked.dtypes)
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)))
    return dealt.groupBy(*by, "block").applyInArrow(block, ", ".join(f"{c} {types[c]}" for c in by) + ", queries binary")


def _visited(packed: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: what each packed block finds in its shard."""

    def run(batches):
        for batch in batches:
            for t, q in zip(batch.column(0), batch.column(1), strict=True):
                asked = pickle.loads(q.as_buffer())
                found = pickle.loads(t.as_buffer()).search(asked["vec_id"], asked["v"], asked["reach"], k)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    met = packed.join(trees.select("dim", "shard", "tree").hint("merge"), ["dim", "shard"]).select("tree", "queries")
    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def _bounded(asked: DataFrame, trees: DataFrame, blocks: int) -> DataFrame:
    """vec_id, home, shard, bound: the shards but its own whose box may hold a score that a query does not reach yet.

    Blocks of queries meet blocks of boxes; only boxes travel, no vectors.
    """
    groups = max(1, -(-trees.count() // BLOCK_BOXES))
    boxes = trees.select("dim", "shard", "low", "high", F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("group"))
    boxes = boxes.groupBy("dim", "group").agg(F.collect_list(F.struct("shard", "low", "high")).alias("boxes"))
    packed = _packed(asked, ["dim"], blocks).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(batches):
        for batch in batches:
            for q, b in zip(batch.column(0), batch.column(1), strict=True):
                asked, shards = pickle.loads(q.as_buffer()), b.values
                dim = asked["v"].shape[1]
                shard, low, high = shards.field("shard").to_numpy(), _matrix(shards.field("low"), dim), _matrix(shards.field("high"), dim)
                limit = np.maximum(asked["v"], 0) @ high.T + np.minimum(asked["v"], 0) @ low.T
                limit += np.abs(limit) * 1e-9 + 1
                floor = np.array([-np.inf if r is None else r for r in asked["reach"]], float)
                i, j = np.nonzero((limit >= floor[:, None]) & (shard[None, :] != asked["home"][:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(asked["vec_id"][i]), pa.array(asked["home"][i]), pa.array(shard[j]), pa.array(limit[i, j])], ["vec_id", "home", "shard", "bound"])

    met = packed.join(boxes.hint("merge"), ["dim", "group"]).select("queries", "boxes")
    return met.mapInArrow(run, "vec_id long, home long, shard long, bound double")
