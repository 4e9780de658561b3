import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm.kdtree import KDTree, top_k


def brute(rows, every, k=10):
    out = {}
    good = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, x in good:
        if q % every == 0:
            found = sorted({(-int(x @ y), i) for i, y in good if i != q and len(y) == len(x)})[:k]
            out.setdefault(q, set()).update(found)
    return {q: [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(f)[:k])] for q, f in out.items() if f}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("shard_rows,block", [(4096, 256), (60, 3)])
def test_equals_brute_force_on_a_small_table(spark, sf_small, shard_rows, block):
    df = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(top_k(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows, block_queries=block)) == brute(rows, 20)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1e9, -1e9]), (8, [1.0]), (100, []), (None, [1.0, 1.0]), (200, [-1.0, -2.0]), (300, [1.0]), (400, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, dim int")
    assert got(top_k(df, F.col("vec_id") % 100 == 0, shard_rows=2, block_queries=1)) == brute(rows, 100)
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    twice = df.unionByName(df)
    assert got(top_k(twice, F.col("vec_id") % 100 == 0)) == brute(rows, 100)


def test_boxes_are_tight_and_bound_all_points():
    rng = np.random.default_rng(0)
    tree = KDTree(np.arange(500), np.floor(rng.normal(size=(500, 5)) * 1000), leaf=8)
    query = np.floor(rng.normal(size=(1, 5)) * 1000)
    limits = tree.bounds(query)[0]
    for node, (a, b, left, right) in enumerate(tree.nodes):
        assert (tree.points[a:b].min(0) == tree.low[node]).all() and (tree.points[a:b] @ query[0]).max() <= limits[node]
        assert left < 0 or abs((tree.nodes[left][1] - tree.nodes[left][0]) - (tree.nodes[right][1] - tree.nodes[right][0])) <= 1
