import hashlib

import duckdb
import numpy as np
import pytest

from marketloom.llm import codes, oracles


def brute(rows):
    """The contract in plain loops over (vec_id, vector, label)."""
    kept = sorted((i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64), x) for i, v, x in rows if v and all(c is not None and np.isfinite(c) for c in v))
    parts = [np.stack([np.split(v, 4)[p] for _, v, _ in kept]) for p in range(4)]
    books = [x[:256].copy() for x in parts]

    def assign():
        far = [((x[:, None] - b[None]) ** 2).sum(2) for x, b in zip(parts, books, strict=True)]
        return [d.argmin(1) for d in far], sum(d.min(1) for d in far)

    for _ in range(4):
        for b, x, own in zip(books, parts, assign()[0], strict=True):
            for e in set(own.tolist()):
                b[e] = x[own == e].sum(0) // (own == e).sum()
    own, error = assign()
    total = {}
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted((i, "".join(f"{o[k]:02x}" for o in own), int(error[k]), total[x], sha) for k, (i, _, x) in enumerate(kept))


def got(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_equals_brute_force_and_sql(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    found = got(codes.code_errors(df))
    assert found == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{sf_small}/embeddings.parquet'")
    assert found == sorted(duck.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({oracles.product_codes()})").fetchall())


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 2)], [1, 2, None][i % 3]) for i in range(400)]
    rows += [(1000 + i, rows[7][1], None) for i in range(300)]  # many equal vectors, a hot label
    odd = [(3, None, 1), (4, [nan] * 8, 1), (5, [inf] + [0.0] * 7, 1), (6, [None] + [0.0] * 7, 2), (7, [], 2)]
    df = spark.createDataFrame([(*r, "x", 5, True) for r in rows + odd], "vec_id long, embedding array<float>, label int, code string, _label int, _hot boolean")
    rows = [(i, np.array(v, np.float32).tolist(), x) for i, v, x in rows]
    assert got(codes.code_errors(df)) == brute(rows)
    assert got(codes.code_errors(df.where("vec_id between 3 and 7").where("embedding is null or size(embedding) = 0"))) == []
    few = df.where("vec_id in (0, 1, 1000)")  # fewer vectors than entries
    assert got(codes.code_errors(few)) == brute([r for r in rows if r[0] in (0, 1, 1000)])
    twice = got(codes.code_errors(few.unionByName(few)))
    assert len(twice) == 6 and twice[::2] == twice[1::2]
    mixed = few.unionByName(spark.createDataFrame([(2000, [1.0], 1, "x", 5, True), (None, [0.5] * 8, 1, "x", 5, True), (2001, [1e30] * 8, 1, "x", 5, True)], few.schema))
    assert [r.vec_id for r in codes.code_errors(mixed).orderBy("vec_id").collect()] == [None, 0, 1, 1000]  # another length and too large: no part; no id: coded
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], "vec_id long, embedding array<double>, label int"))


def test_masks_give_the_nearest_entry_exactly():
    rng = np.random.default_rng(0)
    for n, d in ((256, 16), (100, 3), (1, 2), (65, 1)):
        entries, x = rng.integers(-50, 50, (n, d)), rng.integers(-80, 80, (3000, d))
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        index, error = codes.nearest(codes.sliced(entries), x)
        assert (index == far.argmin(1)).all() and (error == far.min(1)).all()


def test_decoding_gives_the_error(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    found, books = codes.compress(df)
    rows = {r.vec_id: (np.array(r.decoded), r.error) for r in codes.decode(found, books).collect()}
    for r in df.collect():
        assert int(((np.floor(1024 * np.array(r.embedding)) - rows[r.vec_id][0]) ** 2).sum()) == rows[r.vec_id][1]
