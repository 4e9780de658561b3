import zlib

import numpy as np

from marketloom.llm.toxicity import LabelModel, score


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    y, s, p = (np.array([r[c] for r in held]) for c in ("toxic", "score", "predicted"))
    order = np.argsort(np.argsort(s, kind="stable")) + 1
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    print(auc, p[y == 1].mean(), y[p == 1].mean())
    assert auc > 0.93 and p[y == 1].mean() > 0.85 and y[p == 1].mean() > 0.9


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "you are an idiot, moron and loser"), (4, "the cat sat"), (4, "the cat sat"), (None, "x"), (5, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, toxic int, votes string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score(docs, empty).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[3] > by[4] and by[1] == by[2]
    odd = spark.createDataFrame([(4, None, None), (None, 1, 1), (3, 1, 1), (3, 1, 0), (4, 0, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert score(docs, odd).count() == len(rows)
    assert score(docs.limit(0), empty).count() == 0


def test_label_model_finds_planted_accuracies_and_ties():
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.2
    right = [0.95, 0.8, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(len(y)) < a, y, ~y) for a in right], 1) * 2
    votes = np.concatenate([votes, np.where(rng.random((len(y), 1)) < 0.95, votes[:, 1:2], 2 - votes[:, 1:2])], 1)
    patterns, where = np.unique(votes, axis=0, return_inverse=True)
    gold = np.zeros((len(patterns), 2))
    np.add.at(gold, (where[:500], y[:500].astype(int)), 1)
    model = LabelModel(patterns, np.bincount(where[500:], minlength=len(patterns)).astype(float), gold)
    assert {1, 4} in [{v, p} for v, p in enumerate(model.parents)]
    p = model.posterior()[where]
    assert ((p > 0.5) == y).mean() > 0.95 and abs(p.mean() - 0.2) < 0.03
