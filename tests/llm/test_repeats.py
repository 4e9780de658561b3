import hashlib

import numpy as np
import pytest

from marketloom.llm.repeats import phrases, remove_repeats


def brute(rows, span=50):
    owner, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in texts:
        for s in range(len(raw) - span + 1):
            key = raw[s : s + span]
            if i is not None and (key not in owner or owner[key] > i):
                owner[key] = i
    for i, raw in texts:
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - span + 1):
            if i is not None and owner[raw[s : s + span]] < i:
                gone[s : s + span] = True
        gone = gone[:-1] if len(raw) else np.zeros(0, bool)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **more):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, **more).collect()), key=str)


@pytest.mark.parametrize("hot", [2_000, 1])
def test_equals_brute_force_on_a_small_table(spark, sf_small, hot):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").repartition(5)
    assert got(docs, hot_contexts=hot) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(spark):
    a = "".join(map(chr, np.random.default_rng(3).integers(97, 123, 400)))
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 1000), (6, a), (7, a), (7, a[:120] + "é" * 40), (8, "zz" + a[37:87] + "!"), (9, a[:49]), (10, "é" * 60), (None, a), (11, a[10:80] + a[10:80]), (0, a[350:]), (12, ("ab" * 100_000))]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, tag string")
    assert got(docs.repartition(4)) == brute(rows)
    full = {r.doc_id: r for r in remove_repeats(docs.where("doc_id in (0, 6, 8)")).collect()}
    assert full[8].kept == "zz!" and full[8].spans == [(2, 52)] and full[6].kept == a[:350]
    assert remove_repeats(docs.limit(0)).count() == 0
    assert {r.tag for r in remove_repeats(docs, carry=("tag",)).collect()} == {"c"}


def test_every_string_has_a_phrase():
    data = np.random.default_rng(1).integers(97, 100, 3000).astype(np.uint8)
    at = np.array([0, 10, 10, 60, 500, 549, 3000])
    document, first, last, _, _ = phrases(data, at, 50, 20)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    wanted = np.concatenate([np.arange(a, b - 49) for a, b in zip(at[:-1], at[1:], strict=True) if b - a >= 50])
    assert (covered == wanted).all() and ((at[document] <= first) & (last + 50 <= at[document + 1])).all()
