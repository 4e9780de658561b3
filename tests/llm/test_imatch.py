import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import imatch


def edits(rows):
    """doc_id -> (n_chars, sha256 of the edited text, the edited text, next doc_id), for distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (name, text) in enumerate(order):
        text, (follower, after) = text or "", order[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (after or "")[:half]
        out[name] = len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, follower
    return out


@pytest.mark.parametrize("rows_per_bucket", [1000, 7])
def test_whole_table(spark, sf_small, rows_per_bucket, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", rows_per_bucket)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, got = edits(rows), {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    assert set(got) == set(want)
    text = dict(rows)
    split = lambda t: {x for x in re.split(r"[\W_]+", t.lower()) if x}
    frequency = Counter(x for t in text.values() for x in split(t))
    masks = {r.term: r.mask for r in imatch.lexicon(docs).collect()}
    assert set(masks) == {x for x, n in frequency.items() if 0.002 * len(rows) <= n <= 0.05 * len(rows)}

    def marks(t):
        own = sorted(x for x in split(t) if x in masks)
        parts = [[x for x in own if masks[x] >> k & 1] for k in range(24)]
        out = ":".join(hashlib.md5(" ".join(p).encode()).hexdigest()[:8] if p else "-" for p in parts)
        return out if set(out) - {"-", ":"} else "text:" + hashlib.md5(t.encode()).hexdigest()

    def like(x, y):
        if x.startswith("text:") or y.startswith("text:"):
            return float(x == y)
        pairs = [(a, b) for a, b in zip(x.split(":"), y.split(":"), strict=True) if (a, b) != ("-", "-")]
        return sum(a == b for a, b in pairs) / len(pairs)

    for i, (n, sha, edited, follower) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha, marks(text[i]), marks(edited))
        assert r.near_edited == pytest.approx(like(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(like(r.fingerprint, got[follower].fingerprint))
    assert np.mean([r.near_edited for r in got.values()]) > 3 * np.mean([r.near_next for r in got.values()])


def test_edge_cases(spark):
    rows = [(5, None), (4, ""), (3, "x"), (2, "Ab cd"), (1, "ab CD ef"), (0, "\U0001F600é" * 5), (7, "a b " * 40_000)]
    df = spark.createDataFrame([(i, t, "c", 1.0) for i, t in rows], "doc_id long, text string, bucket string, near_next double")
    got = {r.doc_id: r for r in imatch.fingerprints(df).collect()}
    for i, (n, sha, _, _) in edits(rows).items():
        assert (got[i].n_chars, got[i].edited_sha256) == (n, sha)
    assert all(0 <= x <= 1 for r in got.values() for x in (r.near_edited, r.near_next)) and got[5].near_next == 1
    assert imatch.fingerprints(df.limit(0)).count() == 0
    assert imatch.fingerprints(df.where("doc_id = 2")).first().near_next == 1
    more = spark.createDataFrame([(None, "q"), (None, "r"), (1, "same"), (1, "same"), (1, None)], "doc_id long, text string")
    assert imatch.fingerprints(more).count() == 5


def test_rows_without_id_come_last_in_the_order_of_their_hash(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 9)
    rows = [(i if i % 3 else None, f"text {i % 70} " * (1 + i % 5)) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = df.orderBy(imatch.F.col("doc_id").desc_nulls_last(), imatch.F.xxhash64("text")).collect()
    want = []
    for i, r in enumerate(order):
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + order[(i + 1) % len(order)].text[:half]
        want.append((r.doc_id, hashlib.sha256(edited.encode()).hexdigest()))
    assert Counter(want) == Counter((r.doc_id, r.edited_sha256) for r in imatch.fingerprints(df).collect())
