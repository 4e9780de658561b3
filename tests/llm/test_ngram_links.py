import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm.ngram_join import _packed, _roots, _similar_pairs, _unpacked, jaccard_components, jaccard_join, jaccard_links


def shingles(text, size):
    words = (text or "").lower().split()
    return frozenset(tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))) if words else frozenset()


def similar(s, t, percent):
    return bool(s) and 100 * len(s & t) >= percent * len(s | t)


@pytest.mark.parametrize("size,percent,hot,width", [(3, 90, 1 << 13, 1 << 14), (5, 80, 1 << 13, 1 << 14), (3, 90, 8, 1 << 16), (5, 80, 8, 1 << 16)])
def test_links_within_groups_of_near_copies_equal_brute_force(spark, size, percent, hot, width):
    rng = random.Random(7)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(45):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += texts[:3] + [None, "", "one two", "ONE two"]
    sets = [shingles(t, size) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, links = jaccard_links(docs, size, percent, width, hot)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s if s else i, i)
    reps = sorted(first[s] for s in first if s in set(sets))
    reps = [i for i in reps if sets[i]]
    wanted = {(a, b) for a in reps for b in reps if a < b and similar(sets[a], sets[b], percent)}
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 300
    assert {r.doc_id: r.representative for r in members.collect()} == {i: first[s] if s else i for i, s in enumerate(sets)}
    n_links = Counter(a for a, s in enumerate(sets) for b, t in enumerate(sets) if a != b and similar(s, t, percent))
    joined = jaccard_join(docs, size, percent, width, hot).collect()
    assert {r.doc_id: r.n_links for r in joined} == {i: n_links[i] for i in range(len(sets))}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in joined} == {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, size, percent, width, hot).collect()}


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_common_members_and_roots(percent):
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 250), rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(40)]
    for cut in (0, 7, 39):
        x, y = _similar_pairs(sets, cut, percent)
        pairs = [(i, j) for i in range(cut or 40) for j in range(cut or i + 1, 40)]
        wanted = {(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        assert set(zip(x.tolist(), y.tolist())) == wanted and len(x) == len(wanted)
    assert _roots(np.array([2, 5, 7, 9, 11]), np.array([0, 3]), np.array([2, 4])).tolist() == [2, 5, 2, 9, 9]


def test_repeated_rows_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, 1, "x"), (1, base, 1, "x"), (2, base + " x", 1, "y"), (3, "other words here now", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, signature string").withColumn("prefix", F.lit("p")).withColumn("chunk", F.lit(1)).withColumn("blocks", F.lit(2)).withColumn("weight", F.lit(3))
    got = sorted(tuple(r) for r in jaccard_join(docs, 3, 90).collect())
    assert got == [(1, 58, 1, 1), (1, 58, 1, 1), (2, 59, 1, 1), (3, 2, 3, 0)]
    assert sorted(tuple(r) for r in jaccard_components(docs, 3, 90).collect()) == [t[:3] for t in got]


def test_texts_joined_by_a_shuffle_give_the_same_links(spark, sf_small, monkeypatch):
    from marketloom.llm import ngram_join

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    wanted = sorted(tuple(r) for r in jaccard_join(docs, 3, 90).collect())
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in jaccard_join(docs, 3, 90).collect()) == wanted and any(r[3] for r in wanted)


@pytest.mark.parametrize("n", [0, 1, 2, 300, 200_000])
def test_packed_sets_keep_the_upper_bits(n):
    rng = np.random.default_rng(n)
    s = np.unique(np.concatenate([rng.integers(0, 2**64, n, np.uint64), np.array([0, 1, 2**64 - 1] if n > 2 else [], np.uint64)]))
    packed = _packed(s)
    assert len(packed) == 6 * len(s) and (_unpacked(packed) == s >> np.uint64(16)).all() and len(_unpacked(packed)) == len(s)
