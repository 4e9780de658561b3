import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import fmindex, oracles

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, n=10):
    sought = {}
    for i, t in items:
        w = split(t)
        for j in range(max(1, len(w) - n + 1) if w else 0):
            sought.setdefault(tuple(w[j : j + n]), set()).add(i)
    lengths, out = {len(k) for k in sought}, []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for m in lengths:
            for j in range(len(w) - m + 1):
                if (own := sought.get(tuple(w[j : j + m]))) is not None:
                    hit.update(range(j, j + m))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_equals_brute_force_and_sql(spark, sf_small):
    docs, items = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    found = got(fmindex.contamination(docs, items))
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[2] for r in found)
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    assert found == sorted(duck.execute(f"select doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ({oracles.DECONTAMINATION})").fetchall(), key=str)


TEN = "one two three four five six seven eight nine ten"
DOCS = [(1, f"{TEN} eleven. {TEN}"), (2, None), (3, ""), (4, "ONE  two-three\nfour five six seven eight nine TEN"), (5, "ñandú été"), (5, "ñandú été"), (None, f"a {TEN}"), (6, "one two three"), (7, "...!"), (8, f"{TEN} eleven twelve " * 3), (9, "Ñandú")]
ITEMS = [(1, TEN + " eleven twelve"), (1, TEN + " eleven twelve"), (20, "ñandú"), (3, None), (4, ""), (5, "?!"), (None, "one two three four five six seven eight nine ten"), (7, "twelve one"), (100, "it is not there")]


@pytest.mark.parametrize("block", [1 << 20, 12])
def test_edge_cases(spark, block):
    docs = spark.createDataFrame([(*r, "x", "y") for r in DOCS], "doc_id long, text string, shard string, spans string")
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id int, text string, place int")
    found = fmindex.find(fmindex.index_shards(docs), items, block=block)
    rows = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in found.collect()), key=str)
    want = brute(DOCS, ITEMS)
    assert [(r[:3], hashlib.sha256(",".join(r[3]).encode()).hexdigest()) for r in rows] == [(w[:3], w[4]) for w in want]
    for r in found.collect():
        assert all(a.end < b.start for a, b in zip(r.spans[:-1], r.spans[1:], strict=True))
    assert fmindex.contamination(docs.limit(0), items).count() == 0
    assert got(fmindex.contamination(docs, items.limit(0))) == brute(DOCS, [])


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(1, f"Start {TEN}, end."), (2, "été ñandú!"), (3, None), (4, "clean")], "doc_id long, text string").withColumn("kept", F.lit("k"))
    items = spark.createDataFrame([(1, TEN), (2, "ñandú")], "item_id long, text string")
    kept = {r.doc_id: r.kept for r in fmindex.remove_spans(docs, fmindex.decontaminate(docs, items)).collect()}
    assert kept == {1: "Start , end.", 2: "été !", 3: None, 4: "clean"}


def test_suffixes_are_in_full_order_and_every_word_is_located():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(40)] + ["a " * 300] * 3 + ["", "b"]
    data = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, data)])
    index = fmindex.build(np.frombuffer(b"".join(data), np.uint8), at)
    words = [t.split() for t in texts]
    symbols = np.array([s for w in words for s in [*(ord(x) - 96 for x in w), 0]])
    sa = fmindex.suffixes(symbols, 3)
    keys = [[(x, 0) if x else (0, k) for k, x in enumerate(symbols[i:], i)] for i in range(len(symbols))]
    assert sa.tolist() == sorted(range(len(symbols)), key=keys.__getitem__)
    assert sorted(index.locate(np.flatnonzero(symbols[sa] > 0)).tolist()) == np.flatnonzero(symbols > 0).tolist()
    flat = [x for w in words for x in [*w, "|"]]
    for phrase in (["a"], ["a", "b"], ["c", "a", "a"], ["a"] * 200, ["z"]):
        starts, ends, _ = fmindex.words(np.frombuffer(p := " ".join(phrase).encode(), np.uint8), np.array([0, len(p)]))
        _, found = index.search(fmindex.span_hashes(np.frombuffer(p, np.uint8), starts, ends, fmindex._CODES)[None])
        assert sorted(found.tolist()) == [i for i in range(len(flat)) if flat[i : i + len(phrase)] == phrase]
