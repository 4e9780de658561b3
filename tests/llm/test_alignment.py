import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from marketloom.llm import alignment
from marketloom.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain(texts):
    """The contract for whole texts, without units, runs or caches."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    a_bytes, b_bytes = alignment._Side(A).token, alignment._Side(B).token
    rows = []
    for text in texts:
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        if any(b"".join(t[i] for i in ids) != (" " + text).encode() for t, ids in ((a_bytes, a), (b_bytes, b)) if ids):
            a, b = [], []
        owner = [[k for k, i in enumerate(ids) for _ in t[i]] for t, ids in ((a_bytes, a), (b_bytes, b))]
        links = sorted(set(zip(*owner, strict=True)))
        ends = [{sum(map(len, (t[i] for i in ids[: k + 1]))): k + 1 for k in range(len(ids))} for t, ids in ((a_bytes, a), (b_bytes, b))] if len(a) < 400 else None
        groups = None
        if ends is not None:
            cuts, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
            for c in cuts:
                groups.append(",".join(map(str, a[i : ends[0][c]])) + "|" + ",".join(map(str, b[j : ends[1][c]])))
                i, j = ends[0][c], ends[1][c]
        rows.append((len(a), len(b), [(b[y], a[x]) for x, y in links], groups))
    count, most = collections.Counter(p for r in rows for p in r[2]), {}
    for (b, _), c in count.items():
        most[b] = max(c, most.get(b, 0))
    full = [(a, b, len(p), sum(count[x] == most[x[0]] for x in p), sum(count[x] for x in p), None if g is None else (len(g), ";".join(g))) for a, b, p, g in rows]
    return full, sorted((b, a, c, c == most[b]) for (b, a), c in count.items())


ODD = ["", None, " ", "  a  b ", "a\n  b\t c", "x▁y", "　 a", "<s> </s> <|endoftext|> hi", "\x00a b\x00 c", "é ü  ñ 日本 語", "\r\n \r\n  x", "don't  'll", "a" * 3000, "a\x85 b\x85  c", "x <0x41> y", "᠎ a​ b", "end ", "same words here", "same words here"]


@pytest.mark.parametrize("settings", [{}, {"FAN": 2, "BLOCK": 3, "COUNT_BYTES": 200, "SHARD_BYTES": 2000}])
def test_equals_a_plain_version(spark, sf_small, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(alignment, name, value)
    texts = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").limit(40).collect()] + ODD
    want, want_pairs = plain(texts)
    docs = spark.createDataFrame([(i, t, "g", 1) for i, t in enumerate(texts)], "doc_id long, text string, groups string, place int").repartition(5)
    shards = alignment.spill(docs, A, B, with_groups=True)
    counts = alignment.merged_counts(shards)
    rows = alignment.stream_back(shards, counts, settings.get("COUNT_BYTES", alignment.COUNT_BYTES)).orderBy("doc_id").collect()
    assert len(rows) == len(want)
    for r, (a, b, links, best, total, groups) in zip(rows, want, strict=True):
        assert (r.n_a, r.n_b, r.n_links, r.n_best, r.count_sum) == (a, b, links, best, total)
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if a else "")
        assert groups is None or (r.n_groups, r.groups) == groups
    assert sorted((r.b, r.a, r["count"], r.best) for r in alignment.pairs(counts).collect()) == want_pairs


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string").withColumn("shard", F.lit("s"))
    rows, pairs = alignment.align(docs, A, B)
    found = sorted(((r.doc_id, r.n_a, r.groups) for r in rows.collect()), key=str)
    assert [r[0] for r in found] == [1, 1, 2, None] and found[0] == found[1] and found[2][1:] == (0, "") and found[3][1:] == found[0][1:]
    assert {r["count"] for r in pairs.collect()} == {3}
    rows, pairs = alignment.align(docs.limit(0), A, B)
    assert rows.count() == 0 and pairs.count() == 0
