import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from marketloom.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


def paths(vocab, chunk):
    """All segmentations of a chunk with their weights, by brute force."""
    known = {s.decode(): i for i, s in enumerate(vocab.surface) if s and i not in set(vocab.byte)}
    out = [((), 0.0, chunk)]
    while any(rest for *_, rest in out):
        step = []
        for ids, w, rest in out:
            if not rest:
                step.append((ids, w, rest))
                continue
            step += ((*ids, known[rest[:k]]) and ((*ids, known[rest[:k]]), w + vocab.weight[known[rest[:k]]], rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in known)
            if rest[0] not in known:
                raw = rest[0].encode()
                step.append(((*ids, *vocab.byte[list(raw)].tolist()), w + len(raw) * vocab.byte_weight, rest[1:]))
        out = step
    total = np.logaddexp.reduce([w for _, w, _ in out])
    return {ids: float(np.exp(w - total)) for ids, w, _ in out}


def test_samples_follow_the_lattice():
    vocab = P.vocabulary(PATH)
    for text in ("the", "x▁é", "\U0001F600a"):
        want = paths(vocab, " " + text)
        ids, ends = P.sample(vocab, [text] * 20_000, np.arange(20_000), 1.0, 7)
        got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True))
        assert set(got) <= set(want)
        assert all(abs(got[k] / 20_000 - p) < 0.02 for k, p in want.items())


def test_whole_table_is_lossless_and_reproducible(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    encoded = P.encode(docs, PATH).cache()
    assert P.decode(encoded, PATH).where("decoded != text").count() == 0
    again = P.encode(docs.repartition(5, "n_chars"), PATH)
    assert encoded.join(again.select("doc_id", F.col("ids").alias("other")), "doc_id").where("ids != other").count() == 0
    other = P.encode(docs, PATH, seed=1)
    assert encoded.join(other.select("doc_id", F.col("ids").alias("other")), "doc_id").where("ids != other").count() > 0.9 * docs.count()
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in encoded.limit(20).collect():
        if "  " not in r.text and not r.text.startswith(" "):
            assert model.decode(r.ids) == r.text


def test_edge_cases(spark):
    texts = [None, "", " ", "  a  b ", "\n\n x\n", "▁ x▁y", "<s></s><unk><0x41>", "\U0001F600́", "a" * 100_000, "a\x00b\t", " 　z"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_ids int")
    got = {r.doc_id: r for r in P.decode(P.encode(df, PATH), PATH).collect()}
    assert [got[i].decoded for i in range(len(texts))] == texts
    trips = {r.doc_id: r for r in P.round_trip(df, PATH).collect()}
    assert all(trips[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and trips[i].n_chars == len(t or "") for i, t in enumerate(texts))
    assert P.encode(df.limit(0), PATH).count() == 0 and P.round_trip(df.limit(0), PATH).count() == 0
