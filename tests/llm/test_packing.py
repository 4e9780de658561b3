import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketloom.llm.packing import WordIds, balanced, differencing, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def checked(rows, texts, capacity):
    tokenizer, by_doc, by_sequence = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_sequence


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    sequences = checked(pack_documents(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, 4096)
    total = sum(r.length for s in sequences.values() for r in s)
    assert len(sequences) <= -(-total // 4096) + 2


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: " \n\t ", 4: "It's <|endoftext|> 12 ÄÖ́ ▁x y\x1cz", 5: "word " * 30_000, 6: "ΟΔΟΣ ΣΑΣ"}
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in texts.items()], "doc_id long, text string, start string, length int")
    checked(pack_documents(docs, PATH).collect(), texts, 4096)
    assert pack_documents(docs.limit(0), PATH).count() == 0
    assert pack_documents(docs.unionByName(docs), PATH).count() == 2 * pack_documents(docs, PATH).count()


@pytest.mark.parametrize("windows", [1, 2, 5, 40])
def test_differencing(windows):
    sizes = np.random.default_rng(windows).integers(1, 900, 300).tolist()
    parts = differencing(sizes, windows)
    assert sorted(i for p in parts for i in p) == list(range(300))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 60
    assert differencing([8, 7, 6, 5, 4], 2) and balanced([], 10) == [] and balanced([10, 10, 1], 10) == [[0], [1], [2]]


def test_rare_words_neither_fill_nor_empty_the_cache():
    plain, words = Tokenizer.from_file(PATH), WordIds(PATH, limit=300)
    rng = np.random.default_rng(3)
    rare = lambda n: ["".join(rng.choice(list("abcdeéßÀñst"), 9)) for _ in range(n)]
    common, calls = rare(400), []
    encode = words._encode
    words._encode = lambda fresh: calls.append(len(fresh)) or encode(fresh)
    for _ in range(12):
        texts = [" ".join([*common, *rare(50)]), "İstanbul e\u0301 e \u0301a ǅ ª µm don't a.b c!! d, x\u00a0y 1234 ﬁn", "A<|endoftext|>b C!! "]
        ids, ends = words.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert calls[0] > 400 and max(calls[1:]) == 50 and len(words.code) == calls[0]
