import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from marketloom.llm import language_id as L


def plain_model(texts):
    """Interpolated Kneser-Ney of order 4 in plain Python: a function from a padded string and a place to a probability."""
    def folded(t):
        return " " * 4 + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + (" " if t and not t[-1].isalpha() and t.split() else "")

    counts = {4: Counter()}
    for t in texts:
        s = folded(t)
        for i in range(4, len(s)):
            counts[4][s[i - 3 : i + 1]] += 1
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    totals, kinds, discount = {}, {}, {}
    for n, c in counts.items():
        totals[n], kinds[n] = defaultdict(int), defaultdict(int)
        for g, k in c.items():
            totals[n][g[:-1]] += k
            kinds[n][g[:-1]] += 1
        ones, twos = sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
        discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def p(gram, n):
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        gram = gram[-n:]
        c = gram[:-1]
        if c not in totals[n]:
            return p(gram, n - 1)
        return max(counts[n][gram] - discount[n], 0) * (gram in counts[n]) / totals[n][c] + discount[n] * kinds[n][c] / totals[n][c] * p(gram, n - 1)

    def cross(t):
        s = folded(t)
        each = [math.log(p(s[i - 3 : i + 1], 4)) for i in range(4, len(s))]
        return -sum(each) / max(1, len(each))

    return cross


def corpus(n=120):
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    return [(i, " ".join(word("abcdefg" if i % 3 else "efghéß") for _ in range(rng.randrange(1, 30))), "xx" if i % 3 else "yy") for i in range(n)]


def test_equals_a_plain_kneser_ney_model_in_one_pass_and_in_several(spark):
    rows = corpus()
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    plain = {x: plain_model([t for _, t, y in train if x == y]) for x in ("xx", "yy")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = docs.where(~L.is_held_out())
    for size in (L.MODEL_BYTES, 4000):
        model = L.fit(learnt, size)
        assert (model.passes > 1) == (size == 4000)
        got = {r.text: r for r in L.score(docs.withColumn("sums", F.lit("mine")), model).collect()}
        for _, t, _ in rows:
            wanted = {x: f(t) for x, f in plain.items()}
            best = min(sorted(wanted), key=wanted.get)
            assert got[t].lang_pred == best and math.isclose(got[t].entropy, wanted[best], rel_tol=1e-4) and got[t].sums == "mine"


def test_no_gram_is_left_out(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = L.fit(docs)
    kept = sum(len(r.keys) // 8 for r in model.shards.where("kind = 'grams' and level = 4").collect())
    assert kept == L.count_grams(docs).select("gram").distinct().count()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    right = [r.lang == r.lang_pred for r in got if r.held_out]
    assert np.mean(right) > 0.97
    assert np.mean([r.accepted for r in got]) > 0.99


def test_edge_cases(spark):
    texts = [None, "", "123 !! 45", "لغة", "hello there", "the thing and the other", "the thing and the other", "x" * 300_000, "\U0001F600", "\U00010400a"]
    rows = [(i, t, "en" if i in (4, 5, 6) else None, "zz") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["und", "und", "und", "en"] and got[8].lang_pred == "und"
    assert not got[0].accepted and got[5].lang_pred == "en" and got[5].score == got[6].score
    clash = docs.withColumn("_lang_pred", F.lit("mine")).withColumn("_accepted", F.lit(1))
    assert L.annotate(clash).where("_accepted").count() == sum(r.accepted for r in got.values())
    none = L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert L.identify(docs.limit(0)).count() == 0
