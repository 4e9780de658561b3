import math
import random

from pyspark.sql import functions as F

from marketloom.llm import language_id as L


def test_percentile_equals_sparks(spark):
    rng = random.Random(3)
    rows = [("a", rng.random() * 5) for _ in range(5000)] + [("b", rng.choice([0.5, 2.0, 7.25])) for _ in range(777)] + [("c", 1.5), ("d", 1.0), ("d", 9.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for share in (0.0, 0.5, 0.999, 1.0):
        wanted = {r.k: r.p for r in df.groupBy("k").agg(F.expr(f"percentile(v, {share})").alias("p")).collect()}
        got = {r.k: r.high for r in L.percentile_by(df, "k", "v", share).collect()}
        assert got.keys() == wanted.keys() and all(math.isclose(got[k], wanted[k], rel_tol=1e-12) for k in got)


def test_rare_language_is_calibrated_on_all_its_rows(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 8)))
    some = lambda letters: " ".join(word(letters) for _ in range(6))
    rows = [(i, some("abcdefgh"), "xx") for i in range(50_000)] + [(50_000 + i, some("αβγδε"), "yy") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.calibrate(L.fit(docs), docs)
    high = {r.lang_pred: r.high for r in L.score(docs.select("text"), model).groupBy("lang_pred").agg(F.expr("percentile(entropy, 0.999)").alias("high")).collect()}
    assert set(high) == {"xx", "yy"}
    assert all(math.isclose(model.thresholds[k], L.MARGIN * high[k], rel_tol=1e-9) for k in high)
