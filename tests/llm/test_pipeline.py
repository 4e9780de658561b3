import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
from test_ngram_join import brute as components  # noqa: E402
from test_pii import plain  # noqa: E402
from test_repeats import brute as repeats  # noqa: E402

from marketloom.llm import pii, storage  # noqa: E402


def test_stages_against_brute_force(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)
    first = kept["language_id"](spark, docs, sf_small)
    assert first.columns == docs.columns and first.count() >= 0.98 * docs.where("text rlike '[A-Za-z]'").count()
    second = kept["ngram_join"](spark, first, sf_small)
    of = components([(r.doc_id, r.text) for r in first.collect()], 5, 80)
    assert {r.doc_id for r in second.collect()} == {i for i, (_, c) in of.items() if i == c}
    third = kept["suffix_dedup"](spark, second, sf_small).cache()
    lost = {i: n for i, _, n, _, _ in repeats([(r.doc_id, r.text) for r in second.collect()])}
    sizes = {r.doc_id: len(r.text.encode()) for r in second.collect()}
    assert all(sizes[r.doc_id] - lost[r.doc_id] - 6 <= len(r.text.encode()) <= sizes[r.doc_id] - lost[r.doc_id] and r.n_chars == len(r.text) for r in third.collect())
    fourth = kept["pii"](spark, third, sf_small)
    assert fourth.columns == docs.columns and fourth.count() == second.count() == third.count()
    last = kept["packing"](spark, fourth, sf_small)
    assert last.select("doc_id").distinct().count() == fourth.count()
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()


def test_run(spark, sf_small):
    rows = corpus_pipeline.run(spark, sf_small)
    assert rows.count() > 100 and "sequence_id" in rows.columns
    assert plain and pii


def test_batches_of_texts_are_bounded(spark):
    rows = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('x', 100000) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]}, schema=pa.schema([("n", pa.int64())]))

    name, largest = storage._BATCH, lambda: max(r.n for r in rows.mapInArrow(sizes, "n long").collect())
    before = spark.conf.get(name)
    try:
        assert largest() > 30_000_000
        storage.small_batches(spark)
        assert largest() < 2 * storage.BATCH_BYTES
        spark.conf.set(name, "1m")
        storage.small_batches(spark)
        assert spark.conf.get(name) == str(1 << 20)
    finally:
        spark.conf.set(name, before)


def test_workers_let_go_of_what_other_stages_kept(spark):
    from marketloom.llm import packing, storage
    from marketloom.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    first = packing.word_ids(path)
    assert packing.word_ids(path) is first
    storage.let_go()
    assert packing.word_ids(path) is not first
    storage.let_go()
