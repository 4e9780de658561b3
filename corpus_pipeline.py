"""A corpus from documents to packed windows: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents. Stages with
Python bound the session's Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import language_id, ngram_join, packing, pii, repeats
from marketloom.llm.queries import PSEUDONYM_KEY, tokenizer_path
from marketloom.llm.storage import small_batches, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a string that, once it repeats across documents, is cut from all but the first: a passage of some ten words.
PASSAGE_BYTES = 50


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no language's model accepts."""
    small_batches(spark)
    return language_id.annotate(docs).where("_accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles with a similarity of 0.8 or more."""
    small_batches(spark)
    groups = ngram_join.jaccard_components(docs, size=5, percent=80)
    others = written(groups.where("doc_id != component_id").select("doc_id").distinct(), "others")
    return docs.join(others.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand in a document of smaller doc_id; every document stays, with what is left of it."""
    small_batches(spark)
    cut = repeats.remove_repeats(docs, span=PASSAGE_BYTES, carry=("lang", "source"))
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts personal data under pseudonyms."""
    return pii.pseudonymise(docs, key=PSEUDONYM_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into windows of 4096 ids."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", languages),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", windows),
]

#: Stages of this kind have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
