"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import alignment, codes, fmindex, html_text, imatch, kdtree, language_id, ngram_join, oracles, packing, pieces, pii, repeats, toxicity


#: Key of the registered query's pseudonyms; users give their own secret.
PSEUDONYM_KEY = "example key of the registered query"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=90)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data under pseudonyms."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pii.pseudonymise(docs, key=PSEUDONYM_KEY)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 vectors of highest integer inner product for each vec_id divisible by 100."""
    return kdtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text, with their likeness."""
    return imatch.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of those that are not held out."""
    return toxicity.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentation of every document, and what decoding makes of it."""
    return pieces.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    return language_id.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of 50-byte strings that also start in a smaller document."""
    found = repeats.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), span=50, with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 4096 ids, balanced by Karmarkar-Karp differencing."""
    return packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every usable vector, with their errors and the digest of the codebooks."""
    return codes.code_errors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of ten benchmark words cover."""
    return fmindex.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens by two vocabularies, and how common the linked pairs are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, _ = alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), with_groups=False)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_ngram_join": op1_ngram_join, "op2_pii": op2_pii, "op3_exact_top_k": op3_exact_top_k, "op4_fingerprints": op4_fingerprints, "op5_html_text": op5_html_text, "op6_toxicity": op6_toxicity, "op7_pieces": op7_pieces, "op8_language_id": op8_language_id, "op9_suffix_dedup": op9_suffix_dedup, "op10_packing": op10_packing, "op11_vector_codes": op11_vector_codes, "op12_decontamination": op12_decontamination, "op13_alignment": op13_alignment}
ORACLE_SQL: dict[str, str] = {"op11_vector_codes": oracles.product_codes(), "op12_decontamination": oracles.DECONTAMINATION}
