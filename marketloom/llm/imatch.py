"""Document fingerprints by I-Match, with DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band: neither so common that they say
nothing nor so rare that a slip makes them. Each of several randomised subsets of the lexicon, drawn by hash at
rates that halve from one to the next, gives one signature: the digest of the document's sorted distinct
terms in it. Dense subsets tell near copies apart; sparse ones still agree after heavy edits. The likeness of two
fingerprints is the share of equal signatures among those that are not empty in both.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.storage import written

#: The band, as shares of all documents.
LOWEST_SHARE, HIGHEST_SHARE = 0.002, 0.05
#: Subsets hold a term with probability 1/2, 1/4, ... 1/2**RATES; so many subsets of each rate.
RATES, REPEATS = 8, 3
#: Terms that are broadcast at most; a larger lexicon is joined by a shuffle. A document of t distinct
#: terms on average gives at most t / LOWEST_SHARE terms, whatever the number of documents.
BROADCAST_TERMS = 300_000
#: Rows of a bucket of neighbouring ids; buckets at most, beyond which they hold more rows; rows without an id have 2**(1 + NULL_BITS) buckets.
BUCKET_ROWS, MOST_BUCKETS, NULL_BITS = 1000, 65_536, 8


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != ""))


def lexicon(docs: DataFrame, low: float = LOWEST_SHARE, high: float = HIGHEST_SHARE) -> DataFrame:
    """term and mask (bit k: in subset k) for the terms within the band, over all docs(text)."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    band = df.where((F.col("count") >= low * n) & (F.col("count") <= max(high * n, 1))).select("term")
    mask = F.lit(0)
    for k in range(RATES * REPEATS):
        draw = F.pmod(F.xxhash64("term", F.lit(k)), F.lit(2 ** (1 + k // REPEATS)))
        mask = mask.bitwiseOR(F.when(draw == 0, 1 << k).otherwise(0))
    return band.select("term", mask.alias("mask"))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def fingerprint(entries: Column, text_digest: Column) -> Column:
    """Signatures of all subsets, of sorted distinct entries(term, mask); a text without lexicon terms is known by its digest."""
    mark = lambda joined: F.when(joined == "", "-").otherwise(F.substring(F.md5(joined), 1, 8))
    own = lambda e, bit: F.array_join(F.transform(F.filter(e, lambda x: x["mask"].bitwiseAND(bit) != 0), lambda x: x["term"]), " ")
    bits = F.array(*(F.lit(1 << k) for k in range(RATES * REPEATS)))
    parts = _once(entries, lambda e: F.array_join(F.transform(bits, lambda bit: _once(own(e, bit), mark)), ":"))
    return _once(parts, lambda whole: F.when(whole.rlike("[^-:]"), whole).otherwise(F.concat(F.lit("text:"), text_digest)))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal signatures among those that are not empty in both; 1 or 0 where a whole text is the signature."""
    pairs = F.zip_with(F.split(x, ":"), F.split(y, ":"), lambda a, b: F.when((a == "-") & (b == "-"), F.lit(None)).otherwise((a == b).cast("int")))
    share = _once(F.array_compact(pairs), lambda some: F.aggregate(some, F.lit(0), lambda n, e: n + e) / F.size(some))
    return F.when(x.startswith("text:") | y.startswith("text:"), (x == y).cast("double")).otherwise(share)


def _numbers(values: list[int], kind: str) -> Column:
    """A constant array, folded once by the optimizer whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _bucketed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, _tie) with `bucket`, ascending with doc_id, and a copy (sentinel) of each bucket's first row at the end of the bucket above.

    Buckets are the ranges into which Spark's range partitioning deals the ids; rows without doc_id, which come last, are
    dealt by their tie. Only the highest id of each bucket, MOST_BUCKETS at most, passes through the driver.
    """
    ids = docs.where("doc_id is not null").select("doc_id")
    buckets = min(MOST_BUCKETS, max(1, ids.count() // BUCKET_ROWS))
    ranges = ids.repartitionByRange(buckets, "doc_id").groupBy(F.spark_partition_id().alias("part"))
    tops = sorted(r.top for r in ranges.agg(F.max("doc_id").alias("top")).collect())
    cuts = tops[:-1]
    side = max(1, math.isqrt(len(cuts)))
    below = lambda bounds: F.size(F.filter(bounds, lambda x: x < F.col("doc_id")))
    # the place among every side-th cut first, then among the cuts from there to the next of them
    coarse = below(_numbers(cuts[side - 1 :: side], "long"))
    fine = F.array(*(_numbers(cuts[i : i + side], "long") for i in range(0, len(cuts) + 1, side)))
    docs = docs.withColumn("_i", coarse)
    bucket = F.col("_i") * side + below(F.get(fine, F.col("_i")))
    # ~tie falls as the tie rises, so that `_place` falls in the order of the documents throughout
    slices = F.shiftright("_tie", 63 - NULL_BITS).cast("int") + (1 << NULL_BITS)
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1 - slices).otherwise(bucket)).withColumn("_place", F.coalesce("doc_id", F.bitwise_not("_tie"))).drop("_i")
    known = {r.bucket: r.top for r in docs.where("doc_id is null").groupBy("bucket").agg(F.max("_place").alias("top")).collect()} | dict(enumerate(tops))
    if not known:
        return docs.drop("_place").withColumn("sentinel", F.lit(False))
    order = sorted(known)
    above = dict(zip(order, [*order[1:], order[0]], strict=True))
    numbers = range(order[0], order[-1] + 1)
    at = F.col("bucket") - order[0]
    top, up = F.get(_numbers([known.get(b, 0) for b in numbers], "long"), at), F.get(_numbers([above.get(b, 0) for b in numbers], "int"), at)
    own, copy = F.struct(F.col("bucket"), F.lit(False).alias("sentinel")), F.struct(up.alias("bucket"), F.lit(True).alias("sentinel"))
    copies = F.when(F.col("_place") == top, F.array(own, copy)).otherwise(F.array(own))
    return docs.select(*[c for c in docs.columns if c not in ("bucket", "_place")], F.explode(copies).alias("_c")).select("*", "_c.bucket", "_c.sentinel").drop("_c")


def fingerprints(docs: DataFrame, low: float = LOWEST_SHARE, high: float = HIGHEST_SHARE) -> DataFrame:
    """Fingerprints of every text of documents(doc_id, text, ...) and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document
    in descending order of doc_id; after the last comes the first. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next (likeness to the edited text and to the next document).

    Null text counts as empty. Rows without doc_id come last; rows that repeat a doc_id follow each other in an order
    fixed by their text. A single row is its own next document. No rows give no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lex = lexicon(docs, low, high)
    lex = lex.unionByName(docs.sparkSession.createDataFrame([("", 0)], "term string, mask int"))
    lex = written(lex, "lexicon")
    small = lex.count() <= BROADCAST_TERMS
    order = [F.col("sentinel"), F.col("doc_id").desc_nulls_last(), F.col("_tie")]
    w = Window.partitionBy("bucket").orderBy(*order)
    rows = _bucketed(docs.withColumn("_tie", F.xxhash64("text")))
    rows = rows.withColumn("_rank", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("text").over(w), F.lit("")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("_next").substr(F.lit(1), half)))
    tagged = lambda kind, text: F.transform(terms(F.col(text)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
    entries = F.concat(F.array(F.struct(F.lit(2).alias("kind"), F.lit("").alias("term"))), tagged(0, "text"), F.when(F.col("sentinel"), F.array().cast("array<struct<kind:int,term:string>>")).otherwise(tagged(1, "_edited")))
    keys = ["bucket", "_rank", "sentinel", "doc_id", "_tie", "n_chars", "edited_sha256", "_digest", "_edited_digest"]
    flat = rows.select(
        "bucket", "_rank", "sentinel", "doc_id", "_tie", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), F.md5("text").alias("_digest"), F.md5("_edited").alias("_edited_digest"),
        entries.alias("_entries"),
    )
    # digests stand below the explosion, or they would be taken anew for every term
    flat = flat.select(*keys, F.explode("_entries").alias("e")).select(*keys, "e.kind", "e.term")
    # The keys hold `bucket`, by which the window has dealt the rows: this grouping needs no shuffle of its own.
    grouped = flat.join(lex.hint("broadcast" if small else "merge"), "term").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("kind", "term", "mask"))).alias("e"))
    of = lambda kind: F.filter("e", lambda x: x["kind"] == kind)
    found = grouped.withColumn("fingerprint", fingerprint(of(0), F.col("_digest"))).withColumn("edited_fingerprint", fingerprint(of(1), F.col("_edited_digest"))).drop("e")
    found = found.withColumn("_next", F.coalesce(F.lead("fingerprint").over(w), F.col("fingerprint")))
    return found.where(~F.col("sentinel")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
