import re

import pytest
from pyspark.sql import types as T

from marketloom.llm.ngram_join import jaccard_components, jaccard_links

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_shingles", T.IntegerType())])


def brute(rows, size, percent):
    sets, parent = {}, {}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))} if words else set()
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_equals_brute_force_on_a_small_table(spark, sf_small, size, percent):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, size, percent).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], size, percent)


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None, 1), (2, "", 1), (3, " \t\n", 1), (4, "one TWO", 1), (5, "ONE two", 1), (6, base, 1), (7, base.upper() + "  ", 1),
        (8, base + " x", 1), (9, base + " x y", 1), (10, base + " x y z q r s t u v w k l", 1), (11, "a " * 50_000, 1), (12, "one two", 1), (None, base, 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, 3, 90).collect()}
    assert got == brute([r for r in rows if r[0] is not None], 3, 90)


def test_no_rows(spark):
    members, links = jaccard_links(spark.createDataFrame([], SCHEMA))
    assert members.count() == 0 and links.count() == 0
