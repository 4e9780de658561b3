"""Extra columns with the names that operators use for themselves: they stay, or the docstring's result replaces them."""

from pyspark.sql import functions as F

from marketloom.llm import packing, pieces, pii, repeats
from marketloom.llm.queries import tokenizer_path


def docs(spark, **more):
    base = spark.createDataFrame([(1, "call 212-555-0199 now"), (2, None), (None, ""), (1, "call 212-555-0199 now")], "doc_id long, text string")
    for name, value in more.items():
        base = base.withColumn(name, F.lit(value))
    return base


def test_pieces_and_pii_and_repeats_and_packing(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    got = pieces.decode(pieces.encode(docs(spark, hashed="h", _key="k", ids="i"), model), model).collect()
    assert [r.hashed for r in got] == ["h"] * 4 and [r["_key"] for r in got] == ["k"] * 4
    assert [r.decoded for r in got] == ["call 212-555-0199 now", None, "", "call 212-555-0199 now"]
    hidden = pii.pseudonymise(docs(spark, replaced="r", _replaced="s", n_replaced="n"), "key").collect()
    assert [(r.replaced, r["_replaced"]) for r in hidden] == [("r", "s")] * 4 and [r.n_replaced for r in hidden] == [1, 0, 0, 1]
    assert hidden[0].text == hidden[3].text != "call 212-555-0199 now"
    cut = repeats.remove_repeats(docs(spark, kept="k", lang="l", _text="t"), carry=("kept", "lang", "_text"))
    assert cut.columns.count("kept") == 1 and {(r.lang, r["_text"]) for r in cut.collect()} == {("l", "t")}
    rows = packing.pieces(docs(spark), tokenizer_path("word_bpe_49k.json")).withColumns({"_group": F.lit("g"), "group": F.lit("h"), "offset": F.lit("o"), "copy": F.lit(1)})
    packed = packing.pack(rows, 2).collect()
    assert len(packed) == 4 and {(r["_group"], r["group"]) for r in packed} == {("g", "h")} and all(isinstance(r.offset, int) for r in packed)
