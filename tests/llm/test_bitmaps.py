import pytest

from marketloom.llm.bitmaps import may_hold


@pytest.mark.parametrize("bits", [1 << 20, 1 << 26, 1000, 1])
def test_no_key_is_ruled_out(spark, bits):
    keys = spark.range(0, 3000, 3).selectExpr("nullif(id, 0) as id", "cast(id as string) as name")
    rows = spark.range(0, 3000).selectExpr("nullif(id, 0) as id", "cast(id as string) as name", "array(id) as more")
    for columns in (["id"], ["id", "name"]):
        held = may_hold(keys, *columns, bits=bits)
        got = {r.name: r.held for r in rows.select("name", held(*columns).alias("held")).collect()}
        assert all(got[str(i)] for i in range(0, 3000, 3))
        others = sum(got[str(i)] for i in range(3000) if i % 3)
        assert others < 20 if bits >= 1 << 20 else others > 1000
    assert rows.where(may_hold(keys.limit(0), "id", bits=bits)("id")).count() == 0
