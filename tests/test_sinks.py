from marketloom.sources import sinks, universe


def test_tables_and_directory(spark, tmp_path):
    sinks.write_csv_table(spark.range(3), str(tmp_path / "c"))
    sinks.write_status(spark.range(3).selectExpr("count(*) as n"), str(tmp_path / "j"))
    sinks.write_parquet(spark.range(3).selectExpr("id", "id % 2 as k"), str(tmp_path / "p"), "k")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3 and spark.read.json(str(tmp_path / "j")).first().n == 3
    (tmp_path / "d.txt").write_text("Symbol|Security Name|ETF|Test Issue|Listing Exchange\nA|A Inc. Common Stock|N|N|N\nFile Creation Time: 1|||| \n")
    assert [r.Symbol for r in universe.read_directory(spark, str(tmp_path / "d.txt")).collect()] == ["A"]
