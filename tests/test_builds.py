"""Builds that break off, versions that are not complete, partitions that are not read, records that are no rows."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import ledger, status
from marketloom.sources import builds, files, sinks, staging, universe, versions
from marketloom.sources.delimited import read_with_rejects


class Stop(Exception):
    pass


def stop(_):
    raise Stop


@pytest.fixture
def rows(spark):
    return builds.chunked(spark.range(1000).select(F.concat(F.lit("t"), F.col("id") % 40).alias("ticker"), "id"), "ticker", 5)


def whole(rows):
    return sorted((r.ticker, r.id) for r in rows.collect())


def test_a_build_goes_on_after_the_last_marked_chunk(spark, rows, tmp_path):
    folder = str(tmp_path / "b")
    with pytest.raises(Stop):
        builds.build(rows, folder, 5, 2, after=stop)
    assert sorted(builds.markers(spark, folder)) == [0, 1]
    assert whole(builds.built(spark, folder, rows.schema)) == whole(rows.where("chunk < 2"))
    assert builds.build(rows, folder, 5) == [2, 3, 4] and builds.build(rows, folder, 5) == []
    assert whole(builds.built(spark, folder, rows.schema)) == whole(rows)


def test_rows_of_a_chunk_that_broke_off_are_replaced(spark, rows, tmp_path):
    folder = str(tmp_path / "b")
    builds.build(rows.where("chunk < 2"), folder, 2)
    # broken off inside chunk 2: some of its rows are there, and a stray one, but no marker
    rows.where("chunk = 2").limit(3).unionByName(spark.createDataFrame([("x", -1, 2)], rows.schema)).write.mode("append").partitionBy("chunk").parquet(f"{folder}/data")
    assert whole(builds.built(spark, folder, rows.schema)) == whole(rows.where("chunk < 2"))
    assert builds.build(rows, folder, 5) == [2, 3, 4]
    assert whole(builds.built(spark, folder, rows.schema)) == whole(rows)


def test_a_chunk_that_lost_a_file_is_built_again(spark, rows, tmp_path):
    folder = str(tmp_path / "b")
    builds.build(rows, folder, 5)
    files.delete(spark, f"{folder}/data/chunk=3")
    assert builds.damaged(spark, folder) == [3] and builds.build(rows, folder, 5) == [3]
    assert whole(builds.built(spark, folder, rows.schema)) == whole(rows)


def test_empty_chunks_are_done_and_nulls_have_one(spark, tmp_path):
    rows = builds.chunked(spark.createDataFrame([(None, 1), ("a", 2)], "ticker string, id long"), "ticker", 4)
    folder = str(tmp_path / "b")
    assert builds.build(rows, folder, 4) == [0, 1, 2, 3] and sum(builds.markers(spark, folder).values()) == 2
    assert builds.build(rows.limit(0), str(tmp_path / "none"), 4) == [0, 1, 2, 3]
    assert builds.built(spark, str(tmp_path / "none"), rows.schema).count() == 0
    with pytest.raises(ValueError):
        builds.chunked(rows, "ticker", 0)


def test_a_version_without_manifest_is_never_read(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert versions.current(spark, folder) == 0 and versions.table(spark, folder, "t") is None
    assert versions.commit(spark, folder, {"t": spark.range(3)}, 0) == 1
    spark.range(9).write.parquet(f"{folder}/v=00000002-broken/t")  # a run that broke off before its manifest
    assert versions.current(spark, folder) == 1 and versions.table(spark, folder, "t").count() == 3
    grown = versions.table(spark, folder, "t").unionByName(spark.range(5))  # reads the version before
    assert versions.commit(spark, folder, {"t": grown}, 1) == 2
    assert versions.table(spark, folder, "t").count() == 8 and versions.table(spark, folder, "t", 1).count() == 3
    with pytest.raises(FileExistsError):  # another writer that started from version 1
        versions.commit(spark, folder, {"t": spark.range(1)}, 1)
    assert versions.table(spark, folder, "t").count() == 8
    old = versions.prune(spark, folder, 1)
    assert len(old) == 2 and "v=00000002-broken" in old and versions.versions(spark, folder) == [2] and versions.table(spark, folder, "t").count() == 8


def test_ledger_runs_are_idempotent(spark, tmp_path):
    folder = str(tmp_path / "l")
    day = spark.createDataFrame([("a", "2024-01-02", "Long", 80.0, "No automatic QC flags"), ("b", "2024-01-02", "Long", 90.0, "x")], "ticker string, date string, direction string, setup_score double, quality_flags string").withColumn("date", F.col("date").cast("date"))
    outcomes = lambda state: lambda x: x.select(*ledger.KEY, F.lit(1).alias("horizon"), F.lit(state).alias("status"))
    assert ledger.run(spark, folder, day, outcomes("pending_future_exit")) == 1
    assert ledger.run(spark, folder, day, outcomes("complete")) == 2
    assert ledger.run(spark, folder, day.limit(0), outcomes("invalid")) == 3
    assert {(r.ticker, r.signal_rank) for r in versions.table(spark, folder, "ledger").collect()} == {("b", 1), ("a", 2)}
    assert [r.status for r in versions.table(spark, folder, "outcomes").collect()] == ["complete"] * 2  # complete stays
    assert [r.tracking_status for r in versions.table(spark, folder, "tracking", 1).collect()] == ["pending"] * 2


def test_only_wanted_months_are_read(spark, tmp_path):
    path = str(tmp_path / "m")
    x = spark.range(400).select(F.col("id"), F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    sinks.write_by_month(x.unionByName(spark.createDataFrame([(-1, None)], "id long, date date")), path)
    got = sinks.read_by_month(spark, path, "id long, date date", "2023-03-15", "2023-05-02")
    assert sorted(r.id for r in got.collect()) == list(range(73, 122))
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.selectedPartitions().partitionCount() == 3  # of the scan's listing, before any task runs
    plan = got.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(date)" in plan
    assert sinks.read_by_month(spark, path, "id long, date date").count() == 401


def test_every_record_is_a_row_or_a_reject(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,n,d\na,1,2024-01-02\nb,x,2024-01-02\n,3,2024-01-02\nc,4\nd,5,2024-01-02,more\ne,,2024-02-30\nf,,\n")
    rows, rejects = read_with_rejects(spark, str(tmp_path / "a.csv"), "k string, n int, d date", ("k",))
    assert [(r.k, r.n) for r in rows.orderBy("k").collect()] == [("a", 1), ("f", None)]
    assert sorted((r.record, r.reason) for r in rejects.collect()) == [(",3,2024-01-02", "missing k"), ("b,x,2024-01-02", "malformed"), ("c,4", "malformed"), ("d,5,2024-01-02,more", "malformed"), ("e,,2024-02-30", "malformed")]
    assert {r.file for r in rejects.collect()} == {"a.csv"} and rows.count() == 2 and rejects.select("reason").count() == 5
    (tmp_path / "d.txt").write_text("Symbol|Security Name|ETF|Test Issue|Listing Exchange\nA|A Inc.|N|N|N\n|B Inc.|N|N|N\nC|C\nFile Creation Time: 1||||\n")
    rows, rejects = universe.read_directory_with_rejects(spark, str(tmp_path / "d.txt"))
    assert [r.Symbol for r in rows.collect()] == ["A"] and sorted(r.reason for r in rejects.collect()) == ["malformed", "missing Symbol"]


def test_status_counts_what_the_scan_wrote(spark, sf_small, tmp_path):
    from marketloom.plans.daily import features
    from marketloom.sources import fixtures

    f, caps = features(spark, sf_small), fixtures.market_caps(spark, sf_small)
    r = status.scan(f, caps, str(tmp_path / "s"), 1.0, 0.0, 0.0).first()
    found = spark.read.parquet(str(tmp_path / "s"))
    assert r.candidates == found.count() == r.longs + r.shorts and r.symbols_with_bars == f.select("ticker").distinct().count() and r.universe_size == caps.count()
    assert r.liquid == r.cap_qualified + r.cap_below + r.cap_unavailable and r.cap_known == r.cap_qualified + r.cap_below
    none = status.scan(f.limit(0), caps, str(tmp_path / "n"), 1.0, 0.0, 0.0).first()
    assert none.candidates == 0 and none.signal_date is None


def test_staged_tables_are_deleted(spark):
    x = staging.staged(spark.range(3), "three")
    path = x.inputFiles()[0].rsplit("/", 1)[0]
    assert x.count() == 3 and files.exists(spark, path)
    staging.clear_staged(spark)
    assert not files.exists(spark, path)
