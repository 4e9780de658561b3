"""Tasks stay bounded when tables grow: bars are dealt once, in parts by their number; quantiles need no group in one place; contractions are found once."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketloom.operators import mechanics, statistics
from marketloom.operators.outcomes import with_ahead
from marketloom.plans.daily import features
from marketloom.sources import fixtures


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tickers", [None, 5])
def test_bars_have_more_tasks_for_more_lines(spark, sf_small, monkeypatch, tickers):
    before = sorted(map(str, fixtures.bars(spark, sf_small, tickers).collect()))
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 500)
    x = fixtures.bars(spark, sf_small, tickers)
    tasks = 5 if tickers else spark.read.parquet(f"{sf_small}/lineitem.parquet").count() // 500 + 1
    assert x.rdd.getNumPartitions() == tasks and sorted(map(str, x.collect())) == before


def test_bars_of_suppliers_are_dealt_once(spark, sf_small):
    assert plan(fixtures.bars(spark, sf_small)).count("Exchange") == 1


def test_quantiles_are_exact_where_values_share_bins(spark):
    random.seed(5)
    draws = {"a": [random.choice((0.0, random.expovariate(2), 0.001 * random.random())) for _ in range(2000)], "b": [-3.5], "c": [1.0, 1.0, 2.0, 2.0], "d": [None], "e": [0.1, -0.2, 0.3, None, 1e6, -1e6]}
    rows = spark.createDataFrame([(k, v, None if v is None else -v) for k, vs in draws.items() for v in vs], "k string, x double, y double").repartition(5)
    wanted = (("x", 0.5, "x50"), ("x", 0.9, "x90"), ("y", 0.5, "y50"), ("x", 0.0, "x0"), ("x", 1.0, "x1"))
    got = {r.k: r for r in statistics.quantiles(rows, ["k"], wanted).collect()}
    known = {r.k: r for r in rows.groupBy("k").agg(*(F.expr(f"percentile({c}, {q})").alias(name) for c, q, name in wanted)).collect()}
    assert set(got) == set(draws) - {"d"}
    assert all(got[k][name] == known[k][name] for k in got for *_, name in wanted)


def test_excursion_summary_holds_no_group_in_one_buffer(spark, sf_small):
    x = entry.queries()["agg_11_excursion_summary"](spark, sf_small)
    assert "percentile" not in plan(x) and not any("lineitem" in f for f in x.inputFiles())


@pytest.mark.parametrize("name", ["joi_07_rules_with_holdout", "agg_14_validated_rules"])
def test_contractions_are_found_once(spark, sf_small, name):
    assert not any("lineitem" in f for f in entry.queries()[name](spark, sf_small).inputFiles())


def test_phases_of_one_length_share_a_frame(spark, sf_small):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    text = mechanics.contractions(with_ahead(features(spark, sf_small)), mechanics.RULE_GRID)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "RowFrame, -4, currentrow" in text and not any(f"RowFrame, {a}, {b})" in text for a, b in ((-10, -6), (-15, -11), (-20, -11), (-5, -1)))


def test_only_used_columns_are_written(spark, sf_small):
    x = entry.queries()["agg_19_best_rules"](spark, sf_small)
    (path,) = {f.rsplit("/", 1)[0] for f in x.inputFiles()}
    assert set(spark.read.parquet(path).columns) == {"date", "direction", "outcome", *statistics.EDGES}


def test_generated_methods_are_short_enough_to_be_compiled(spark, sf_small):
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(name)
    fixtures.bars(spark, sf_small)
    assert spark.conf.get(name) == "8000"
    spark.conf.set(name, "6000")
    fixtures.bars(spark, sf_small, 3)
    assert spark.conf.get(name) == "6000"
    spark.conf.unset(name)
