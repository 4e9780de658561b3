"""Inputs that the derived tables do not hold: long series, caps that are no numbers, symbols with blanks."""

import datetime
import math

from pyspark.sql import functions as F

from marketloom.operators.indicators import with_emas
from marketloom.sources import universe


def test_averages_of_long_series(spark):
    n = 9_000
    values = [100 + math.sin(i / 7) * 5 + i % 13 for i in range(n)]
    rows = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)], "ticker string, rn long, close double").withColumn("date", F.date_add(F.lit("1990-01-01").cast("date"), F.col("rn").cast("int")))
    got = {r.rn: r for r in with_emas(rows, "close", {"e20": 20, "e200": 200}).collect()}
    for name, span in (("e20", 20), ("e200", 200)):
        a, y = 2 / (span + 1), None
        for i, v in enumerate(values):
            y = v if y is None else a * v + (1 - a) * y
            if i + 1 < span:
                assert got[i + 1][name] is None
            elif i % 97 == 0 or i == n - 1:
                assert math.isclose(got[i + 1][name], y, rel_tol=1e-9), (name, i)


def test_caps_that_are_no_numbers_are_unavailable(spark):
    nan, inf = float("nan"), float("inf")
    caps = spark.createDataFrame([("a", nan, None), ("b", inf, -1.0), ("c", nan, 6e8), ("d", 5e8, None), ("e", 499_999_999.0, None), ("f", 0.0, None)], "symbol string, fast_cap double, std_cap double")
    rows = spark.createDataFrame([(x,) for x in "abcdefg"], "ticker string")
    got = {r.ticker: r.cap_status for r in universe.cap_status(rows, caps, 5e8).collect()}
    assert got == {"a": "unavailable", "b": "unavailable", "c": "qualified", "d": "qualified", "e": "below", "f": "unavailable", "g": "unavailable"}


def test_symbols_are_trimmed_before_the_first_is_kept(spark):
    rows = spark.createDataFrame([(" AB.C", "", "", 2), ("AB.C ", None, None, 1), ("E", "Y", "N", 3), ("T", "N", "Y", 4), (None, "N", "N", 5)], "symbol string, etf string, test_issue string, source_order int")
    got = [(r.symbol, r.yahoo_symbol, r.source_order) for r in universe.listed(rows).collect()]
    assert got == [("AB.C", "AB-C", 1)]


def test_last_bars_are_found_without_another_sort(spark):
    from marketloom.operators import indicators, signals

    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i)
    bars = spark.createDataFrame([(t, day(i), 10.0, 11.0, 9.0, 10.0 + i, 100.0) for t, n in (("a", 3), ("b", 5), (None, 2)) for i in range(n)], "ticker string, date date, open double, high double, low double, close double, volume double")
    x = indicators.features(bars, bars.where("ticker = 'b'").drop("ticker"))
    found = signals.last_bars(x)
    assert {(r.ticker, r.date, r.close) for r in found.select("ticker", "date", "close").collect()} == {("a", day(2), 12.0), ("b", day(4), 14.0), (None, day(1), 11.0)}
    assert "DESC" not in signals.latest(x)._jdf.queryExecution().executedPlan().toString()
