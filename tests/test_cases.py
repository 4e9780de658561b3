"""Hand-made cases with known results."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from marketloom.operators import context, outcomes, statistics
from marketloom.params import COSTS
from marketloom.sources import universe

C5 = [date(2026, 1, d) for d in (5, 6, 7, 8, 9)]


def trade(spark, bars, direction="Long", horizon=1):
    bench = spark.createDataFrame([(d, 500.0, 505.0) for d in C5], "date date, open double, close double")
    rows = [("A", d, float(o), float(h), float(lo), float(c)) for d, o, h, lo, c in bars]
    stock = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double")
    signal = spark.createDataFrame([("A", C5[0], direction, "s", 60.0, 10.0, 9.0, 12.0)], "ticker string, date date, direction string, setup string, setup_score double, entry double, stop double, target double")
    return outcomes.simulated_trades(signal, stock, bench, (horizon,)).first()


@pytest.mark.parametrize(
    "bar,reason,price",
    [((10, 10.5, 8.8, 9), "stop", 9.0), ((10, 12.5, 9.8, 12), "target", 12.0), ((10, 12.5, 8.8, 10), "stop_and_target_same_bar_stop_first", 9.0), ((10, 11, 9.5, 10.5), "time_exit", 10.5)],
)
def test_first_session(spark, bar, reason, price):
    r = trade(spark, [(C5[1], *bar)])
    assert (r.status, r.exit_reason, r.exit_price, r.holding) == ("complete", reason, price, 1)


def test_gap_through_stop_fills_at_the_open(spark):
    r = trade(spark, [(C5[1], 10, 10.5, 9.5, 10), (C5[2], 8.7, 9, 8.5, 8.8)], horizon=2)
    assert (r.exit_reason, r.exit_price, r.exit_date) == ("stop_gap", 8.7, C5[2])


def test_missing_bars_and_pending(spark):
    assert trade(spark, [(C5[2], 10, 11, 9.5, 10)]).status == "invalid_missing_stock_entry_bar"
    assert trade(spark, [(C5[1], 10, 11, 9.5, 10)], horizon=2).status == "invalid_missing_stock_bar_before_exit"
    assert trade(spark, [(C5[1], 10, 11, 9.5, 10)], horizon=5).status == "pending_exit_beyond_download"


def test_net_costs(spark):
    row = spark.range(1).select(outcomes.net_pnl(F.lit(-0.05), F.lit("Short"), F.lit(5), COSTS[0]).alias("s"), outcomes.net_pnl(F.lit(0.01), F.lit("Long"), F.lit(5), COSTS[0]).alias("l")).first()
    assert row.s == pytest.approx(-0.05 - 0.001 - 0.03 * 5 / 252) and row.l == pytest.approx(0.009)


def test_market_caps(spark):
    caps = spark.createDataFrame([("A", None, 6e8), ("B", 0.0, None), ("C", 5e8, 1.0), ("D", float(5e8 - 1), 1e9)], "symbol string, fast_cap double, std_cap double")
    rows = spark.createDataFrame([(x,) for x in "ABCDE"], "ticker string")
    got = {r.ticker: r.cap_status for r in universe.cap_status(rows, caps, 5e8).collect()}
    assert got == {"A": "qualified", "B": "unavailable", "C": "qualified", "D": "below", "E": "unavailable"}


def test_hash_sample_ignores_order(spark):
    one, two = ([r.s for r in statistics.hash_sample(spark.createDataFrame([(x,) for x in xs], "s string"), "s", 2).collect()] for xs in (["AAA", "BBB", "AAA", "CCC"], ["CCC", "AAA", "BBB"]))
    assert sorted(one) == sorted(two) and len(set(one)) == 2


def test_bootstrap_needs_enough_dates(spark):
    for n, known in ((19, False), (40, True)):
        daily = spark.createDataFrame([(date.fromordinal(738_000 + i), 0.01 * (i % 5)) for i in range(n)], "date date, v double")
        assert (statistics.bootstrap_interval(daily, "v", reps=50).first().ci_low is not None) == known


def test_sector_proxy_of_series_that_stand_still(spark):
    days = [f"2020-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in range(1, 26)]
    up = lambda i, k: 100.0 + (i * k) % 7
    bars = spark.createDataFrame([(t, d, 5.0 if t == "still" else up(i, 3)) for t in ("still", "moves") for i, d in enumerate(days)], "ticker string, date string, close double")
    sectors = spark.createDataFrame([(x, d, up(i, k) if k else 9.0) for x, k in (("A", 0), ("B", 5), ("C", 3)) for i, d in enumerate(days)], "symbol string, date string, close double")
    found = context.sector_proxy(bars, sectors, ["A", "B", "C"]).collect()
    assert {(r.ticker, r.sector) for r in found} == {("still", None), ("moves", "C")}
    assert all(abs(r.correlation - 1) < 1e-9 if r.sector else r.correlation is None for r in found)
