"""What larger tables pay for: ranges read by few frames, setups weighed once, and signals that a query computes once."""

import datetime
import statistics

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketloom.operators import indicators, mechanics, outcomes, signals
from marketloom.plans.daily import features
from marketloom.plans.studies import ahead


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_ranges_are_covered_by_short_ones(spark):
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i)
    rows = spark.createDataFrame([(t, day(i), None if t == "b" and i % 37 == 5 else float(i * 31 % 47), float(i * 17 % 29)) for t, n in (("a", 130), ("b", 130), ("c", 3)) for i in range(n)], "ticker string, date date, high double, low double")
    lengths = (3, *indicators.RANGE_LENGTHS)
    got = indicators.extremes(rows, lengths)
    plain = {c: indicators.full(F.col(x), n, agg, 1) for n in lengths for c, x, agg in ((f"hh_{n}", "high", F.max), (f"ll_{n}", "low", F.min))}
    both = got.withColumns({f"plain_{c}": x for c, x in plain.items()})
    assert both.where(" or ".join(f"not ({c} <=> plain_{c})" for c in plain)).count() == 0 and both.where("hh_50 is not null").count() == 80
    assert not any(f"RowFrame, -{n}, -1)" in plan(got) for n in (5, 12, 15, 20, 50))


def test_score_is_weighed_for_setups_only(spark, sf_small):
    # the score's steps by volume stood in the function of each base length, for both directions
    assert "lambda" in plan(signals.candidates(features(spark, sf_small)))
    generate = next(x for x in plan(signals.candidates(features(spark, sf_small))).splitlines() if "Generate explode" in x)
    assert "rvol20" not in generate.split("false, [")[0] and "regime" not in generate.split("false, [")[0]


def test_trades_stay_within_the_row(spark):
    bars = [{"date": datetime.date(2024, 1, 2 + i), "open": o, "high": h, "low": lo, "close": c} for i, (o, h, lo, c) in enumerate([(10.0, 10.5, 9.8, 10.2), (10.2, 12.5, 10.0, 12.0), (12.0, 13.0, 8.0, 9.0)])]
    schema = "ticker string, date date, direction string, setup string, regime string, rn long, entry double, stop double, target double, atr20_pct double, ahead array<struct<date:date,open:double,high:double,low:double,close:double>>"
    rows = [(t, datetime.date(2024, 1, 1), side, "x", None, 300, 10.0, stop, target, 0.1, b) for t, side, stop, target, b in (("a", "Long", 9.0, 12.0, bars), ("b", "Short", 11.0, 8.0, bars), ("c", "Long", 9.0, 12.0, []), ("d", "Long", 9.0, 12.0, [bars[2]]))]
    x = mechanics.traded(spark.createDataFrame(rows, schema), None)
    assert "Window" not in plan(x) and "Aggregate" not in plan(x)
    got = {(r.ticker, r.variant): (r.reason, r.outcome, r.realized_r) for r in x.collect()}
    assert {k[0] for k in got} == {"a", "b", "d"} and len(got) == 24
    assert got["a", "Fixed_Signal_Levels"] == ("target", 1, 2.0) and got["b", "Fixed_Signal_Levels"] == ("stop", 0, -1.0)
    assert got["d", "Fixed_Signal_Levels"] == ("target_at_open", 1, pytest.approx(2 / 3)) and got["d", "Signal_Close_Benchmark"][0] == "same_bar_ambiguous" and got["d", "Gap_Guard_5pct"][0] == "stop" and got["a", "Entry_ATR_1.0x"][0] == "target"


def test_summary_holds_no_group_in_one_task(spark):
    values = [("v", "target", 2.0), ("v", "stop", -1.0), ("v", "target_at_open", 0.3), ("v", "gap_filtered", None), ("v", "zero_risk", None), ("v", "timeout", -1.0), ("w", "gap_filtered", None), ("u", "stop_at_open", -0.7), ("u", "target_at_open", 0.1)]
    trades = spark.createDataFrame([(v, int(r.startswith("target")), r, x) for v, r, x in values], "variant string, outcome int, reason string, realized_r double")
    x = mechanics.mechanics_summary(trades, "variant")
    assert "percentile" not in plan(x)
    got = {r.variant: r.asDict() for r in x.collect()}
    held = [v for n, _, v in values if n == "v" and v is not None]
    assert got["v"]["median_r"] == pytest.approx(statistics.median(held)) and got["v"]["mean_r"] == pytest.approx(statistics.mean(held)) and got["u"]["median_r"] == pytest.approx(-0.3)
    assert (got["v"]["rows"], got["v"]["n"], got["v"]["gap_filtered"], got["v"]["timeouts"], got["v"]["success_rate"]) == (6, 5, 1, 1, 0.4)
    assert (got["w"]["rows"], got["w"]["n"], got["w"]["success_rate"], got["w"]["mean_r"], got["w"]["median_r"], got["w"]["gap_filtered_share"]) == (1, 0, None, None, None, 1.0)


@pytest.mark.parametrize("name", ["prt_06_folds", "top_01_stable_order", "agg_10_robust_variants"])
def test_signals_are_written_before_they_are_read_twice(spark, sf_small, name):
    assert not any("lineitem" in f for f in entry.queries()[name](spark, sf_small).inputFiles())


def test_gaps_are_computed_once(spark, sf_small):
    gaps = mechanics.entry_gaps(outcomes.labelled(ahead(spark, sf_small), reanchor=True))
    once = plan(gaps).count("Relation [")
    assert plan(mechanics.gap_guards(gaps)).count("Relation [") == once
    rows = spark.createDataFrame([("Long", 1, 0.1), ("Long", 0, 0.6), ("Short", 1, 0.8)], "direction string, outcome int, adverse_gap_r double")
    got = {(r.direction, r.guard): (r.n, r.excluded, r.success_rate) for r in mechanics.gap_guards(rows, (0.25, 0.75)).collect()}
    assert got == {("Long", None): (2, 0, 0.5), ("Long", 0.25): (1, 1, 1.0), ("Long", 0.75): (2, 0, 0.5), ("Short", None): (1, 0, 1.0)}


def test_union_computes_signals_once(spark, sf_small):
    x = entry.queries()["set_01_union"](spark, sf_small)
    assert "Window" not in plan(x) and "Generate" not in plan(x)
    assert {r.direction: r["count"] for r in x.groupBy("direction").count().collect()} == {r.direction: r["count"] for r in signals.historical(features(spark, sf_small)).groupBy("direction").count().collect()}
