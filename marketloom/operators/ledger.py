"""A prospective ledger of signals whose outcomes mature as bars arrive. State is versioned files; every step is a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.operators.signals import ranked, reparsed_quality
from marketloom.sources import versions
from marketloom.sources.staging import staged

KEY = ["date", "ticker", "direction"]


def admission(snapshot: DataFrame, bench: DataFrame, expected=None) -> DataFrame:
    """One row: signal_date, admitted, reason. A snapshot needs one signal date, which is the market's latest and, if given, the expected one."""
    dates = snapshot.agg(F.countDistinct("date").alias("dates"), F.max("date").alias("signal_date"))
    market = bench.agg(F.max("date").alias("market_date"))
    known = bench.select(F.col("date").alias("signal_date"), F.lit(True).alias("known")).distinct()
    x = dates.crossJoin(F.broadcast(market)).join(F.broadcast(known), "signal_date", "left")
    reason = F.when(F.col("dates") != 1, "snapshot does not hold exactly one signal date").when(F.col("known").isNull(), "signal date is not in the market calendar").when(F.col("signal_date") != F.col("market_date"), "signal date is not the latest market date")
    if expected is not None:
        reason = reason.when(F.col("signal_date") != F.lit(expected).cast("date"), "signal date is not the scheduled run date")
    return x.select("signal_date", reason.isNull().alias("admitted"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def insert(ledger: DataFrame | None, snapshot: DataFrame) -> DataFrame:
    """The ledger with the snapshot's new keys, each with its rank frozen. Running it twice changes nothing."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("setup_score").desc_nulls_last(), *(c for c in ("setup", "quality_flags") if c in snapshot.columns)))
    once = snapshot.withColumn("_n", first).where("_n = 1").drop("_n")
    fresh = reparsed_quality(ranked(once, by=("date", "direction")))
    if ledger is None:
        return fresh
    return ledger.unionByName(fresh.join(ledger.select(*KEY).hint("merge"), KEY, "left_anti"), allowMissingColumns=True)


def signal_bar_status(signals: DataFrame, bars: DataFrame, most: float = 0.005) -> DataFrame:
    """Adds signal_bar_status: valid; pending until the ticker's bars reach the signal's date; invalid if they passed it without one, or if signal_close differs by more than `most`."""
    own = bars.select("ticker", "date", F.col("close").alias("bar_close"))
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_bar"))
    x = signals.join(own.hint("merge"), ["ticker", "date"], "left").join(last.hint("merge"), "ticker", "left")
    waits = F.col("last_bar").isNull() | (F.col("last_bar") < F.col("date"))
    off = (F.col("signal_close") > 0) & (F.abs(F.col("bar_close") / F.col("signal_close") - 1) > most)
    status = F.when(F.col("bar_close").isNull(), F.when(waits, "pending").otherwise("invalid: no ticker bar on signal date")).when(off, "invalid: signal close mismatch >0.5%").otherwise("valid")
    return x.withColumn("signal_bar_status", status).drop("bar_close", "last_bar")


def mature(outcomes: DataFrame, update: DataFrame) -> DataFrame:
    """Outcomes by key and horizon after an update: what was complete stays as it was, the rest takes the new state."""
    keys = [*KEY, "horizon"]
    done = outcomes.where("status = 'complete'")
    return done.unionByName(update.join(done.select(*keys).hint("merge"), keys, "left_anti"), allowMissingColumns=True)


def tracking_status(outcomes: DataFrame) -> DataFrame:
    """Overall status of each signal: complete, partial, pending, or invalid if no horizon can complete."""
    n, done, waits = F.count("*"), F.count_if(F.col("status") == "complete"), F.count_if(F.col("status").startswith("pending"))
    return outcomes.groupBy(*KEY).agg(F.when(done == n, "complete").when(done > 0, "partial").when(waits > 0, "pending").otherwise("invalid").alias("tracking_status"), done.alias("complete_horizons"))


def refresh_set(outcomes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Tickers whose bars are needed: those with an open outcome and the new candidates."""
    return outcomes.where("status != 'complete'").select("ticker").union(snapshot.select("ticker")).distinct()


def run(spark: SparkSession, folder: str, snapshot: DataFrame, outcomes: Callable[[DataFrame], DataFrame]) -> int:
    """One run of the ledger: inserts the snapshot, updates the outcomes, and publishes both and the tracking status as the next version.

    outcomes gives the present outcomes of a ledger's signals. The version that is read is never overwritten; a run that breaks off leaves it current,
    and of two runs at once one raises FileExistsError.
    """
    last = versions.current(spark, folder)
    before, done = (versions.table(spark, folder, name, last) for name in ("ledger", "outcomes"))
    now = staged(insert(before, snapshot), "ledger")
    fresh = outcomes(now)
    state = staged(fresh if done is None else mature(done, fresh), "outcomes")
    return versions.commit(spark, folder, {"ledger": now, "outcomes": state, "tracking": tracking_status(state)}, last)
