"""The daily scan with a record of how many symbols each gate let through, counted while the scan is written."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marketloom.operators import signals as G
from marketloom.sources.universe import cap_status

FIELDS = (
    "signal_date string, regime string, universe_size long, symbols_with_bars long, priced long, liquid long, cap_known long, cap_qualified long, cap_below long, cap_unavailable long, candidates long, longs long, shorts long, "
    "qc_flagged long, qc_unusual_volume long, qc_countertrend long, min_price double, min_dollar_volume double, min_cap double"
)


def _metrics(observation: Observation) -> dict:
    """What was counted; nothing where the plan is known to have no rows and so was never run."""
    try:
        return observation.get
    except Py4JJavaError:
        return {}


def scan(features: DataFrame, caps: DataFrame, path: str, min_price: float, min_dollar_volume: float, min_cap: float) -> DataFrame:
    """Writes the signals of each ticker's last bar to path and returns one row, FIELDS: the counts at each gate and the thresholds.

    Gates: symbols with bars, price, price and 20-bar dollar volume, market cap (unknown fails), a setup. The counts are metrics of the write itself
    (observe), not further passes. Nulls pass no gate. Without bars the counts are 0, date and regime null. A ticker with a null name counts like others;
    caps of repeated symbols should be made unique before.
    """
    spark, every = features.sparkSession, ("universe", "bars", "caps", "signals")
    seen = {k: Observation(k) for k in every}
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    caps = caps.observe(seen["universe"], F.count(F.lit(1)).alias("universe_size"))
    rows = G.last_bars(features)
    priced = F.col("close") >= min_price
    liquid = priced & (F.col("dv20") >= min_dollar_volume)
    rows = rows.observe(seen["bars"], F.max("date").cast("string").alias("signal_date"), F.max_by("regime", "date").alias("regime"), F.count(F.lit(1)).alias("symbols_with_bars"), count(priced, "priced"), count(liquid, "liquid"))
    rows = cap_status(rows.where(liquid), caps, min_cap)
    status = F.col("cap_status")
    rows = rows.observe(seen["caps"], count(F.col("cap").isNotNull(), "cap_known"), *(count(status == s, f"cap_{s}") for s in ("qualified", "below", "unavailable")))
    found = G.ranked(G.quality(G.candidates(rows.where(status == "qualified"))))
    found = found.observe(
        seen["signals"], F.count(F.lit(1)).alias("candidates"), count(F.col("direction") == "Long", "longs"), count(F.col("direction") == "Short", "shorts"), count(F.col("qc_flagged"), "qc_flagged"),
        count(F.col("quality_status").startswith("CHECK — unusual volume"), "qc_unusual_volume"), count(F.col("qc_counter"), "qc_countertrend"),
    )
    found.write.parquet(path)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    metrics = {k: v for o in seen.values() for k, v in _metrics(o).items()} | {"min_price": float(min_price), "min_dollar_volume": float(min_dollar_volume), "min_cap": float(min_cap)}
    return spark.createDataFrame([tuple(metrics.get(n, None if n in ("signal_date", "regime") else 0) for n in names)], FIELDS)
