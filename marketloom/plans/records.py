"""Queries over what is written and read back: files with rejects, partitioned tables, run records, resumed builds, versions. Each has its SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import ledger, status
from marketloom.operators import outcomes as O
from marketloom.plans import sql as S
from marketloom.plans.daily import MIN_DOLLAR_VOLUME, features, historical, rounded
from marketloom.plans.ledgers import DAY
from marketloom.plans.studies import _CAPS, _DENSE, _FIXED, _SIG, _UNIVERSE, MIN_CAP, dense
from marketloom.sources import builds, fixtures, sinks, universe, versions
from marketloom.sources.delimited import read_with_rejects
from marketloom.sources.staging import new_path

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Price threshold that suits the derived bars.
MIN_PRICE = 50.0
#: Chunks of the resumed build, and how many are written a job.
CHUNKS, STEP = 8, 2


def register(name: str, query, text: str | None = None) -> None:
    QUERIES[name] = lambda s, d: rounded(query(s, d))
    if text is not None:
        SQL[name] = text


def text_files(lines: DataFrame, header: str, path: str, trailer: str | None = None) -> None:
    """Writes lines(value) as text files that each begin with the header."""

    def framed(batches):
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])
        if trailer:
            yield pa.RecordBatch.from_arrays([pa.array([trailer])], ["value"])

    lines.select("value").mapInArrow(framed, "value string").write.text(path)


def _cells(sep: str, *cells: Column) -> Column:
    return F.concat_ws(sep, *(F.coalesce(c, F.lit("")) for c in cells))


def directory(s: SparkSession, d: str) -> DataFrame:
    """The symbol directory as a file with a trailer, some records short of cells and some with too many: rows and rejects."""
    path, u = new_path(s, "directory"), fixtures.universe(s, d)
    whole = _cells("|", F.col("symbol"), F.col("security_name"), F.col("etf"), F.col("test_issue"), F.lit("N"))
    line = F.when(F.col("source_order") % 23 == 0, _cells("|", F.col("symbol"), F.col("security_name"))).when(F.col("source_order") % 29 == 0, F.concat(whole, F.lit("|x|y"))).otherwise(whole)
    text_files(u.select(line.alias("value")), "|".join(universe.DIRECTORY_COLUMNS), path, "File Creation Time: 0101202422:00|||||")
    rows, rejects = universe.read_directory_with_rejects(s, path)
    return rows.select(F.lit("ok").alias("reason"), F.col("Symbol").alias("symbol"), F.col("Security Name").alias("security_name"), F.col("ETF").alias("etf"), F.lit(None).cast("string").alias("record")).unionByName(rejects.drop("file"), allowMissingColumns=True)


register(
    "src_01_directory", directory,
    f"""with {_UNIVERSE}, l as (select *, coalesce(symbol, '') || '|' || coalesce(security_name, '') as short, coalesce(symbol, '') || '|' || coalesce(security_name, '') || '|' || coalesce(etf, '') || '|' || test_issue || '|N' as whole from u)
    select case when source_order % 23 = 0 or source_order % 29 = 0 then 'malformed' when symbol is null then 'missing Symbol' else 'ok' end as reason, case when reason = 'ok' then symbol end as symbol,
    case when reason = 'ok' then security_name end as security_name, case when reason = 'ok' then etf end as etf, case when source_order % 23 = 0 then short when source_order % 29 = 0 then whole || '|x|y' when symbol is null then whole end as record from l""",
)


def ledger_csv(s: SparkSession, d: str) -> DataFrame:
    """Signals through CSV files in which some dates are missing and some scores are no numbers: rows and rejects."""
    path, day = new_path(s, "ledger-csv"), F.dayofmonth("date")
    x = historical(s, d).select("ticker", "date", "direction", "setup_score")
    date = F.when(day != 7, F.col("date").cast("string"))
    score = F.when(day == 3, "n/a").otherwise(F.col("setup_score").cast("string"))
    text_files(x.select(_cells(",", F.col("ticker"), date, F.col("direction"), score).alias("value")), "ticker,date,direction,setup_score", path)
    rows, rejects = read_with_rejects(s, path, "ticker string, date date, direction string, setup_score double", ("ticker", "date"))
    return rows.withColumn("reason", F.lit("ok")).unionByName(rejects.drop("file"), allowMissingColumns=True)


register(
    "src_06_csv_with_rejects", ledger_csv,
    S.with_(*_SIG) + """select ticker, date, direction, setup_score, 'ok' as reason, null::varchar as record from signals where day(date) not in (3, 7)
    union all select null, null, null, null, case day(date) when 3 then 'malformed' else 'missing date' end, ticker || ',' || case day(date) when 7 then '' else date::varchar end || ',' || direction || ',' || case day(date) when 3 then 'n/a' else setup_score::varchar end from signals where day(date) in (3, 7)""",
)
_SCHEMA = "ticker string, date date, direction string, setup string, setup_score double, entry double"


def by_month(s: SparkSession, d: str, first: str | None = None, last: str | None = None) -> DataFrame:
    path = new_path(s, "signals")
    sinks.write_by_month(historical(s, d).select(*(f.split()[0] for f in _SCHEMA.split(", "))), path)
    return sinks.read_by_month(s, path, _SCHEMA, first, last)


_COLUMNS = f"ticker, date, direction, setup, {S.half_up('setup_score', 6)} as setup_score, {S.half_up('entry', 6)} as entry"
register("snk_01_parquet_by_month", by_month, S.with_(*_SIG) + f"select {_COLUMNS} from signals")
register("src_05_pruned_parquet", lambda s, d: by_month(s, d, "1998-03-15", "1998-06-10").select("ticker", "date", "entry"), S.with_(*_SIG) + f"select ticker, date, {S.half_up('entry', 6)} as entry from signals where date between date '1998-03-15' and date '1998-06-10'")


def csv_table(s: SparkSession, d: str) -> DataFrame:
    """A small aggregate through a CSV table."""
    path = new_path(s, "summary")
    x = historical(s, d).groupBy("direction", "setup").agg(F.count("*").alias("n"), F.max("setup_score").alias("best_score"))
    sinks.write_csv_table(x, path)
    return s.read.schema("direction string, setup string, n long, best_score double").option("header", True).option("enforceSchema", False).csv(path)


register("snk_02_csv_table", csv_table, S.with_(*_SIG) + "select direction, setup, count(*) as n, max(setup_score) as best_score from signals group by 1, 2")


def run_status(s: SparkSession, d: str) -> DataFrame:
    """The scan's record, written as JSON and read back."""
    path, record = new_path(s, "scan"), new_path(s, "status")
    sinks.write_status(status.scan(features(s, d), fixtures.market_caps(s, d), path, MIN_PRICE, MIN_DOLLAR_VOLUME, MIN_CAP), record)
    return s.read.schema(status.FIELDS).json(record)


_N = lambda where: f"count(*) filter (where {where})"
register(
    "snk_03_run_status", run_status,
    S.with_(*_SIG, S.QUALITY, _CAPS) + f""", l as (select f.*, c.cap, close >= {MIN_PRICE} as priced, coalesce(close >= {MIN_PRICE} and dv20 >= {MIN_DOLLAR_VOLUME}, false) as liquid from features f left join caps c on symbol = ticker
      where date = (select max(b.date) from bars b where b.ticker = f.ticker)),
    g as (select q.* from quality q join l on l.ticker = q.ticker and l.date = q.date where liquid and cap >= {MIN_CAP})
    select (select max(date)::varchar from l) as signal_date, (select max_by(regime, date) from l) as regime, (select count(*) from supplier) as universe_size, (select count(*) from l) as symbols_with_bars, (select {_N("priced")} from l) as priced, (select {_N("liquid")} from l) as liquid,
      (select {_N("liquid and cap is not null")} from l) as cap_known, (select {_N(f"liquid and cap >= {MIN_CAP}")} from l) as cap_qualified, (select {_N(f"liquid and cap < {MIN_CAP}")} from l) as cap_below, (select {_N("liquid and cap is null")} from l) as cap_unavailable,
      count(*) as candidates, {_N("direction = 'Long'")} as longs, {_N("direction = 'Short'")} as shorts, {_N("qc_flagged")} as qc_flagged, {_N("quality_status like 'CHECK — unusual volume%'")} as qc_unusual_volume, {_N("qc_counter")} as qc_countertrend,
      {MIN_PRICE}::double as min_price, {MIN_DOLLAR_VOLUME}::double as min_dollar_volume, {MIN_CAP}::double as min_cap from g""",
)


class Broken(Exception):
    """A build that was stopped."""


def resumed(s: SparkSession, d: str) -> DataFrame:
    """Signals built by chunks of tickers: a first run that is stopped after a job, and a second one that does the rest."""
    folder = new_path(s, "build")
    rows = builds.chunked(historical(s, d).select(*(f.split()[0] for f in _SCHEMA.split(", "))), "ticker", CHUNKS)

    def stop(_):
        raise Broken

    try:
        builds.build(rows, folder, CHUNKS, STEP, after=stop)
    except Broken:
        builds.build(rows, folder, CHUNKS, CHUNKS)
    return builds.built(s, folder, rows.schema).drop("chunk")


register("snk_04_resumed_build", resumed, S.with_(*_SIG) + f"select {_COLUMNS} from signals")


def two_versions(s: SparkSession, d: str) -> DataFrame:
    """The ledger after a run on the day it began and one on all bars, read through its manifest."""
    folder = new_path(s, "versions")
    signals, bars, bench = dense(s, d)
    upto = lambda x: x.where(F.col("date") <= DAY)
    ledger.run(s, folder, upto(signals), lambda x: O.fixed_horizon(x, upto(bars), upto(bench)))
    ledger.run(s, folder, signals, lambda x: O.fixed_horizon(x, bars, bench))
    rows, tracking = (versions.table(s, folder, name) for name in ("ledger", "tracking"))
    return rows.select(*ledger.KEY, "signal_rank").join(tracking.hint("merge"), ledger.KEY, "left")


register(
    "led_07_versions", two_versions,
    S.with_(*_DENSE, _FIXED) + """, tr as (select date, ticker, direction, case when count(*) filter (where status = 'complete') = count(*) then 'complete' when count(*) filter (where status = 'complete') > 0 then 'partial'
      when count(*) filter (where status like 'pending%') > 0 then 'pending' else 'invalid' end as tracking_status, count(*) filter (where status = 'complete') as complete_horizons from fx group by 1, 2, 3)
    select q.ticker, q.date, q.direction, row_number() over (partition by q.date, q.direction order by q.setup_score desc, q.ticker) as signal_rank, tracking_status, complete_horizons from quality q left join tr using (date, ticker, direction)""",
)
