"""Typed tables from raw exchange rows and archives.

Archives are read by Spark: zip files come through the binaryFile source, one row a file, and
are unpacked in tasks; a path list or glob is the pruning by month and day.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The archives' column names, in their order.
KLINE_COLUMNS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "num_trades", "taker_buy_base_vol", "taker_buy_quote_vol", "ignore"]
#: The intervals of the exchange's archives.
INTERVAL_SECONDS = {"1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200, "1d": 86400}


def interval_seconds(interval: str) -> int:
    if interval not in INTERVAL_SECONDS:
        raise ValueError(f"unsupported interval {interval}: one of {', '.join(INTERVAL_SECONDS)}")
    return INTERVAL_SECONDS[interval]


def typed_klines(raw: DataFrame) -> DataFrame:
    """Twelve raw columns (strings or numbers, epoch ms) to types; a value that does not parse raises."""
    missing = [c for c in KLINE_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    at = lambda c: F.timestamp_millis(F.col(c).cast("bigint"))
    other = [c for c in raw.columns if c not in KLINE_COLUMNS]
    return raw.select(*other, at("open_time").alias("timestamp"), *[F.col(c).cast("double") for c in KLINE_COLUMNS[1:6]], at("close_time").alias("close_time"), F.col("quote_volume").cast("double"), F.col("num_trades").cast("bigint"), F.col("taker_buy_base_vol").cast("double"), F.col("taker_buy_quote_vol").cast("double"))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; dropDuplicates would keep any."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Where a row stood in its archive, as zipped_csv gives it with numbered=True.
ORDER = ["_file", "_line"]


def in_order(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """raw with columns that say which row comes first: its archive and line where known, else the order of the scan."""
    return (raw, ORDER) if set(ORDER) <= set(raw.columns) else (raw.withColumn("_line", F.monotonically_increasing_id()), ["_line"])


def futures_metrics(raw: DataFrame) -> DataFrame:
    """Five-minute positioning snapshots: create_time to timestamp, numbers coerced, first row of a timestamp."""
    ts = "create_time" if "create_time" in raw.columns else "timestamp"
    if missing := [c for c in (ts, "symbol") if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    raw, order = in_order(raw)
    numbers = [c for c in raw.columns if c not in (ts, "symbol", *ORDER)]
    t = raw.select(F.col(ts).cast("timestamp").alias("timestamp"), "symbol", *[F.col(c).try_cast("double").alias(c) for c in numbers], *order)
    return keep_first(t, ["symbol", "timestamp"], order).drop(*order)


def funding_rates(raw: DataFrame) -> DataFrame:
    """Funding events: fundingTime (ms), fundingRate strict, markPrice coerced or missing; the first row of a timestamp."""
    if missing := [c for c in ("fundingTime", "fundingRate", "symbol") if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    raw, order = in_order(raw)
    mark = F.col("markPrice").try_cast("double") if "markPrice" in raw.columns else F.lit(None).cast("double")
    t = raw.select(F.timestamp_millis(F.col("fundingTime").cast("bigint")).alias("timestamp"), "symbol", F.col("fundingRate").cast("double").alias("funding_rate"), mark.alias("mark_price"), *order)
    return keep_first(t, ["symbol", "timestamp"], order).drop(*order)


def zipped_csv(spark: SparkSession, paths: str | list[str], columns: list[str], header: bool = False, numbered: bool = False) -> DataFrame:
    """Rows of the CSV file in each zip, as strings; rows whose first column is no number are header rows and go.
    numbered: also each row's archive (_file) and line (_line)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                line = 0
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                    for part in pd.read_csv(f, header=0 if header else None, names=columns, dtype=str, chunksize=100_000):
                        if numbered:
                            part["_file"], part["_line"] = path, range(line, line + len(part))
                            line += len(part)
                        yield part

    rows = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns) + (", _file string, _line long" if numbered else ""))
    return rows if header else rows.where(F.col(columns[0]).try_cast("bigint").isNotNull())


def archive_paths(base: str, symbol: str, interval: str, start: str, end: str, kind: str = "klines", by: str = "monthly") -> list[str]:
    """Archive names that cover [start, end), by month or day; a few strings, so made on the driver.
    kind: klines, or a kind of table without an interval (metrics, fundingRate)."""
    if kind == "klines":
        interval_seconds(interval)
    periods = pd.period_range(start, pd.Timestamp(end) - pd.Timedelta("1us"), freq="M" if by == "monthly" else "D")
    folder, stem = (f"{symbol}/{interval}", f"{symbol}-{interval}") if kind == "klines" else (symbol, f"{symbol}-{kind}")
    return [f"{base}/{by}/{kind}/{folder}/{stem}-{p}.zip" for p in periods]


def present(spark: SparkSession, folder: str) -> set[str]:
    """Names of the zip files under a folder; their contents aren't read. One short string an archive."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(folder).select("path")
        return {r["path"].rpartition("/")[2] for r in found.collect()}
    except AnalysisException:
        return set()


def chosen_archives(spark: SparkSession, base: str, symbol: str, interval: str, start: str, end: str, kind: str = "klines") -> list[str]:
    """The monthly archive of every month of [start, end) that has one, else the month's daily archives that exist."""
    folder = f"{symbol}/{interval}" if kind == "klines" else symbol
    months, days = present(spark, f"{base}/monthly/{kind}/{folder}"), present(spark, f"{base}/daily/{kind}/{folder}")
    out = []
    for path in archive_paths(base, symbol, interval, start, end, kind):
        month = path[:-4][-7:]
        if path.rpartition("/")[2] in months:
            out.append(path)
        else:
            lo, hi = max(pd.Timestamp(start), pd.Timestamp(month)), min(pd.Timestamp(end), pd.Timestamp(month) + pd.DateOffset(months=1))
            out += [p for p in archive_paths(base, symbol, interval, str(lo), str(hi), kind, "daily") if p.rpartition("/")[2] in days]
    return out


def archived_klines(spark: SparkSession, base: str, symbol: str, interval: str, start: str, end: str) -> DataFrame:
    """Typed bars of [start, end) from the chosen archives, the first row of a timestamp, with the symbol."""
    paths = chosen_archives(spark, base, symbol, interval, start, end)
    if not paths:
        raise ValueError(f"no archive of {symbol} {interval} between {start} and {end}")
    rows = typed_klines(zipped_csv(spark, paths, KLINE_COLUMNS, numbered=True))
    kept = rows.where((F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") < F.lit(end).cast("timestamp")))
    return keep_first(kept, ["timestamp"], ORDER).drop(*ORDER).withColumn("symbol", F.lit(symbol))


def futures_archives(spark: SparkSession, base: str, symbol: str, columns: list[str], start: str, end: str) -> DataFrame:
    """Positioning snapshots of [start, end) from the daily archives that exist."""
    days = present(spark, f"{base}/daily/metrics/{symbol}")
    paths = [p for p in archive_paths(base, symbol, "", start, end, "metrics", "daily") if p.rpartition("/")[2] in days]
    if not paths:
        raise ValueError(f"no metrics of {symbol} between {start} and {end}")
    rows = futures_metrics(zipped_csv(spark, paths, columns, header=True, numbered=True))
    return rows.where((F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") < F.lit(end).cast("timestamp")))
