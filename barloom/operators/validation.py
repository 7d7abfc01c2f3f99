"""Checks on bar tables: each is one aggregation; `validated` raises on what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("ts", "open", "high", "low", "close", "volume", "quote_volume", "num_trades", "taker_buy_base_vol", "taker_buy_quote_vol")


def gap_summary(bars: DataFrame, interval_seconds: int) -> DataFrame:
    """Per symbol, after bars without volume are dropped: bars, gaps above the interval, the largest gap."""
    kept = bars.where("volume > 0 AND num_trades > 0")
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    g = kept.withColumn("_before", before).withColumn("gap", F.expr("timestampdiff(SECOND, _before, ts)"))
    return g.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(F.col("gap") > interval_seconds).alias("gap_count_gt_expected"), F.max("gap").alias("max_gap_seconds"))


def taker_summary(bars: DataFrame) -> DataFrame:
    c = F.col
    return bars.groupBy("symbol").agg(
        F.sum(F.abs("taker_buy_base_vol")).alias("taker_sum"),
        F.count_if((c("taker_buy_base_vol") < 0) | (c("taker_buy_base_vol") > c("volume"))).alias("base_out"),
        F.count_if((c("taker_buy_quote_vol") < 0) | (c("taker_buy_quote_vol") > c("quote_volume") + 1e-9)).alias("quote_out"),
        F.count_if((c("volume") <= 0) | (c("num_trades") <= 0)).alias("zero_volume"),
    )


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many values of each column are missing, NaN or infinite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return df.agg(*[F.count_if(bad(c)).alias(c) for c in columns])


def validated(bars: DataFrame, interval_seconds: int, most_gap: float | None = None, zero_volume: str = "error") -> tuple[DataFrame, list]:
    """The bars (without zero-volume ones if zero_volume is "drop") and the gap summary; ValueError on the first fault."""
    missing = [c for c in REQUIRED if c not in bars.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    twice = bars.groupBy("symbol", "ts").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate timestamps, as {[(r['symbol'], str(r['ts'])) for r in twice]}")
    faults = taker_summary(bars).agg(F.sum("zero_volume"), F.sum("base_out"), F.sum("quote_out"), F.sum("taker_sum"), F.count("*")).first()
    if not faults[4]:
        raise ValueError("no bars")
    if faults[0] and zero_volume == "error":
        raise ValueError(f"{faults[0]} bars without volume or trades")
    if faults[1] or faults[2]:
        raise ValueError(f"taker volume outside the bar's volume in {faults[1]} base and {faults[2]} quote values")
    if not faults[3]:
        raise ValueError("taker volume is zero throughout")
    kept = bars.where("volume > 0 AND num_trades > 0")
    summary = gap_summary(kept, interval_seconds).collect()  # one row a symbol
    if most_gap is not None and any((r["max_gap_seconds"] or 0) > interval_seconds * most_gap for r in summary):
        raise ValueError(f"a gap exceeds {most_gap} intervals")
    return kept, summary


def no_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; ValueError with the columns that still hold missing or non-finite values."""
    bad = {c: n for c, n in non_finite(df, columns).first().asDict().items() if n}
    if bad:
        raise ValueError(f"missing or non-finite values: {bad}")
    return df


def in_order(df: DataFrame, saved: list[str]) -> DataFrame:
    """df's columns in the order a model was fitted with; ValueError if any of them is missing."""
    if absent := [c for c in saved if c not in df.columns]:
        raise ValueError(f"features of the fitted model are missing: {absent}")
    return df.select(*saved)


def checked_settings(settings: dict) -> dict:
    """Feature settings; ValueError on windows, scales or pairs that make no sense."""
    for name, window in settings.get("windows", {}).items():
        if not isinstance(window, int) or window <= 1:
            raise ValueError(f"{name} must be a window greater than 1")
    if settings.get("tanh_scale", 1.0) <= 0:
        raise ValueError("tanh_scale must be positive")
    for pair in settings.get("interactions", []):
        if len(pair) != 2 or not all(isinstance(x, str) and x for x in pair):
            raise ValueError(f"an interaction is a pair of column names, not {pair!r}")
    return settings
