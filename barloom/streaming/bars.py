"""Bars and regimes from a stream of ticks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.regime import Hmm, Weights, forward_filter, online_step
from barloom.sources.shared import scratch


def stream_bars(ticks: DataFrame, interval: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """ticks (symbol, ts timestamp, tick, price, size, is_buy) to closed bars; ticks later than the watermark are dropped."""
    at = F.struct("ts", "tick")
    buy = F.when(F.col("is_buy"), F.col("size")).otherwise(0)
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", interval).alias("w"))
    b = g.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").cast("double").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("quote_volume"), F.count("*").alias("num_trades"), F.sum(buy).cast("double").alias("taker_buy_base_vol"), F.sum(F.col("price") * buy).alias("taker_buy_quote_vol"))
    return b.select("symbol", F.col("w.start").alias("ts"), *[c for c in b.columns if c not in ("symbol", "w")])


def stream_filter(rows: DataFrame, h: Hmm, columns: list[str]) -> DataFrame:
    """Forward regime probabilities, one state vector a symbol kept between batches. Rows: symbol, ts, columns."""
    k = len(h.start)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a = np.array(state.get[0]) if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = forward_filter(h, np.nan_to_num(pdf[columns].to_numpy(float)), a)
        state.update((out[-1].tolist(),))
        yield pd.DataFrame({"symbol": key[0], "ts": pdf["ts"].to_numpy(), **{f"regime_prob_{i}": out[:, i] for i in range(k)}})

    schema = "symbol string, ts timestamp, " + ", ".join(f"regime_prob_{i} double" for i in range(k))
    return rows.groupBy("symbol").applyInPandasWithState(run, schema, "a array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_weights(rows: DataFrame, states: int, limits: Weights = Weights()) -> DataFrame:
    """Online state weights over a stream of regime probabilities (symbol, ts, regime_prob_0..): `regime.online_weights` with
    the weights of a symbol kept between batches. Rows of a batch are put in order of time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else [1.0] * states + [0.0]
        n, seen = np.array(held[:states]), int(held[states])
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        weights, counts, restored = np.empty((len(pdf), states)), [], []
        for t, gamma in enumerate(pdf[[f"regime_prob_{i}" for i in range(states)]].to_numpy(float)):
            n, own = online_step(n, gamma, limits)
            seen += 1
            weights[t] = n
            counts.append(seen)
            restored.append(",".join(map(str, own)))
        state.update(([*n.tolist(), float(seen)],))
        yield pd.DataFrame({"symbol": key[0], "ts": pdf["ts"].to_numpy(), **{f"state_weight_{i}": weights[:, i] for i in range(states)}, "bars_since_start": counts, "restored": restored})

    schema = "symbol string, ts timestamp, " + ", ".join(f"state_weight_{i} double" for i in range(states)) + ", bars_since_start long, restored string"
    return rows.groupBy("symbol").applyInPandasWithState(run, schema, "a array<double>", "append", GroupStateTimeout.NoTimeout)


def late_ticks(ticks: DataFrame, bars: DataFrame, interval: str = "1 hour") -> DataFrame:
    """Ticks that a stream's bars don't hold because they came behind the watermark: those whose bar is not there, or has
    not counted them. ticks and bars are tables (what was read, what was written): symbol, ts, tick; symbol, ts, num_trades.

    Returned per bar: symbol, ts, late (how many), and the whole bar's own count, so that bars and late ticks together are
    the batch table."""
    whole = ticks.groupBy("symbol", F.window("ts", interval)["start"].alias("ts")).agg(F.count("*").alias("all_trades"))
    met = whole.join(bars.select("symbol", "ts", F.col("num_trades").alias("counted")), ["symbol", "ts"], "left")
    return met.select("symbol", "ts", (F.col("all_trades") - F.coalesce("counted", F.lit(0))).alias("late"), "all_trades").where("late > 0")


#: Later than any tick: moves the watermark past the last windows once all ticks are read.
CLOSING = "2500-01-01 00:00:00"


def bars_once(spark: SparkSession, sf_dir: str, symbols: int) -> DataFrame:
    """The bars of a stream over the events table, all of them closed, as a table in the shared folder.

    A closing tick without a symbol comes in with the events; its own window stays open, and what other windows
    hold is written by the file sink, so nothing passes through the driver."""
    path, folder = f"{sf_dir}/events.parquet", f"{scratch(spark)}/stream-bars-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    closing = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.lit(CLOSING).cast(f.dataType).alias("ts") for f in schema])
    closing.write.parquet(f"{folder}/closing")
    parent, _, leaf = path.rpartition("/")
    e = spark.readStream.schema(schema).option("pathGlobFilter", leaf).parquet(parent) if not leaf_is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    e = e.unionByName(spark.readStream.schema(schema).parquet(f"{folder}/closing"))
    ticks = e.select(F.concat(F.lit("S"), (F.col("user_id") % symbols).cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick"), F.col("value").alias("price"), (1 + F.col("event_id") % 10).alias("size"), F.col("event_type").isin("click", "purchase").alias("is_buy"))
    bars = stream_bars(ticks)
    q = bars.writeStream.format("parquet").option("path", f"{folder}/bars").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{folder}/bars").where("symbol IS NOT NULL")


def leaf_is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the table is a folder of files, as Spark's writers make, or one file."""
    return not spark.read.parquet(path).inputFiles()[0].rstrip("/").endswith(path.rpartition("/")[2])


def session_bars(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Trading sessions of a symbol: ticks no further apart than `gap`; closed once the watermark is past them."""
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w"))
    s = g.agg(F.count("*").alias("num_trades"), F.sum("size").cast("double").alias("volume"), F.min("price").alias("low"), F.max("price").alias("high"))
    return s.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "num_trades", "volume", "low", "high")
