"""Bars from ticks, and the features of one timeframe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import windows as w
from barloom.functions.scalars import clip, flag, positive_log, safe_div

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def bucket(ts: str, seconds: int):
    """Start of the bucket of `seconds` that holds ts (TIMESTAMP_NTZ)."""
    return F.expr(f"cast(timestampadd(SECOND, cast(floor(timestampdiff(SECOND, {EPOCH}, {ts}) / {seconds}) * {seconds} as bigint), {EPOCH}) as timestamp_ntz)")


def build_bars(ticks: DataFrame, seconds: int) -> DataFrame:
    """ticks (symbol, ts, tick, price, size, is_buy) to bars; one partial aggregation, one shuffle."""
    at = F.struct("ts", "tick")
    buy = F.when(F.col("is_buy"), F.col("size")).otherwise(0)
    return ticks.groupBy("symbol", bucket("ts", seconds).alias("ts")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("size").cast("double").alias("volume"),
        F.sum(F.col("price") * F.col("size")).alias("quote_volume"),
        F.count("*").alias("num_trades"),
        F.sum(buy).cast("double").alias("taker_buy_base_vol"),
        F.sum(F.col("price") * buy).alias("taker_buy_quote_vol"),
    )


def positioned(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pos", F.row_number().over(w.ordered()) - 1)


def flow_features(bars: DataFrame, n: int = 24) -> DataFrame:
    """Taker flow: ratios, signed volume, its z-score and the slope of its running sum."""
    c = F.col
    b = positioned(bars).withColumns({
        "taker_buy_ratio": clip(safe_div(c("taker_buy_base_vol"), c("volume"), 0.5), 0, 1),
        "true_cvd_delta": 2 * c("taker_buy_base_vol") - c("volume"),
        "vol_per_trade": safe_div(c("volume"), c("num_trades"), 0.0),
    })
    b = b.withColumns({
        "taker_sell_ratio": 1 - c("taker_buy_ratio"),
        "true_cvd_zscore": w.zscore(c("true_cvd_delta"), n),
        "cvd_cumulative": F.sum("true_cvd_delta").over(w.ordered().rowsBetween(w.W.unboundedPreceding, 0)),
        "vpt_zscore": w.zscore(c("vol_per_trade"), n),
    })
    large = F.when(c("vpt_zscore") > 2.0, c("volume")).otherwise(0.0)
    return b.withColumns({
        "cvd_cumulative_rate": w.slope(c("cvd_cumulative"), n),
        "whale_buy_flag": flag((c("vpt_zscore") > 2.0) & (c("taker_buy_ratio") > 0.55)),
        "whale_sell_flag": flag((c("vpt_zscore") > 2.0) & (c("taker_buy_ratio") < 0.45)),
        "large_trade_ratio": safe_div(w.total(large, n), w.total(c("volume"), n), 0.0),
    })


def price_features(bars: DataFrame, n: int = 14, vwap_n: int = 24) -> DataFrame:
    """Log return, realised and range volatility, true range and its mean, distance from rolling VWAP."""
    c = F.col
    before = F.lag("close").over(w.ordered())
    b = positioned(bars).withColumns({
        "log_return": positive_log(c("close")) - positive_log(before),
        "true_range": F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before)),
        "gk": 0.5 * F.pow(positive_log(c("high")) - positive_log(c("low")), 2) - (2 * F.ln(F.lit(2.0)) - 1) * F.pow(positive_log(c("close")) - positive_log(c("open")), 2),
    })
    # greatest skips NULL: a bar with a price of zero has no range volatility
    b = b.withColumn("gk", F.when(c("gk").isNotNull(), F.greatest(c("gk"), F.lit(0.0))))
    b = b.withColumns({
        f"realized_vol_{n}": w.deviation(c("log_return"), n),
        f"gk_vol_{n}": F.sqrt(w.mean(c("gk"), n)),
        f"atr_{n}": w.mean(c("true_range"), n),
        "vwap": safe_div(w.total(c("quote_volume"), vwap_n), w.total(c("volume"), vwap_n)),
    })
    return b.withColumns({
        f"atr_{n}_pct": safe_div(c(f"atr_{n}"), c("close")),
        "vwap_dist_atr": safe_div(c("close") - c("vwap"), c(f"atr_{n}")),
    })


def orderflow_features(flow: DataFrame, n: int = 24, pressures: tuple[int, ...] = (3, 6, 12, 24)) -> DataFrame:
    """Order-flow efficiency, absorption and divergence, with means over pressure windows and their spreads.

    flow: bars with flow and price features, made one on the other, so that nothing is joined."""
    c = F.col
    b = flow
    b = b.withColumns({
        "taker_imbalance": clip(2 * c("taker_buy_ratio") - 1, -1, 1),
        "normalized_return": clip(safe_div(c("log_return"), c("realized_vol_14"), 0.0), -10, 10),
        "cvd_norm": safe_div(c("true_cvd_delta"), w.mean(c("volume"), n)),
        "large_excess": F.greatest(c("vpt_zscore") - w.median(c("vpt_zscore"), n), F.lit(0.0)),
    })
    b = b.withColumns({
        "signed_large_trade_pressure": F.when(c("vpt_zscore").isNotNull(), c("large_excess") * c("taker_imbalance")),
        "orderflow_efficiency": clip(safe_div(c("normalized_return"), F.abs(c("cvd_norm")) + 0.001, 0.0), -10, 10),
        "absorption_pressure": clip(-c("normalized_return") * c("taker_imbalance"), -10, 10),
        "cvd_price_divergence": clip(c("cvd_norm") - c("normalized_return"), -10, 10),
        "taker_imbalance_slope": w.slope(c("taker_imbalance"), n),
        "taker_buy_ratio_delta": c("taker_buy_ratio") - F.lag("taker_buy_ratio").over(w.ordered()),
    })
    wide = {}
    for k in pressures:
        wide |= {f"taker_imbalance_mean_{k}": w.mean(c("taker_imbalance"), k), f"cvd_pressure_{k}": w.total(c("cvd_norm"), k), f"absorption_pressure_{k}": w.mean(c("absorption_pressure"), k), f"cvd_price_divergence_{k}": w.mean(c("cvd_price_divergence"), k)}
    b = b.withColumns(wide)
    spread = lambda slow, fast: c(f"cvd_pressure_{slow}") - c(f"cvd_pressure_{fast}")
    return b.withColumns({f"cvd_pressure_{slow}_minus_{fast}": spread(slow, fast) for fast, slow in zip(pressures, pressures[1:])})


def stable(x, n: int, limit: float = 5.0, scale: float = 2.0) -> dict:
    """Clipped z-score, mid-rank and squashed z-score of a column."""
    z = w.zscore(x, n)
    return {"zscore": clip(z, -limit, limit), "rank": w.mid_rank(x, n), "tanh": F.tanh(z / scale)}


def interactions(source, context) -> dict:
    """Products of two columns clipped to [-1, 1]: signed, and with the context's upper or lower side."""
    s, k = clip(source, -1, 1), clip(context, -1, 1)
    side = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    return {"signed": s * k, "high": s * side(k), "low": s * side(-k)}


def intrahour(bars: DataFrame, expected: int = 4, least: int | None = None) -> DataFrame:
    """Shape of an hour's smaller bars, one row an hour; hours with fewer than `least` bars (`expected`, if not
    given) are dropped. A price move is the log return over the range as a share of the open, of the hour or of
    its half; it is NULL without a range or a positive open."""
    c = F.col
    b = bars.withColumns({
        "hour": bucket("ts", 3600),
        "ratio": clip(safe_div(c("taker_buy_base_vol"), c("volume"), 0.5), 0, 1),
    })
    hour = w.W.partitionBy("symbol", "hour")
    b = b.withColumns({
        "i": F.row_number().over(hour.orderBy("ts")) - 1,
        "n": F.count("*").over(hour),
        "imb": clip(2 * c("ratio") - 1, -1, 1),
        "cvd": c("taker_buy_base_vol") - F.greatest(c("volume") - c("taker_buy_base_vol"), F.lit(0.0)),
        "vpt": safe_div(c("volume"), c("num_trades")),
    }).where(c("n") >= (expected if least is None else least))
    b = b.withColumns({
        "early": c("i") < F.greatest(F.lit(1), F.floor(c("n") / 2)),
        "running": F.sum("cvd").over(hour.orderBy("ts").rowsBetween(w.W.unboundedPreceding, 0)),
    })
    halves = {"": F.lit(True), "_early": c("early"), "_late": ~c("early")}
    of = lambda half, x: F.when(halves[half], c(x))
    end = lambda x: F.max_by(x, "i")
    a = b.groupBy("symbol", c("hour").alias("ts")).agg(
        F.count("*").alias("bar_count"),
        F.avg("imb").alias("imb_mean"),
        end("imb").alias("imb_last"),
        (F.avg(of("_late", "imb")) - F.avg(of("_early", "imb"))).alias("imb_late_minus_early"),
        F.regr_slope("imb", c("i").cast("double")).alias("imb_slope"),
        F.regr_slope("running", c("i").cast("double")).alias("cvd_slope"),
        (F.max("ratio") - F.min("ratio")).alias("buy_ratio_range"),
        end("volume").alias("volume_last"),
        end("num_trades").alias("trades_last"),
        end("taker_buy_base_vol").alias("buy_last"),
        F.sum("taker_buy_base_vol").alias("buy"),
        end("vpt").alias("vpt_last"),
        F.avg("vpt").alias("vpt_mean"),
        F.max("vpt").alias("vpt_max"),
        *[x for k in halves for x in (
            F.coalesce(F.sum(of(k, "cvd")), F.lit(0.0)).alias(f"cvd{k}"),
            F.coalesce(F.sum(of(k, "volume")), F.lit(0.0)).alias(f"volume{k}"),
            F.coalesce(F.sum(of(k, "num_trades")), F.lit(0)).alias(f"trades{k}"),
            F.max(of(k, "high")).alias(f"high{k}"),
            F.min(of(k, "low")).alias(f"low{k}"),
            F.min_by("open", F.when(halves[k], c("i"))).alias(f"open{k}"),
            F.max_by("close", F.when(halves[k], c("i"))).alias(f"close{k}"),
        )],
    )

    def move(k: str):
        span = safe_div(F.greatest(c(f"high{k}") - c(f"low{k}"), F.lit(0.0)), F.when(c(f"open{k}") > 0, c(f"open{k}")))
        return F.when(span > 0, clip((positive_log(c(f"close{k}")) - positive_log(c(f"open{k}"))) / (span + 1e-12), -1, 1))

    a = a.withColumns({f"move{k}": move(k) for k in halves} | {f"flow{k}": safe_div(c(f"cvd{k}"), c("volume")) for k in halves})
    up = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    buys = lambda k: up(c(f"flow{k}")) * up(-c(f"move{k}"))
    sells = lambda k: up(-c(f"flow{k}")) * up(c(f"move{k}"))
    reversal = lambda x: F.coalesce(F.when(c(f"{x}_early") != 0, up(-F.signum(c(f"{x}_early")) * c(f"{x}_late"))), F.lit(0.0))
    less_one = lambda x, y: safe_div(x, y) - 1
    per_trade = lambda k: safe_div(c(f"volume{k}"), c(f"trades{k}"))
    share = lambda x: safe_div(x, c("volume"))
    return a.select(
        "symbol", "ts", "bar_count",
        (c("bar_count") / expected).alias("coverage"),
        "imb_mean", "imb_last", "imb_late_minus_early", "imb_slope", "buy_ratio_range",
        c("flow").alias("cvd_pressure_norm"),
        (c("flow_late") - c("flow_early")).alias("cvd_pressure_late_minus_early_norm"),
        share(c("cvd_slope")).alias("cvd_slope_norm"),
        c("move").alias("price_move_norm"),
        (F.signum(c("flow")) * c("move")).alias("flow_price_alignment"),
        buys("").alias("buy_absorption"),
        sells("").alias("sell_absorption"),
        (buys("") - sells("")).alias("absorption_imbalance"),
        buys("_late").alias("late_buy_absorption"),
        sells("_late").alias("late_sell_absorption"),
        (buys("_late") - sells("_late")).alias("late_absorption_imbalance"),
        reversal("flow").alias("late_flow_reversal"),
        reversal("move").alias("late_price_reversal"),
        (F.signum(c("flow_late")) * c("move_late")).alias("late_flow_price_alignment"),
        share(c("volume_last")).alias("volume_share_last"),
        share(c("volume_late")).alias("volume_share_late"),
        safe_div(c("trades_last"), c("trades")).alias("trade_share_last"),
        less_one(c("vpt_last"), per_trade("")).alias("vpt_last_vs_hour"),
        less_one(per_trade("_late"), per_trade("_early")).alias("vpt_late_vs_early"),
        less_one(c("vpt_max"), c("vpt_mean")).alias("large_trade_concentration"),
        safe_div(c("buy_last"), c("buy")).alias("buy_volume_share_last"),
        share(up(c("imb_last")) * c("volume_last")).alias("aggressive_buy_burst"),
        share(up(-c("imb_last")) * c("volume_last")).alias("aggressive_sell_burst"),
    )


def stationary_features(bars: DataFrame, n: int = 24) -> DataFrame:
    """Scale-free forms of a bar's features; bars with flow and price features, denoised columns where they are."""
    c = F.col
    log1p = lambda x: F.log1p(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))))
    b = bars.withColumns({
        "_volume": w.mean(c("volume"), n),
        "volume_log_zscore": w.zscore(log1p(c("volume")), n),
        "vol_per_trade_log_zscore": w.zscore(log1p(c("vol_per_trade")), n),
        "atr_14_pct": safe_div(c("atr_14"), c("close")),
    })
    b = b.withColumns({"true_cvd_delta_norm": safe_div(c("true_cvd_delta"), c("_volume")), "cvd_cumulative_rate_norm": safe_div(c("cvd_cumulative_rate"), c("_volume"))})
    if "close_denoised" in bars.columns:
        x = positive_log(c("close_denoised"))
        b = b.withColumn("close_denoised_log_return", x - F.lag(x).over(w.ordered()))
    if "volume_denoised" in bars.columns:
        b = b.withColumn("volume_denoised_log_zscore", w.zscore(log1p(c("volume_denoised")), n))
    return b.drop("_volume")
