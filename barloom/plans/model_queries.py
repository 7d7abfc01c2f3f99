"""Queries of fitted models, denoising and streams: held to invariants and brute force in the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import rounded as R
from barloom.operators import bars as ops
from barloom.operators import baumwelch, labels, regime, reports, scoring, wavelet
from barloom.plans.bar_queries import r, rs
from barloom.plans.tables import bars, bars_cte, preds
from barloom.sources.shared import written
from barloom.streaming.bars import bars_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


MODEL_COLUMNS = ["log_return", "gk_vol_14", "vwap_dist_atr", "atr_14_pct"]
MODEL_FOLDS = labels.Folds(200, 60, 60, 120)


@query("ud3_wavelet_denoise")
def _(spark, d):
    return wavelet.with_denoised(bars(spark, d), "close").select("symbol", "ts", *rs("close", "close_denoised"))


@query("m06_hmm_filter")
def _(spark, d):
    p = ops.price_features(ops.flow_features(bars(spark, d)))
    f = regime.with_regimes(p.select("symbol", "ts", "log_return", "gk_vol_14"), ["log_return", "gk_vol_14"], 200, chunk_seconds=7 * 86400)
    return f.select("symbol", "ts", *rs("regime_prob_0", "regime_prob_1", "regime_prob_2"))


@query("m05_regimes_by_fold")
def _(spark, d):
    """A model for each symbol and fold, from all its train rows; val and test rows filtered under it, each afresh (M5, M6)."""
    p = ops.price_features(ops.flow_features(bars(spark, d)))
    placed = labels.with_folds(p.select("symbol", "ts", "pos", "log_return", "gk_vol_14"), MODEL_FOLDS).withColumn("key", F.concat_ws(":", "symbol", "fold"))
    models = written(baumwelch.fit_by_key(placed.where("role = 'train'"), ["log_return", "gk_vol_14"], 3, 3, key="key", chunk_seconds=7 * 86400), "fold-models")
    rows = placed.where("role <> 'train'").join(models, "key").withColumn("part", F.concat_ws(":", "key", "role"))
    f = regime.filtered(rows, "model", ["log_return", "gk_vol_14"], 3, key="part", chunk_seconds=7 * 86400)
    return f.select("symbol", "fold", "role", "ts", *rs("regime_prob_0", "regime_prob_1", "regime_prob_2"))


@query("m07_online_state_weights")
def _(spark, d):
    """Online weights of the filtered regimes, with states restored that starve (M7)."""
    p = ops.price_features(ops.flow_features(bars(spark, d)))
    f = regime.with_regimes(p.select("symbol", "ts", "log_return", "gk_vol_14"), ["log_return", "gk_vol_14"], 200)
    w = regime.online_weights(f.drop("log_return", "gk_vol_14"), 3)
    return w.select("symbol", "ts", *rs("state_weight_0", "state_weight_1", "state_weight_2"), "bars_since_start", "restored")


def model_rows(spark, d):
    b = labels.triple_barrier(labels.forward_return(ops.price_features(bars(spark, d))), "atr_14")
    return b.select("symbol", "ts", "pos", "label", "fwd_return_10h", *MODEL_COLUMNS).na.drop(subset=["vwap_dist_atr"])


@query("e08_seed_audit")
def _(spark, d):
    """Five bootstrap seeds of every fold's model, and the ensemble of them (M13, E8)."""
    s = scoring.seed_scores(model_rows(spark, d), MODEL_FOLDS, MODEL_COLUMNS, 5, ["symbol", "ts"])
    a = scoring.seed_audit(s, ["symbol", "ts"], "fwd_return_10h")
    return a.select("fold", "seeds", *rs("mean_ic", "std_ic", "min_ic", "max_ic", "ensemble_ic", "mean_seed_spread"))


@query("m12_walk_forward_scores")
def _(spark, d):
    s = scoring.walk_forward_scores(model_rows(spark, d), MODEL_FOLDS, MODEL_COLUMNS)
    return s.select("symbol", "ts", "fold", "split", "label", *rs("prob_long"))


@query("m15_permutation_importance")
def _(spark, d):
    t = preds(spark, d, only=("row_pos", "fold", "split", "forward_return", "f_quantity", "4h_tax")).where("split = 'test'").withColumn("tax", F.col("4h_tax"))
    score = lambda df: df["f_quantity"] / 50 - df["tax"]
    i = scoring.permutation_importance(t, score, ["f_quantity", "tax", ("f_quantity", "tax")], ["profile", "fold"])
    return i.select("profile", "fold", "feature", *rs("mean_drop", "std_drop"))


@query("d22_group_importance")
def _(spark, d):
    t = preds(spark, d, only=("row_pos", "fold", "split", "forward_return", "f_quantity", "f_price", "4h_tax")).where("split = 'test'")
    score = lambda df: df["f_quantity"] / 50 - df["4h_tax"]
    i = scoring.permutation_importance(t, score, ["f_quantity", "f_price", "4h_tax"], ["profile", "fold"])
    g = scoring.group_importance(i, ["profile"])
    return g.select("profile", "timeframe", "family", "features", "rows", *rs("mean_rank_ic_drop", "median_rank_ic_drop", "min_rank_ic_drop", "max_rank_ic_drop", "positive_drop_rate", "total_positive_drop"))


#: The stream closes every bar, so it gives the batch's bars.
SQL["st1_stream_bars"] = f"WITH {bars_cte()} SELECT symbol, ts, open, high, low, close, num_trades, {r('volume', 'volume')}, {r('quote_volume', 'quote_volume')} FROM bars"


@query("st1_stream_bars")
def _(spark, d):
    return bars_once(spark, d, 8).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "num_trades", *rs("volume", "quote_volume"))
