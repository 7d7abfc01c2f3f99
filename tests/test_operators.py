"""Invariants and brute force for what SQL cannot express, and hand-made edge cases."""

import datetime as dt
import io
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as ops
from barloom.operators import governance as g
from barloom.operators import labels, losses, metrics, regime, reports, scoring, validation, wavelet
from barloom.operators.asof import asof
from barloom.operators.ewm import adx, ewm_values, with_ewm
from barloom.operators.validation import non_finite, validated
from barloom.plans.tables import bars
from barloom.sources import klines
from barloom.streaming.bars import bars_once, session_bars, stream_filter

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return [T0 + dt.timedelta(hours=i) for i in range(n)]


def made_bars(spark, closes, highs=None, lows=None):
    n = len(closes)
    rows = [("S", t, c, h, lo, c, 1000.0 + i, c * (1000.0 + i), 100 + i % 20, 500.0, 500.0 * c) for i, (t, c, h, lo) in enumerate(zip(hours(n), closes, highs or [c + 0.6 for c in closes], lows or [c - 0.6 for c in closes], strict=True))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, num_trades long, taker_buy_base_vol double, taker_buy_quote_vol double")


def test_ewm_is_that_of_pandas(spark):
    x = pd.Series([1.0, None, 3.0, 4.0, None, None, 2.0, 8.0])
    for least in (1, 3):
        want = x.ewm(alpha=0.3, adjust=False, min_periods=least).mean().to_numpy()
        np.testing.assert_allclose(ewm_values(x.to_numpy(), 0.3, least), want)
    df = made_bars(spark, [100.0 + math.sin(i) for i in range(30)])
    got = [r["e"] for r in with_ewm(df, {"e": ("close", 0.2, 5)}).orderBy("ts").collect()]
    want = pd.Series([100.0 + math.sin(i) for i in range(30)]).ewm(alpha=0.2, adjust=False, min_periods=5).mean()
    assert got[:4] == [None] * 4
    np.testing.assert_allclose(got[4:], want[4:])


@pytest.mark.parametrize("chunk", [3600, 3 * 3600, 50 * 3600])
def test_ewm_is_the_same_however_it_is_cut(spark, chunk):
    x = [None, None, 3.0, None, 5.0, 1.0, None, None, None, None, 2.0, 4.0, 4.5, None, 7.0, 8.0, 1.0]
    df = spark.createDataFrame([(s, t, v) for s in "ST" for t, v in zip(hours(len(x)), x if s == "S" else x[::-1])], "symbol string, ts timestamp_ntz, v double")
    got = with_ewm(df, {"a": ("v", 0.3, 2), "b": ("v", 0.05, 1)}, chunk_seconds=chunk).orderBy("symbol", "ts").collect()
    for s, values in (("S", x), ("T", x[::-1])):
        for name, alpha, least in (("a", 0.3, 2), ("b", 0.05, 1)):
            want = pd.Series(values, dtype=float).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
            np.testing.assert_allclose([np.nan if r[name] is None else r[name] for r in got if r["symbol"] == s], want)


@pytest.mark.parametrize("chunk", [3600, 7 * 3600, 500 * 3600])
def test_denoising_is_the_same_however_it_is_cut(spark, chunk):
    closes = [100 + math.sin(i / 3) + (i * 7919 % 13) / 10 for i in range(50)]
    got = [r["d"] for r in wavelet.with_denoised(made_bars(spark, closes), "close", 16, chunk_seconds=chunk).select("ts", F.col("close_denoised").alias("d")).orderBy("ts").collect()]
    want = wavelet.denoised_last(np.lib.stride_tricks.sliding_window_view(np.array(closes), 16))
    assert got[:15] == [None] * 15
    np.testing.assert_allclose(got[15:], want, atol=1e-12)


def test_adx_is_bounded_and_rises_in_a_trend(spark):
    r = adx(ops.price_features(made_bars(spark, [100.0 + i for i in range(80)])), 14).orderBy("ts").collect()
    assert r[-1]["adx"] == pytest.approx(100.0)
    assert all(x["adx"] is None or 0 <= x["adx"] <= 100 for x in r)


@pytest.mark.parametrize("name", ["flow", "price", "wavelet", "stable"])
def test_later_rows_change_no_earlier_feature(spark, name):
    make = {
        "flow": ops.flow_features,
        "price": ops.price_features,
        "wavelet": lambda b: wavelet.with_denoised(b, "close", 16),
        "stable": lambda b: b.select("symbol", "ts", *[x.alias(k) for k, x in ops.stable(F.col("close"), 12).items()]),
    }[name]
    closes = [100 + 0.04 * i + math.sin(i / 5) for i in range(60)]
    short = {r["ts"]: r for r in make(made_bars(spark, closes[:45])).collect()}
    long = {r["ts"]: r for r in make(made_bars(spark, closes)).collect()}
    for t, r in short.items():
        for c in r.asDict():
            a, b = r[c], long[t][c]
            assert a == b or a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_wavelet_reconstructs_without_threshold():
    x = np.random.default_rng(0).normal(size=(5, 64)).cumsum(axis=1)
    np.testing.assert_allclose(wavelet.denoised_last(x, 2, 0.0), x[:, -1], atol=1e-9)
    noisy = np.ones((1, 64)) + np.random.default_rng(1).normal(scale=0.1, size=(1, 64))
    assert abs(wavelet.denoised_last(noisy, 2, 2.0)[0] - 1) < abs(noisy[0, -1] - 1) + 0.1


def test_barriers_both_touched_count_as_stop(spark):
    closes = [100.0] * 14
    high, low = [100.5] * 14, [99.5] * 14
    high[1], high[6], low[6], low[12] = 103.0, 110.0, 90.0, 90.0
    b = ops.positioned(made_bars(spark, closes, high, low)).withColumn("atr", F.lit(1.0))
    r = labels.triple_barrier(b, "atr", horizon=3).orderBy("ts").collect()
    assert [x["hit_type"] for x in r] == ["tp", "time", "time", "both_sl_first", "both_sl_first", "both_sl_first", "time", "time", "time", "sl", "sl"]
    assert r[0]["label"] == 1 and r[0]["exit_bar"] == 1 and r[0]["tb_return"] == pytest.approx(0.02)
    assert r[3]["tb_return"] == pytest.approx(-0.05) and r[1]["exit_bar"] == 4


def test_asof_takes_equal_times_and_drops_old_rows(spark):
    left = spark.createDataFrame([("S", t) for t in hours(5)], "symbol string, ts timestamp_ntz")
    right = spark.createDataFrame([("S", T0 + dt.timedelta(hours=1), 7)], "symbol string, ts timestamp_ntz, v int")
    assert [r["r_v"] for r in asof(left, right).orderBy("ts").collect()] == [None, 7, 7, 7, 7]
    assert [r["r_v"] for r in asof(left, right, tolerance_seconds=7200).orderBy("ts").collect()] == [None, 7, 7, 7, None]


def test_validation_raises_and_drops(spark):
    b = made_bars(spark, [100.0 + i for i in range(6)])
    kept, summary = validated(b, 3600)
    assert kept.count() == 6 and summary[0]["gap_count_gt_expected"] == 0
    with pytest.raises(ValueError, match="duplicate"):
        validated(b.union(b.limit(1)), 3600)
    with pytest.raises(ValueError, match="missing"):
        validated(b.drop("volume"), 3600)
    zero = b.withColumn("volume", F.when(F.col("close") == 102, 0.0).otherwise(F.col("volume"))).withColumn("taker_buy_base_vol", F.lit(0.0) + F.when(F.col("close") == 102, 0.0).otherwise(1.0))
    with pytest.raises(ValueError, match="without volume"):
        validated(zero, 3600)
    kept, summary = validated(zero, 3600, zero_volume="drop")
    assert kept.count() == 5 and summary[0]["gap_count_gt_expected"] == 1
    with pytest.raises(ValueError, match="gap"):
        validated(zero, 3600, most_gap=1.0, zero_volume="drop")
    assert non_finite(b.withColumn("volume", F.lit(float("nan"))), ["close", "volume"]).first().asDict() == {"close": 0, "volume": 6}


def test_sources_parse_archives(spark, tmp_path):
    rows = "\n".join(f"{1704067200000 + i * 3600000},1.5,2,1,1.7,10,{1704070799999 + i * 3600000},17,{3 + i},5,8.5,0" for i in range(3))
    for name, text in (("a.zip", rows), ("b.zip", ",".join(klines.KLINE_COLUMNS) + "\n" + rows)):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("x.csv", text + "\n")
        (tmp_path / name).write_bytes(data.getvalue())
        t = klines.typed_klines(klines.zipped_csv(spark, str(tmp_path / name), klines.KLINE_COLUMNS)).orderBy("timestamp").collect()
        assert len(t) == 3 and t[1]["num_trades"] == 4 and t[0]["high"] == 2.0
    m = spark.createDataFrame([("2024-01-01 00:00:00", "B", "1.5"), ("2024-01-01 00:00:00", "B", "2.5"), ("2024-01-01 00:05:00", "B", "x")], "create_time string, symbol string, oi string")
    assert sorted((r["oi"] is None, r["oi"] or 0) for r in klines.futures_metrics(m).collect()) == [(False, 1.5), (True, 0)]
    funding = "fundingTime string, symbol string, fundingRate string, markPrice string"
    f = spark.createDataFrame([("1704067200000", "B", "0.0001", "")], funding)
    assert klines.funding_rates(f).first()["mark_price"] is None
    twice = spark.createDataFrame([("1704067200000", "B", "0.0009", ""), ("1704067200000", "B", "0.0001", "")], funding).coalesce(1)
    assert [r["funding_rate"] for r in klines.funding_rates(twice).collect()] == [0.0009]
    with pytest.raises(ValueError, match="missing"):
        klines.funding_rates(f.drop("fundingRate"))
    with pytest.raises(ValueError, match="unsupported"):
        klines.archive_paths("x", "B", "7m", "2024-01-01", "2024-02-01")
    assert [p[-11:-4] for p in klines.archive_paths("x", "B", "1h", "2024-01-15", "2024-03-01")] == ["2024-01", "2024-02"]


def test_archives_by_month_or_else_by_day(spark, tmp_path):
    def put(by, period, hours_):
        folder = tmp_path / by / "klines" / "B" / "1h"
        folder.mkdir(parents=True, exist_ok=True)
        lines = "\n".join(f"{int((T0.replace(tzinfo=dt.timezone.utc) + dt.timedelta(hours=h)).timestamp() * 1000)},1,2,1,{h},10,0,17,3,5,8,0" for h in hours_)
        with zipfile.ZipFile(folder / f"B-1h-{period}.zip", "w") as z:
            z.writestr("x.csv", lines + "\n")

    put("monthly", "2024-01", [0, 1, 1, 743])
    put("daily", "2024-02-01", [744, 745])
    put("daily", "2024-02-03", [792])
    put("daily", "2024-01-05", [96])  # its month has an archive
    got = klines.archived_klines(spark, f"file://{tmp_path}", "B", "1h", "2024-01-01 01:00:00", "2024-02-03").orderBy("timestamp").collect()
    assert [r["close"] for r in got] == [1.0, 743.0, 744.0, 745.0]
    with pytest.raises(ValueError, match="no archive"):
        klines.archived_klines(spark, f"file://{tmp_path}", "C", "1h", "2024-01-01", "2024-02-03")


def test_regimes_filter_forward_only():
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(m, 0.2, size=(30, 3)) for m in (-1, 0, 1)])
    h = regime.fit(x)
    p = regime.forward_filter(h, x)
    np.testing.assert_allclose(p.sum(axis=1), 1)
    np.testing.assert_allclose(regime.forward_filter(h, x[:40]), p[:40])
    assert [int(v) for v in p[[10, 45, 80]].argmax(axis=1)] == [0, 1, 2]


def test_isotonic_is_monotone(spark):
    rng = np.random.default_rng(0)
    rows = [("a", 0, "val" if i % 2 else "test", float(p), int(rng.random() < p)) for i, p in enumerate(rng.random(400))]
    df = spark.createDataFrame(rows, "profile string, fold int, split string, prob_long double, label int")
    out = sorted((r["prob_long"], r["calibrated"]) for r in reports.isotonic(df, ["profile", "fold"]).collect())
    c = [x[1] for x in out]
    assert len(out) == 400 and all(b >= a - 1e-12 for a, b in zip(c, c[1:])) and 0 <= min(c) <= max(c) <= 1
    np.testing.assert_allclose(reports.pool_adjacent(np.array([1.0, 3, 2, 2, 5]), np.ones(5)), [1, 7 / 3, 7 / 3, 7 / 3, 5])
    # exactly: the fit on all distinct val scores, linear between them
    val = sorted((p, y) for _, _, s, p, y in rows if s == "val")
    x, y = np.array([p for p, _ in val]), reports.pool_adjacent(np.array([float(v) for _, v in val]), np.ones(len(val)))
    np.testing.assert_allclose(c, np.interp([p for p, _ in out], x, y), atol=1e-9)


@pytest.mark.parametrize("method", [reports.isotonic, reports.platt])
def test_calibration_of_one_class_or_score_is_its_share(spark, method):
    rows = [("a", 0, "val", 0.2, 1), ("a", 0, "val", 0.8, 1), ("a", 0, "test", 0.5, 0), ("a", 1, "val", 0.3, 1), ("a", 1, "val", 0.3, 0), ("a", 1, "test", 0.9, 0)]
    df = spark.createDataFrame(rows, "profile string, fold int, split string, prob_long double, label int")
    got = {(r["fold"], r["split"], r["prob_long"]): r["calibrated"] for r in method(df, ["profile", "fold"]).collect()}
    assert all(v == pytest.approx(1.0 if k[0] == 0 else 0.5) for k, v in got.items())


def test_platt_is_the_penalised_logistic_fit(spark):
    rng = np.random.default_rng(0)
    rows = [("a", 0, "val", float(p), int(rng.random() < p)) for p in rng.random(300)]
    df = spark.createDataFrame(rows, "profile string, fold int, split string, prob_long double, label int")
    got = sorted((r["prob_long"], r["calibrated"]) for r in reports.platt(df, ["profile", "fold"]).collect())
    x, y = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    z = np.log([c / (1 - c) for _, c in got])
    slope = (z[-1] - z[0]) / (got[-1][0] - got[0][0])
    p = 1 / (1 + np.exp(-(slope * x + z[0] - slope * got[0][0])))
    assert abs((p - y).sum()) < 1e-5 and abs(((p - y) * x).sum() + slope) < 1e-5  # the gradient is zero


def predictions(spark, rows):
    return spark.createDataFrame(rows, "profile string, fold int, row_pos long, prob_long double, label int, forward_return double, f double, regime_prob_0 double, regime_prob_1 double")


def test_forensics_pool_the_good_folds(spark):
    # fold 0 and 1 are good (the score ranks returns), fold 2 is bad (it reverses them), fold 3 is neutral
    rows, rng = [], np.random.default_rng(0)
    for fold, sign in ((0, 1), (1, 1), (2, -1)):
        for i in range(20):
            rows.append(("p", fold, len(rows), i / 20, i % 2, sign * i / 100.0, float(sign * i + fold * 5), 0.6, 0.4))
    noise = rng.permutation(40) / 40
    rows += [("p", 3, len(rows) + i, i / 40, i % 2, 0.001 * ((i * 17) % 40), float(noise[i]), 0.2, 0.8) for i in range(40)]
    df = predictions(spark, rows)
    ic = {r["fold"]: r["rank_ic"] for r in metrics.rank_ic(df, ["profile", "fold"]).collect()}
    assert ic[0] == ic[1] == pytest.approx(1) and ic[2] == pytest.approx(-1) and -0.08 < ic[3] < 0.10
    summary = reports.good_bad_summary(metrics.rank_ic(df, ["profile", "fold"])).first()
    assert (summary["good_folds"], summary["bad_folds"], summary["good_fold_count"], summary["bad_fold_count"]) == ("0,1", "2", 2, 1)
    (r,) = reports.feature_forensics(df, ["f"]).collect()
    pdf = pd.DataFrame(rows, columns=df.columns)
    good, bad = pdf[pdf.fold < 2], pdf[pdf.fold == 2]
    rho = lambda t: t["f"].rank().corr(t["forward_return"].rank())
    assert r["bad_fold"] == 2 and r["good_feature_ic"] == pytest.approx(rho(good)) and r["bad_feature_ic"] == pytest.approx(rho(bad))
    both = pd.concat([good.f, bad.f])
    assert r["abs_standardized_diff"] == pytest.approx(abs(bad.f.mean() - good.f.mean()) / both.std(ddof=0))
    assert not r["signal_reversal"]  # the feature falls where the return falls
    (w,) = reports.forensics_watchlist(reports.feature_forensics(df, ["f"]), ["feature"], 1, 0.34, 0.05, "act").collect()
    assert w["bad_folds"] == "2" and w["recommended_action"] == ("act" if abs(r["delta_ic"]) >= 0.05 else "monitor")
    assert reports.feature_forensics(df.where("fold <> 2"), ["f"]).count() == 0


def test_calibration_table_has_equal_counts(spark):
    rows = [("p", 0, i, 0.5 if i < 6 else 0.9, i % 2, 0.0, 0.0, 0.5, 0.5) for i in range(10)]
    got = metrics.calibration_table(predictions(spark, rows), ["profile"], bins=5).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2] * 5 and [r["mean_prob"] for r in got] == pytest.approx([0.5, 0.5, 0.5, 0.9, 0.9])


def test_threshold_of_one_class_is_the_median_score(spark):
    df = predictions(spark, [("ones", 0, i, p, 1, 0.0, 0.0, 0.5, 0.5) for i, p in enumerate((0.1, 0.2, 0.4, 0.9))] + [("zeros", 0, i, p, 0, 0.0, 0.0, 0.5, 0.5) for i, p in enumerate((0.1, 0.3, 0.3))] + [("both", 0, i, p, int(p > 0.5), 0.0, 0.0, 0.5, 0.5) for i, p in enumerate((0.1, 0.6, 0.9))])
    got = {r["profile"]: (r["threshold"], r["f1"]) for r in metrics.best_f1(df, ["profile"]).collect()}
    assert got["ones"] == pytest.approx((0.3, 2 / 3)) and got["zeros"] == pytest.approx((0.3, 0.0)) and got["both"] == pytest.approx((0.6, 1.0))
    con = {r["profile"]: (r["constrained"], r["reject_reason"]) for r in metrics.constrained_f1(df, ["profile"], 0.7, 0.3).collect()}
    assert con["zeros"] == (False, "no_threshold_satisfies_pred_rate_precision") and con["both"] == (True, "")


def test_stability_index_falls_back_to_equal_widths(spark):
    rows = [("p", 0, i, 0.0 if i % 10 else i / 100, int(i < 60), 0.0, 0.0, 0.5, 0.5) for i in range(120)]
    got = metrics.psi(predictions(spark, rows), ["profile"], "prob_long", F.col("label") == 1).first()["psi"]
    e, a = ([r[3] for r in rows if r[4] == y] for y in (1, 0))
    edges = [max(e) * k / 10 for k in range(1, 10)]
    share = lambda v: np.maximum(np.bincount(np.searchsorted(edges, v, side="right"), minlength=10) / len(v), 1e-6)
    assert got == pytest.approx(float(((share(a) - share(e)) * np.log(share(a) / share(e))).sum()))


def test_losses_by_hand(spark):
    rows = [("p", 0, i, p, y, r, 0.0, 0.5, 0.5) for i, (p, y, r) in enumerate([(0.8, 1, 1.0), (0.3, 0, 0.0), (0.6, 0, 0.5), (0.9, 1, 2.0)])]
    got = losses.loss_values(predictions(spark, rows), ["profile"], F.lit(0), 0.0, 1.0).first()
    z = lambda p: math.log(p / (1 - p))
    pairs = [math.log1p(math.exp(0.25 - (z(a) - z(b)))) for a in (0.8, 0.9) for b in (0.3, 0.6)]
    focal = (0.6 * 0.2**2 * -math.log(0.8) + 0.4 * 0.3**2 * -math.log(0.7) + 0.4 * 0.6**2 * -math.log(0.4) + 0.6 * 0.1**2 * -math.log(0.9)) / 4
    assert got["margin"] == pytest.approx(sum(pairs) / 4) and got["focal"] == pytest.approx(focal)
    assert got["loss"] == pytest.approx(focal + sum(pairs) / 4)


def test_leakage_is_seen(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    df = spark.createDataFrame([("ok", h(5), h(0), h(4)), ("late", h(3), h(0), h(4)), ("shifted", h(9), h(0), h(5)), ("none", h(1), None, None)], "v string, ts timestamp_ntz, s timestamp_ntz, a timestamp_ntz")
    got = {r["v"]: (r["matched"], r["available_late"], r["available_wrong"], r["passed"]) for r in reports.mtf_leakage(df, ["v"], "ts", "s", "a").collect()}
    assert got == {"ok": (1, 0, 0, True), "late": (1, 1, 0, False), "shifted": (1, 0, 1, False), "none": (0, 0, 0, True)}


def test_blends_need_all_profiles_and_weights(spark):
    rows = [(p, 0, i, 0.1 * (i + k), 0, 0.0, 0.0, 0.5, 0.5) for k, p in enumerate("abc") for i in range(4) if (p, i) != ("c", 3)]
    got = reports.blends(predictions(spark, rows), reports.all_blends(["a", "b", "c"], {"w": (2.0, 1.0, 1.0)}), ["row_pos", "fold"], ["fold"])
    n = {(r["blend"], r["method"]): r["count"] for r in got.groupBy("blend", "method").count().collect()}
    assert n[("a+b", "prob_mean")] == 4 and n[("a+b+c", "rank_mean")] == 3 and n[("w", "prob_weighted")] == 3 and len(n) == 10
    score = {(r["blend"], r["method"], r["row_pos"]): r["score"] for r in got.collect()}
    assert score[("w", "prob_weighted", 1)] == pytest.approx(0.5 * 0.1 + 0.25 * 0.2 + 0.25 * 0.3)
    assert score[("a+c", "rank_mean", 0)] == pytest.approx((1 / 4 + 1 / 3) / 2)
    with pytest.raises(ValueError, match="weights"):
        reports.blends(predictions(spark, rows), {"w": (("a", "b"), (0.0, 0.0))}, ["row_pos"], ["fold"])


def test_names_have_a_timeframe_and_family(spark):
    names = {"4h_atr_14_pct": ("4h", "volatility_structure"), "ih15_coverage": ("intrahour", "order_flow_intrahour"), "4h_fut_funding_sum": ("futures", "futures_funding_context"), "fut_oi_change": ("futures", "futures_open_interest_context"), "cvd_stable_zscore": ("1h", "order_flow_v2_stable"), "log_return_stable_rank": ("1h", "volatility_structure_stable"), "absorption_pressure_3": ("1h", "order_flow_v2_raw"), "taker_imbalance_mean_3": ("1h", "order_flow_v2_bounded"), "true_cvd_zscore": ("1h", "order_flow_tier1"), "whale_buy_flag": ("1h", "whale"), "a_x_rv14_rank": ("1h", "flow_volatility_interaction"), "hour": ("1h", "other")}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: (r["t"], r["f"]) for r in df.select("name", reports.timeframe(F.col("name")).alias("t"), reports.family(F.col("name")).alias("f")).collect()}
    assert got == names


def test_intrahour_by_hand(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("S", at(0), 100.0, 102.0, 99.0, 101.0, 10.0, 0.0, 2, 8.0, 0.0), ("S", at(15), 101.0, 103.0, 100.0, 100.0, 20.0, 0.0, 4, 5.0, 0.0), ("S", at(30), 100.0, 101.0, 98.0, 98.5, 30.0, 0.0, 5, 20.0, 0.0), ("S", at(45), 98.5, 99.0, 97.0, 98.0, 40.0, 0.0, 5, 30.0, 0.0)]
    rows += [("S", at(60), 1.0, 1.0, 1.0, 1.0, 10.0, 0.0, 2, 8.0, 0.0)]  # an hour with one bar goes
    b = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, num_trades long, taker_buy_base_vol double, taker_buy_quote_vol double")
    (r,) = ops.intrahour(b).collect()
    assert len(r) == 32  # 30 features, symbol and time
    late = math.log(98.0 / 100.0) / (4.0 / 100.0)
    assert r["price_move_norm"] == pytest.approx(math.log(0.98) / 0.06) and r["cvd_pressure_norm"] == pytest.approx(26 / 100)
    assert r["late_buy_absorption"] == pytest.approx(30 / 100 * -late) and r["late_sell_absorption"] == 0
    assert r["late_flow_price_alignment"] == pytest.approx(late) and r["late_flow_reversal"] == pytest.approx(0.30)
    assert r["vpt_last_vs_hour"] == pytest.approx(8 / (100 / 16) - 1) and r["vpt_late_vs_early"] == pytest.approx(7 / 5 - 1)
    assert r["cvd_slope_norm"] == pytest.approx(np.polyfit(range(4), np.cumsum([6, -10, 10, 20]), 1)[0] / 100)
    assert r["buy_volume_share_last"] == pytest.approx(30 / 63) and r["aggressive_buy_burst"] == pytest.approx(0.5 * 0.4) and r["aggressive_sell_burst"] == 0


def test_prices_of_zero_are_missing_not_errors(spark):
    closes = [100.0 + math.sin(i) for i in range(40)]
    closes[20] = closes[30] = 0.0
    b = made_bars(spark, closes, [max(c, 0.1) for c in closes], [0.0 if i in (5, 20, 30) else c - 0.6 for i, c in enumerate(closes)])
    p = ops.price_features(ops.flow_features(b))
    assert p.where("gk IS NULL").count() == 3 and p.where("log_return IS NULL").count() == 5
    x = labels.forward_return(labels.triple_barrier(p, "atr_14"))
    assert x.count() > 0 and adx(p).count() == 40 and ops.orderflow_features(p).count() == 40 and ops.stationary_features(p).count() == 40
    one_side = predictions(spark, [("p", 0, i, i / 4, 1, 0.0, 0.0, 0.5, 0.5) for i in range(4)])
    assert metrics.ks(one_side, ["profile"], "prob_long", F.col("label") == 1).first()["ks"] is None
    assert metrics.psi(one_side, ["profile"], "prob_long", F.col("label") == 1).count() == 1


@pytest.mark.parametrize("n", [0, 229, 230, 290, 605, 1000])
def test_rows_are_in_every_fold_that_has_them(spark, n):
    f = labels.Folds(120, 40, 40, 60)
    rows = spark.range(n).select(F.lit("S").alias("symbol"), F.col("id").cast("int").alias("pos"))
    folds = max(0, (n - 230) // 60 + 1)
    want = {(p, k, role) for k in range(folds) for role, lo, hi in f.ranges() for p in range(60 * k + lo, 60 * k + hi)}
    got = [(r["pos"], r["fold"], r["role"]) for r in labels.with_folds(rows, f).collect()]
    assert len(got) == len(want) and set(got) == want
    assert labels.walk_forward(rows, f).count() == 3 * folds



def test_importance_of_a_useless_column_is_zero(spark):
    rows = [("p", i % 2, i, float(i % 17), float((i * 7) % 13), float(i % 17)) for i in range(200)]
    df = spark.createDataFrame(rows, "profile string, fold int, row_pos long, a double, b double, forward_return double")
    r = {x["feature"]: x["mean_drop"] for x in scoring.permutation_importance(df, lambda d: d["a"] + 0 * d["b"], ["a", "b"], ["profile", "fold"]).collect()}
    assert r["a"] > 0.5 and abs(r["b"]) < 1e-9


def test_profiles_and_decisions():
    profiles = {"base": {"include": ["*"], "exclude": ["raw_*"], "overrides": {"a": {"x": 1}}}, "child": {"inherits": "base", "append_exclude": ["4h_*"], "overrides": {"a": {"y": 2}}}, "own": {"inherits": "base", "exclude": ["z*"]}, "loop": {"inherits": "loop"}}
    child = g.resolved_profile("child", profiles)
    assert child["overrides"] == {"a": {"x": 1, "y": 2}}
    assert g.profile_columns(["a", "raw_b", "4h_c"], child) == ["a"]
    assert g.resolved_profile("own", profiles)["exclude"] == ["z*"]
    for bad in ("loop", "none"):
        with pytest.raises(ValueError):
            g.resolved_profile(bad, profiles)
    with pytest.raises(ValueError):
        g.profile_columns(["raw_a"], child)
    assert g.signature({"a": 1, "b": float("nan")}) == g.signature({"b": float("nan"), "a": 1})
    assert g.holdout_start(100, 10, 50, True)["start"] == 50 and g.holdout_start(100, 10, 50)["start"] == 90
    good = {"mean_ic": 0.05, "std_ic": 0.01, "positive_fraction": 0.9}
    assert g.decision(good, good | {"mean_ic": 0.04}, {"rank_ic": 0.01, "lift": 1.1})["promote"]
    assert g.decision(good, good, None)["reject_reason"] == "mean_ic;no_holdout"


def test_names_and_settings_are_guarded(spark):
    names = ["cvd_pressure_12", "4h_cvd_pressure_12_minus_6", "cvd_pressure_stable_rank", "atr_14"]
    assert g.without_raw_flow(names, True) == ["cvd_pressure_stable_rank", "atr_14"] and g.without_raw_flow(names, False) == names
    assert g.availability_columns(["a", "b"], ["b"], "atr", ["a", "b", "atr", "c"]) == ["a", "b", "atr"]
    assert g.renamed(["x_1", "y"], {r"x_(\d)": r"z\1"}) == {"x_1": "z1", "y": "y"}
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert validation.in_order(df, ["b", "a"]).columns == ["b", "a"] and validation.no_missing(df, ["a"]) is df
    for bad in (lambda: g.availability_columns(["a"], [], "atr", ["a"]), lambda: g.renamed(["x_1", "x_2"], {r"x_\d": "z"}), lambda: validation.in_order(df, ["c"]), lambda: validation.no_missing(df, ["a", "b"]), lambda: validation.checked_settings({"windows": {"n": 1}}), lambda: validation.checked_settings({"tanh_scale": 0}), lambda: validation.checked_settings({"interactions": [("a",)]})):
        with pytest.raises(ValueError):
            bad()
    assert validation.checked_settings({"windows": {"n": 24}, "interactions": [("a", "b")]})


def test_correlation_of_too_few_rows_may_be_missing(spark):
    df = predictions(spark, [("p", 0, i, i / 4, 1, float(i), 0.0, 0.5, 0.5) for i in range(3)])
    ic = lambda **k: metrics.rank_ic(df, ["profile"], **k).first()["rank_ic"]
    assert ic() == pytest.approx(1) and ic(least=4) == 0 and ic(least=4, undefined=None) is None


def test_reports_are_written(spark, tmp_path):
    t = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, value double").orderBy("name")
    g.write_report(t, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r/csv")).count() == 2
    assert g.markdown(t).splitlines()[2] == "| a | 0.5000 |"
    assert "| a | 0.5000 |" in spark.read.text(str(tmp_path / "r/md")).toPandas()["value"].tolist()
    schema = "name string, value double"
    assert sorted(r["name"] for r in g.read_report(spark, str(tmp_path / "r"), schema).collect()) == ["a", "b"]
    assert g.read_report(spark, str(tmp_path / "none"), schema).count() == 0
    p = spark.createDataFrame([("p", 0, 0.1), ("p", 1, 0.2), ("q", 0, 0.3)], "profile string, fold int, prob_long double")
    g.write_predictions(p, str(tmp_path / "preds"))
    g.write_predictions(p.where("profile = 'p' AND fold = 1").withColumn("prob_long", F.lit(0.9)), str(tmp_path / "preds"))
    assert sorted(r["prob_long"] for r in spark.read.parquet(str(tmp_path / "preds")).collect()) == [0.1, 0.3, 0.9]
    folds = spark.createDataFrame([(i, i / 10) for i in range(9)], "fold int, rank_ic double")
    text = g.summary_markdown({"mean_ic": 0.4, "std": float("nan")}, folds)
    assert "- std: None" in text and text.count("| 8 |") == 1 and text.count("| 4 |") == 2


def test_stream_closes_the_batch_bars(spark):
    got = {(r["symbol"], r["ts"]): (r["open"], r["close"], r["num_trades"]) for r in bars_once(spark, SF, 8).collect()}
    want = {(r["symbol"], r["ts"]): (r["open"], r["close"], r["num_trades"]) for r in bars(spark, SF).collect()}
    assert got == want


def test_sessions_end_at_a_gap(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    ticks = spark.createDataFrame([("S", at(m), 100.0 + m, 1) for m in (0, 10, 39, 80, 100)], "symbol string, ts timestamp, price double, size int")
    got = session_bars(ticks).orderBy("start").collect()
    assert [(r["num_trades"], r["low"], r["high"]) for r in got] == [(3, 100.0, 139.0), (2, 180.0, 200.0)]


def test_stream_filter_continues_its_state(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 1)).cumsum(axis=0)
    h = regime.fit(x, 2)
    for part, rows in (("0", range(20)), ("1", range(20, 40))):
        spark.createDataFrame([("S", T0 + dt.timedelta(hours=i), float(x[i, 0])) for i in rows], "symbol string, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in" / part))
    s = spark.readStream.schema("symbol string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = stream_filter(s, h, ["v"]).writeStream.format("memory").queryName("t_filter").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    p = np.array([[r["regime_prob_0"], r["regime_prob_1"]] for r in spark.table("t_filter").orderBy("ts").collect()])
    np.testing.assert_allclose(p, regime.forward_filter(h, x), atol=1e-6)
