"""Gates, policies, drift and stability: cases worked out by hand, and brute force where tables are larger."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import drift, policies, reports, review, rules

BANDS = [("top_10", 9, 9), ("upper_half", 5, 9)]
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def preds(spark):
    """Three folds: scores that tell labels apart, ones that don't, and ones that tell them the wrong way round."""
    rng = np.random.default_rng(0)
    rows = []
    for profile in ("control", "other"):
        for fold, sign in enumerate((1.0, 0.0, -1.0)):
            for split in ("val", "test"):
                for i in range(160):
                    up = rng.random() < 0.4
                    score = float(np.clip(0.5 + sign * (0.2 if up else -0.2) + rng.normal(0, 0.15), 0, 1))
                    regime = rng.dirichlet([1, 1, 1])
                    rows.append((profile, fold, split, i, START + dt.timedelta(hours=fold * 400 + i), score, int(up), float((0.01 if up else -0.01) + rng.normal(0, 0.005)), *map(float, regime), float(score + rng.normal()), float(rng.normal() + (2 if fold == 2 else 0))))
    return spark.createDataFrame(rows, "profile string, fold int, split string, row_pos long, ts timestamp_ntz, prob_long double, label int, forward_return double, regime_prob_0 double, regime_prob_1 double, regime_prob_2 double, cvd_pressure_6 double, `4h_funding_z` double").cache()


def row(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if v is None or isinstance(v, float) else 'string' if isinstance(v, str) else 'boolean'}" for k, v in values.items()))


def test_rules_tell_reasons_in_order_and_once(spark):
    own = [rules.Rule("b", "x", ">=", 2.0), rules.Rule("a", "y", "<", 1.0), rules.Rule("b", "y", "<", 0.0), rules.Rule("c", "z", ">", 0.0), rules.Rule("d", "z", ">", 0.0, missing_meets=True)]
    df = row(spark, x=1.0, y=2.0, z=None)
    assert df.select(rules.reasons(own).alias("r")).first()[0] == "b;a;c"
    assert row(spark, x=2.0 - 1e-13, y=-1.0, z=1.0).select(rules.reasons(own).alias("r")).first()[0] == ""
    with pytest.raises(ValueError, match="no rule"):
        rules.rebound(own, q=1.0)


def profile(name, **over):
    base = dict(profile=name, passed=False, mean_rank_ic=0.02, std_rank_ic=0.05, positive_ic_fraction=0.6, top_10_lift=1.1, worst_rank_ic=-0.05, guarded_pred_rate=0.5)
    return base | over


def test_triage_and_full_gates(spark):
    summary = spark.createDataFrame(pd.DataFrame([
        profile("control"),
        profile("better", mean_rank_ic=0.026, top_10_lift=1.2, positive_ic_fraction=0.8, std_rank_ic=0.049),
        profile("same"),
        profile("wild", mean_rank_ic=0.03, std_rank_ic=0.056, guarded_pred_rate=0.9),
        profile("first", passed=True, mean_rank_ic=0.0),
        profile("best", mean_rank_ic=0.04, std_rank_ic=0.054, positive_ic_fraction=0.6),
    ]))
    lifts = {"control": [1.2, 0.9], "better": [1.2, 1.3], "same": [1.2, 0.8], "wild": [1.1, 1.1], "first": [2.0, 2.0], "best": [1.2, 1.1]}
    bands = spark.createDataFrame([(p, i, x) for p, v in lifts.items() for i, x in enumerate(v)], "profile string, fold int, lift double")
    got = {r["profile"]: r for r in policies.gated(summary, bands, "control", F.lit(True), F.col("profile") != "wild", most=1).collect()}
    assert "control" not in got
    triage = {k: r["triage_reject_reason"] for k, r in got.items()}
    assert triage == {"better": "", "same": "mean_rank_ic_delta;top_10_positive_lift_fold_rate", "wild": "std_rank_ic;stationarity_policy", "first": "mean_rank_ic_delta", "best": ""}
    full = {k: r["full_reject_reason"] for k, r in got.items()}
    assert full["better"] == "" and full["first"] == ""
    assert full["wild"] == "positive_ic_fraction;std_rank_ic;official_pred_long_rate;top_10_lift_global_delta;stationarity_policy"
    assert full["best"] == "positive_ic_fraction;std_rank_ic;top_10_lift_global_delta"
    assert {k for k, r in got.items() if r["auto_full"]} == {"best"}


def threshold(part, cap, least):
    """The best F1 under the bounds over all scores of the rows; by precision, lower rate, higher threshold."""
    best = None
    for t in sorted(set(part.prob_long)):
        hit = part.prob_long >= t
        tp = int((part.label[hit] == 1).sum())
        precision, recall, rate = tp / hit.sum(), tp / (part.label == 1).sum(), hit.mean()
        f1 = 2 * precision * recall / (precision + recall) if tp else 0.0
        if rate <= cap and precision >= least:
            best = max(best or (), (round(f1, 12), round(precision, 12), -rate, t))
    return best


def test_threshold_grid_is_chosen_on_val_and_measured_on_test(spark, preds):
    got = {(r["profile"], r["fold"], r["cap"]): r for r in policies.threshold_grid(preds, (0.2, 0.6), 0.45).collect()}
    pdf = preds.toPandas()
    seen = set()
    for (p, f), part in pdf.groupby(["profile", "fold"]):
        val, test = part[part.split == "val"], part[part.split == "test"]
        for cap in (0.2, 0.6):
            r, best = got[p, f, cap], threshold(val, cap, 0.45)
            seen.add(r["constraints_satisfied"])
            assert r["constraints_satisfied"] == (best is not None) and r["threshold_source"] == "val"
            if best:
                assert r["threshold"] == best[3] and r["source_f1"] == pytest.approx(best[0])
            hit = test[test.prob_long >= r["threshold"]]
            assert r["selected_count"] == len(hit) and r["test_pred_rate"] == pytest.approx(len(hit) / len(test))
            if len(hit):
                assert r["lift_vs_base"] == pytest.approx(hit.label.mean() / test.label.mean()) and r["mean_forward_return"] == pytest.approx(hit.forward_return.mean())
    assert seen == {True, False}
    alone = policies.threshold_grid(preds.where("split = 'test'"), (0.6,), 0.45)
    assert {r["threshold_source"] for r in alone.collect()} == {"same_split_oracle"} and alone.count() == 6
    s = {(r["profile"], r["cap"]): r for r in policies.threshold_grid_summary(policies.threshold_grid(preds, (0.2, 0.6), 0.45)).collect()}
    own = [r for k, r in got.items() if k[0] == "control" and k[2] == 0.6]
    assert s["control", 0.6]["folds"] == 3 and s["control", 0.6]["positive_lift_fold_rate"] == pytest.approx(sum((r["lift_vs_base"] or 0) > 1 for r in own) / 3)


def test_policies_are_ranked_by_their_returns_first(spark):
    grid = [
        ("p", "score_band", "a", 3, None, 0.1, 0.5, 0.1, 0.2, 1.5, 0.6, 0.010, 0.6),
        ("p", "score_band", "b", 3, None, 0.1, 0.5, 0.1, 0.2, 1.9, 0.6, 0.020, 0.5),
        ("p", "threshold_cap", "c", 3, 0.5, 0.9, 0.2, 0.1, 0.2, 1.0, 0.5, -0.01, 0.1),
        ("p", "threshold_cap", "d", 3, 0.5, 0.3, 0.5, 0.1, 0.2, 1.5, 0.6, 0.010, 0.6),
        ("p", "threshold_cap", "e", 3, 0.5, 0.3, None, 0.1, 0.2, None, None, None, None),
    ]
    df = spark.createDataFrame(grid, "profile string, policy_type string, policy_name string, folds int, threshold_mean double, " + ", ".join(f"{c} double" for c in policies.POLICY_COLUMNS))
    got = {r["policy_name"]: r for r in policies.select_policy(df).collect()}
    assert {k: r["reject_reason"] for k, r in got.items()} == {"a": "", "b": "positive_forward_return_fold_rate", "c": "selection_rate;precision;lift_vs_base;mean_forward_return;positive_lift_fold_rate;positive_forward_return_fold_rate", "d": "", "e": "precision;lift_vs_base;mean_forward_return"}
    assert [k for k, r in sorted(got.items(), key=lambda x: x[1]["policy_rank"])] == ["a", "d", "b", "c", "e"]
    assert [k for k, r in got.items() if r["selected"]] == ["a"]


def test_policy_grid_has_bands_and_caps(preds):
    g = policies.policy_grid(preds, BANDS, (0.3, 0.5), 0.3)
    assert sorted(r["policy_name"] for r in g.where("profile = 'other'").collect()) == ["threshold_cap_0.30", "threshold_cap_0.50", "top_10", "upper_half"]
    r = g.where("profile = 'other' AND policy_name = 'upper_half'").first()
    assert r["folds"] == 3 and r["selection_rate"] == pytest.approx(0.5, abs=0.01)


def test_fold_stability_names_the_first_trouble(spark):
    ic = [-0.2, -0.01, 0.02, 0.3, 0.05, 0.06, 0.07, 0.08]
    f1 = [0.5, 0.5, 0.5, 0.5, 0.4, 0.5, 0.5, 0.5]
    rate = [0.5, 0.5, 0.5, 0.5, 0.5, 0.8, 0.5, 0.5]
    ret = [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0]
    table = lambda cols, *v: spark.createDataFrame([("p", i, *map(float, x)) for i, x in enumerate(zip(*v))], f"profile string, fold int, {cols}")
    got = {r["fold"]: r for r in policies.fold_stability(table("rank_ic double", ic), table("test_f1_constrained double, test_pred_rate_constrained double", f1, rate), table("lift double, mean_return double", ret, ret)).collect()}
    assert [got[i]["issue"] for i in range(8)] == ["bad_rank_ic", "negative_rank_ic", "below_target_rank_ic", "variance_driver_high_side", "official_threshold_f1", "official_threshold_pred_long_rate", "top_10_payoff", "ok"]
    assert [got[i]["track"] for i in range(4, 8)] == ["threshold_calibration", "threshold_calibration", "score_band_policy", "monitor"]
    assert got[4]["bucket"] == got[7]["bucket"] == "rank_ic_ok" and got[3]["bucket"] == "variance_driver_high_side"
    sd = np.std(ic, ddof=1)
    assert got[0]["zscore"] == pytest.approx((ic[0] - np.mean(ic)) / sd) and got[0]["driver_rank"] == 2 and got[3]["driver_rank"] == 1
    assert sum(r["variance_share"] for r in got.values()) == pytest.approx(1)


def brute_choice(part, most=0.7, least=0.3):
    x, y = part.prob_long, part.label
    found = []
    for t in sorted({*x, *(x.quantile(q) for q in (0.5, 0.6, 0.7, 0.8, 0.9)), 0.5, x.max() + 1e-9, x.min() - 1e-9}):
        hit = x >= t
        tp = int(y[hit].sum())
        precision, recall, rate = (tp / hit.sum() if hit.sum() else 0.0), tp / y.sum(), hit.mean()
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        kind = 2 if rate <= most and precision >= least else 1 if rate <= most else 0
        found.append((-kind, -round(f1, 12), -round(precision, 12), round(rate, 12), t))
    return min(found)[4]


def test_regime_thresholds_with_counts_and_fallback(spark, preds):
    official = review.threshold_diagnostics(preds, 0.7, 0.3)
    got = {(r["profile"], r["fold"]): r for r in policies.regime_thresholds(preds, 3, official, least_val=50, least_test=40, least_longs=5).collect()}
    fallback = {(r["profile"], r["fold"]): r["constrained_threshold"] for r in official.collect()}
    pdf = preds.toPandas()
    pdf["regime"] = pdf[[f"regime_prob_{i}" for i in range(3)]].to_numpy().argmax(axis=1)
    used = 0
    for key, part in pdf.groupby(["profile", "fold"]):
        val, test = part[part.split == "val"], part[part.split == "test"]
        own = {g: brute_choice(v) for g, v in val.groupby("regime") if len(v) >= 50 and (test.regime == g).sum() >= 40 and v.label.sum() >= 5}
        used += len(own)
        hit = test.prob_long >= test.regime.map(own).fillna(fallback[key])
        tp = int(test.label[hit].sum())
        r = got[key]
        assert r["regime_threshold_count"] == len(own) and r["regime_count"] == 3 and r["fallback_threshold"] == fallback[key]
        assert r["test_pred_rate"] == pytest.approx(hit.mean()) and r["test_recall"] == pytest.approx(tp / test.label.sum())
        if hit.any():
            assert r["test_mean_return"] == pytest.approx(test.forward_return[hit].mean())
    assert 0 < used < 18
    s = policies.regime_threshold_summary(policies.regime_thresholds(preds, 3, official, least_val=50)).collect()
    assert len(s) == 2 and all(r["fold_count"] == 3 and r["next_action"] == "diagnostic_only_do_not_promote" for r in s)


def test_reliability_gates_see_val_rows_alone(preds):
    official, top = review.threshold_diagnostics(preds, 0.7, 0.3), reports.score_bands(preds.where("split = 'test'"), ["profile", "fold"], BANDS).where("band = 'top_10'")
    d = policies.reliability_gates(preds, official, top)
    ok = {(r["fold"], r["gate"]): r["gate_passed"] for r in d.where("profile = 'control'").collect()}
    assert len(ok) == 12 and all(ok[0, g] for g in rules.RELIABILITY) and not any(ok[2, g] for g in rules.RELIABILITY)
    swapped = preds.withColumn("prob_long", F.when(F.col("split") == "test", 1 - F.col("prob_long")).otherwise(F.col("prob_long")))
    again = {(r["fold"], r["gate"]): r["gate_passed"] for r in policies.reliability_gates(swapped, official, top).where("profile = 'control'").collect()}
    assert again == ok
    s = {r["gate"]: r for r in policies.reliability_summary(d).where("profile = 'control'").collect()}
    g = s["val_rank_ic_score_gap_and_ks"]
    assert g["rejected_negative_capture_rate"] == 1.0 and g["accepted_mean_delta"] > 0 and "accepted_fold_count" in g["reject_reason"]


def test_policies_of_earlier_folds_skip_the_first(preds):
    t = policies.transferred(preds, 0.7, 0.3)
    rows = {(r["fold"], r["policy"]): r for r in t.where("profile = 'control'").collect()}
    assert {p for f, p in rows if f == 0} == {"own_validation"} and {p for f, p in rows if f == 1} == {"own_validation", "last_fold", "prior_mean", "prior_median", "prior_ewm"}
    own = {f: rows[f, "own_validation"]["threshold"] for f in range(3)}
    assert rows[2, "last_fold"]["threshold"] == own[1] and rows[2, "prior_mean"]["threshold"] == pytest.approx((own[0] + own[1]) / 2)
    assert rows[2, "prior_ewm"]["threshold"] == pytest.approx(0.65 * own[0] + 0.35 * own[1])
    test = preds.where("profile = 'control' AND fold = 2 AND split = 'test'").toPandas()
    assert rows[2, "last_fold"]["pred_rate"] == pytest.approx((test.prob_long >= own[1]).mean()) and rows[2, "own_validation"]["f1_delta"] == 0


def test_out_of_sample_monitor_counts_bars_since_an_anchor(spark):
    df = spark.createDataFrame([("a", START + dt.timedelta(hours=h, minutes=59)) for h in (0, 9, 30)] + [("b", START - dt.timedelta(days=3))], "profile string, ts timestamp_ntz")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    got = {r["profile"]: r.asDict() for r in policies.oos_monitor(df, at, 24, 100, status="candidate FAILED").collect()}
    assert got["a"]["new_bars"] == 30 and got["a"]["ready"] and not got["a"]["preferred_ready"] and got["a"]["preferred_bars_remaining"] == 70 and got["a"]["next_action"] == "future_oos_window_available"
    assert got["b"]["new_bars"] == 0 and got["b"]["next_action"] == "wait_for_new_unseen_bars" and got["b"]["roll_forward_locked"]
    off = policies.oos_monitor(df, at, 0, 0, enabled=False).first()
    assert off["next_action"] == "monitor_disabled" and not off["ready"] and not off["roll_forward_locked"]


def test_feature_families_of_the_drift_table(spark):
    want = {"ih15_flow": "ih15_intrahour_order_flow", "4h_ih15_flow": "ih15_intrahour_order_flow", "fut_oi": "futures_context", "4h_funding_z": "futures_context", "signed_ltp_3": "large_trade_pressure", "x_ltp": "other", "ltp": "large_trade_pressure", "4h_cvd_pressure_6": "4h_cvd_pressure", "taker_imbalance": "order_flow", "whale_buy": "whale_ticket_size", "large_trade_ratio": "whale_ticket_size", "volume_log": "volume_context", "4h_log_return": "4h_volatility_structure", "4h_x": "4h_other"}
    df = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r[0]: r[1] for r in df.select("name", drift.drift_family(F.col("name"))).collect()} == want


def test_feature_drift_of_bad_against_good_rows(spark, preds):
    got = {r["feature"]: r for r in drift.feature_drift(preds.where("split = 'test' AND profile = 'control'"), ["cvd_pressure_6", "4h_funding_z"]).collect()}
    r = got["4h_funding_z"]
    assert r["bad_definition"] == "negative_rank_ic" and r["drift_flag"] and r["family"] == "futures_context" and "2" in r["bad_fold_ids"].split(",") and "0" in r["good_fold_ids"].split(",")
    pdf = preds.where("split = 'test' AND profile = 'control'").toPandas()
    bad, good = (pdf[pdf.fold.isin([int(f) for f in r[f"{k}_fold_ids"].split(",")])] for k in ("bad", "good"))
    a, b = bad["4h_funding_z"], good["4h_funding_z"]
    effect = (a.mean() - b.mean()) / np.sqrt((a.std(ddof=0) ** 2 + b.std(ddof=0) ** 2) / 2)
    gap = lambda x: x[x.label == 1]["4h_funding_z"].mean() - x[x.label == 0]["4h_funding_z"].mean()
    ic = lambda x: x["4h_funding_z"].rank().corr(x.forward_return.rank())
    assert r["drift_effect"] == pytest.approx(effect) and r["bad_gap"] == pytest.approx(gap(bad)) and r["good_ic"] == pytest.approx(ic(good))
    d = abs(ic(bad) - ic(good))
    assert r["suspect_score"] == pytest.approx(min(abs(effect), 3) + min(d, 2) + 0.5 * min(abs(gap(bad) - gap(good)), 2) + r["ic_reversal"] + 0.75 * r["gap_reversal"] + 0.5 * r["drift_flag"])


def test_score_shift_leaves_each_fold_out(spark):
    """Against the others row by row; one fold alone is good, so that it is compared with all others."""
    rng = np.random.default_rng(3)
    rows = []
    for f, (mean, sign) in enumerate(((0.5, 1), (0.5, -1), (0.8, -1), (0.4, 0))):
        for i in range(90 + f):
            x = float(np.round(np.clip(rng.normal(mean, 0.15), 0, 1), 2))
            rows.append(("p", f, x, float(sign * x + rng.normal(0, 0.05))))
    df = spark.createDataFrame(rows, "profile string, fold int, prob_long double, forward_return double")
    got = {r["fold"]: r for r in drift.score_shift(df, 0.3).collect()}
    pdf = df.toPandas()
    ics = {f: x.prob_long.rank().corr(x.forward_return.rank()) for f, x in pdf.groupby("fold")}
    assert [f for f, v in ics.items() if v >= 0.3] == [0]
    for f in range(4):
        own = pdf[pdf.fold == f].prob_long.to_numpy()
        others = [g for g in ics if g != f and ics[g] >= 0.3] or [g for g in ics if g != f]
        ref = pdf[pdf.fold.isin(others)].prob_long.to_numpy()
        r = got[f]
        assert r["ref_folds"] == len(others) and r["reference"] == ("all_other_folds" if f == 0 else "other_folds_rank_ic_ge_0.300")
        grid = np.unique(np.concatenate([own, ref]))
        cdf = lambda v: np.searchsorted(np.sort(v), grid, side="right") / len(v)
        assert r["ks"] == pytest.approx(np.abs(cdf(own) - cdf(ref)).max())
        edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
        edges[0], edges[-1] = -np.inf, np.inf
        a, e = (np.maximum(np.histogram(v, edges)[0] / len(v), 1e-6) for v in (own, ref))
        assert r["psi"] == pytest.approx(float(((a - e) * np.log(a / e)).sum()))
        iqr = lambda v: np.quantile(v, 0.75) - np.quantile(v, 0.25)
        assert (r["iqr"], r["ref_iqr"]) == pytest.approx((iqr(own), iqr(ref))) and r["std_ratio"] == pytest.approx(own.std() / ref.std())
    assert got[2]["issue"] == "major_score_distribution_shift"
    s = drift.score_shift_summary(drift.score_shift(df, 0.3), 0.3).first()
    assert s["fold_count"] == 4 and s["bad_fold_count"] == 3 and "2" in s["high_shift_fold_ids"]
