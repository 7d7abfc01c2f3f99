"""Threshold grids, score policies, regime thresholds, promotion and reliability gates, fold stability.

Everything is chosen on validation rows and measured on test rows. Rows are passed once, into score steps
(`metrics.score_steps`) and score bands; what follows has a row a fold or a profile. Gates are rules (`rules`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import flag
from barloom.operators import metrics as m
from barloom.operators import reports, rules
from barloom.sources.shared import written

KEYS = ["profile", "fold"]
CAPS = (0.30, 0.40, 0.50, 0.60, 0.70)


def above(x: Column, bound: float) -> Column:
    """1.0 or 0.0: x above the bound, but for rounding; a missing value is not."""
    return flag(F.round(x, 12) > bound)


def steps_of(preds: DataFrame) -> DataFrame:
    """Score steps with returns by profile, fold and split, as a table."""
    return written(m.score_steps(preds, [*KEYS, "split"], returns="forward_return"), "policy-steps")


def threshold_grid(preds: DataFrame, caps: tuple[float, ...] = CAPS, least_precision: float = 0.30) -> DataFrame:
    """Per profile, fold and cap of the prediction rate: the constrained threshold of the val rows (of the test rows
    where a fold has none) with its figures there and on the test rows."""
    steps = steps_of(preds)
    sides = steps.groupBy(*KEYS).agg(F.max(flag(F.col("split") == "val")).alias("has_val"), F.max(flag(F.col("split") == "test")).alias("has_test"))
    sided = steps.join(sides, KEYS).where("has_test = 1")
    each = sided.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps])))
    source = each.where((F.col("split") == "val") | ((F.col("has_val") == 0) & (F.col("split") == "test")))
    by = [*KEYS, "cap"]
    chosen = written(m.constrained_of(source, by, F.col("cap"), least_precision).join(sides, KEYS), "grid-thresholds")
    own = m.at_steps(source, chosen, by, {"s": "threshold"}).select(*by, *[F.col(f"{c}_s").alias(f"source_{c}") for c in ("f1", "precision", "recall", "pred_rate")])
    at = m.at_steps(each.where("split = 'test'"), chosen, by, {"t": "threshold"})
    rate = F.try_divide(F.col("tp_t"), F.col("n_t"))
    at = at.select(*by, "base_rate", *[F.col(f"{c}_t").alias(f"test_{c}") for c in ("f1", "precision", "recall", "pred_rate")], F.col("n_t").alias("selected_count"), rate.alias("selected_long_rate"), F.try_divide(rate, F.col("base_rate")).alias("lift_vs_base"), F.col("mean_return_t").alias("mean_forward_return"))
    named = chosen.select(*by, "threshold", F.col("constrained").alias("constraints_satisfied"), "reject_reason", F.when(F.col("has_val") == 1, "val").otherwise("same_split_oracle").alias("threshold_source"))
    return named.join(own, by).join(at, by)


def threshold_grid_summary(grid: DataFrame) -> DataFrame:
    """One row a profile and cap: means over folds."""
    return grid.groupBy("profile", "cap").agg(
        F.countDistinct("fold").alias("folds"),
        F.avg("threshold").alias("threshold_mean"),
        F.avg(flag(F.col("constraints_satisfied"))).alias("constraints_satisfied_fold_rate"),
        *[F.avg(f"source_{c}").alias(f"mean_source_{c}") for c in ("f1", "precision", "recall", "pred_rate")],
        *[F.avg(f"test_{c}").alias(f"mean_{c}") for c in ("f1", "precision", "recall")],
        F.avg("test_pred_rate").alias("mean_selection_rate"),
        F.avg("lift_vs_base").alias("mean_lift_vs_base"),
        F.avg(above(F.col("lift_vs_base"), 1.0)).alias("positive_lift_fold_rate"),
        F.avg("mean_forward_return").alias("mean_forward_return"),
        F.avg(above(F.col("mean_forward_return"), 0.0)).alias("positive_forward_return_fold_rate"),
    )


def band_summary(bands: DataFrame) -> DataFrame:
    """One row a profile and band, from its folds' rows."""
    return bands.groupBy("profile", "band").agg(
        F.countDistinct("fold").alias("folds"),
        F.avg("selection_rate").alias("mean_selection_rate"),
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
        F.avg("f1").alias("mean_f1"),
        F.avg("lift").alias("mean_lift_vs_base"),
        F.percentile("lift", 0.5).alias("median_lift_vs_base"),
        F.avg(above(F.col("lift"), 1.0)).alias("positive_lift_fold_rate"),
        F.avg("mean_return").alias("mean_forward_return"),
        F.avg(above(F.col("mean_return"), 0.0)).alias("positive_forward_return_fold_rate"),
    )


POLICY_COLUMNS = ["selection_rate", "precision", "recall", "f1", "lift_vs_base", "positive_lift_fold_rate", "mean_forward_return", "positive_forward_return_fold_rate"]


def policy_grid(preds: DataFrame, bands: list[tuple[str, int, int]], caps: tuple[float, ...] = CAPS, least_precision: float = 0.30) -> DataFrame:
    """Every band and every capped threshold of a profile as a policy. A band's rates are those of all test rows
    together, its fold rates and its return those over folds; a threshold's are means over folds."""
    test = preds.where("split = 'test'")
    folds = band_summary(reports.score_bands(test, KEYS, bands)).select("profile", "band", "folds", "positive_lift_fold_rate", "mean_forward_return", "positive_forward_return_fold_rate")
    whole = reports.score_bands(test, ["profile"], bands).select("profile", "band", "selection_rate", "precision", "recall", "f1", F.col("lift").alias("lift_vs_base"))
    by_band = folds.join(whole, ["profile", "band"]).select("profile", F.lit("score_band").alias("policy_type"), F.col("band").alias("policy_name"), "folds", F.lit(None).cast("double").alias("threshold_mean"), *POLICY_COLUMNS)
    caps_ = threshold_grid_summary(threshold_grid(preds, caps, least_precision))
    means = {"selection_rate": "mean_selection_rate", "precision": "mean_precision", "recall": "mean_recall", "f1": "mean_f1", "lift_vs_base": "mean_lift_vs_base"}
    by_cap = caps_.select("profile", F.lit("threshold_cap").alias("policy_type"), F.concat(F.lit("threshold_cap_"), F.format_string("%.2f", "cap")).alias("policy_name"), "folds", "threshold_mean", *[F.col(means.get(c, c)).alias(c) for c in POLICY_COLUMNS])
    return by_band.unionByName(by_cap)


def select_policy(grid: DataFrame, gates: tuple[rules.Rule, ...] = rules.POLICY) -> DataFrame:
    """The grid with the reasons against each policy, and its place; the first of a profile is the selected one."""
    g = grid.withColumn("reject_reason", rules.reasons(gates)).withColumn("policy_pass", F.col("reject_reason") == "")
    falling = ["mean_forward_return", "positive_forward_return_fold_rate", "lift_vs_base", "f1"]
    order = [F.desc("policy_pass"), *[F.desc_nulls_last(F.round(c, 9)) for c in falling], F.asc_nulls_last(F.round("selection_rate", 9)), F.asc("policy_type"), F.asc("policy_name")]
    place = F.row_number().over(Window.partitionBy("profile").orderBy(*order))  # a row a policy
    return g.withColumn("policy_rank", place).withColumn("selected", F.col("policy_rank") == 1)


def gated(summary: DataFrame, top_bands: DataFrame, control: str, leakage_passed: Column, stationarity_passed: Column, triage=rules.TRIAGE, full=rules.FULL, most: int | None = None) -> DataFrame:
    """Every profile but the control with the reasons of the triage and of the full gates, and whether it goes on to a
    full run: those that triage passes, the best by correlation, lift, worst folds and lift fold rate first, `most` at most.

    summary: `review.summary`; top_bands: the folds' top band (profile, fold, lift)."""
    rate = top_bands.groupBy("profile").agg(F.avg(above(F.col("lift"), 1.0)).alias("top_10_positive_lift_fold_rate"))
    s = summary.join(rate, "profile", "left").withColumns({"mtf_leakage_passed": flag(leakage_passed), "stationarity_policy_passed": flag(stationarity_passed)})
    needed = sorted({r.metric for r in (*triage, *full) if r.against})
    s = rules.beside_control(s, control, needed).where(F.col("profile") != control)
    s = s.withColumns({"triage_reject_reason": rules.reasons(triage), "full_reject_reason": F.when(F.col("passed"), "").otherwise(rules.reasons(full))})
    goes = F.col("triage_reject_reason") == ""
    order = [F.desc_nulls_last(F.round(c, 9)) for c in ("mean_rank_ic", "top_10_lift", "worst_rank_ic", "top_10_positive_lift_fold_rate")]
    place = F.row_number().over(Window.partitionBy(goes).orderBy(*order, "profile"))  # a row a profile
    return s.withColumn("auto_full", goes & (place <= (most if most is not None else 1 << 30)))


def fold_stability(ic: DataFrame, thresholds: DataFrame, top_bands: DataFrame, target: float = 0.03, bad: float = -0.08, least_f1: float = 0.45, most_rate: float = 0.70) -> DataFrame:
    """Every fold's share in the spread of a profile's correlations and its first trouble, with the track that is to
    look at it. thresholds: `review.threshold_diagnostics`; top_bands: profile, fold, lift, mean_return."""
    whole = Window.partitionBy("profile")  # a row a fold
    x = F.col("rank_ic")
    own = thresholds.select(*KEYS, F.col("test_f1_constrained").alias("official_f1"), F.col("test_pred_rate_constrained").alias("official_rate"))
    top = top_bands.select(*KEYS, F.col("lift").alias("top_10_lift"), F.col("mean_return").alias("top_10_return"))
    v = ic.join(own, KEYS, "left").join(top, KEYS, "left")
    v = v.withColumns({"rank_ic_mean": F.avg(x).over(whole), "rank_ic_std": F.coalesce(F.stddev_samp(x).over(whole), F.lit(0.0))})
    off = x - F.col("rank_ic_mean")
    v = v.withColumns({"zscore": F.when(F.round("rank_ic_std", 12) > 0, off / F.col("rank_ic_std")), "_sq": off * off})
    v = v.withColumn("variance_share", F.try_divide(F.col("_sq"), F.sum("_sq").over(whole)))
    v = v.withColumn("driver_rank", F.when(F.col("variance_share").isNotNull(), F.row_number().over(whole.orderBy(F.desc_nulls_last(F.round("_sq", 12)), "fold"))))
    low = F.round(x, 12)
    side = F.when(x >= F.col("rank_ic_mean"), "variance_driver_high_side").otherwise("variance_driver_low_side")
    ladder = [
        (low <= bad, F.lit("bad_rank_ic"), "fold_stability"),
        (low < 0, F.lit("negative_rank_ic"), "fold_stability"),
        (low < target, F.lit("below_target_rank_ic"), "fold_stability"),
        (F.round(F.abs("zscore"), 9) >= 1.0, side, "fold_stability"),
        (F.round("official_f1", 12) < least_f1, F.lit("official_threshold_f1"), "threshold_calibration"),
        (F.round("official_rate", 12) > most_rate, F.lit("official_threshold_pred_long_rate"), "threshold_calibration"),
        (F.round("top_10_return", 12) <= 0, F.lit("top_10_payoff"), "score_band_policy"),
    ]
    issue, track, bucket = F.lit("ok"), F.lit("monitor"), F.lit("rank_ic_ok")
    for i, (when, name, where) in reversed(list(enumerate(ladder))):
        issue, track = F.when(when, name).otherwise(issue), F.when(when, where).otherwise(track)
        bucket = F.when(when, name if i < 4 else F.lit("rank_ic_ok")).otherwise(bucket)
    return v.withColumns({"bucket": bucket, "issue": issue, "track": track}).drop("_sq")


def validation_choice(steps: DataFrame, by: list[str], most_rate: float, least_precision: float) -> DataFrame:
    """by, threshold: of the distinct scores, their quantiles 0.5 to 0.9, 0.5 itself and a threshold beyond either end,
    the one with the largest F1 under the bounds; ties by precision, lower rate, lower threshold. Where none keeps both
    bounds, the bound of the rate alone counts, then none."""
    quantiles = (0.5, 0.6, 0.7, 0.8, 0.9)
    keys = steps.groupBy(*by).agg(*[m.quantile_of(q).alias(f"q{i}") for i, q in enumerate(quantiles)], F.max("threshold").alias("hi"), F.min("threshold").alias("lo"))
    extra = keys.select(*by, F.explode(F.array(*[F.col(f"q{i}") for i in range(len(quantiles))], F.lit(0.5), F.col("hi") + 1e-9, F.col("lo") - 1e-9)).alias("threshold")).distinct()
    # an extra threshold predicts what the next score above does: the last row of the steps at or above it
    placed = extra.withColumnRenamed("threshold", "c").join(steps, by)
    at = placed.groupBy(*by, F.col("c").alias("threshold")).agg(*[F.max(F.when(F.col("threshold") >= F.col("c"), F.col(x))).alias(x) for x in ("cn", "cpos")], *[F.max(x).alias(x) for x in ("all_n", "all_pos")]).fillna(0, ["cn", "cpos"])
    s = steps.select(*by, "threshold", "cn", "cpos", "all_n", "all_pos").unionByName(at.select(*by, "threshold", "cn", "cpos", "all_n", "all_pos"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 12)
    s = s.withColumns({"f1": m.f1_of(F.col("cpos"), F.col("cn"), F.col("all_pos")), "precision": ratio(F.col("cpos"), F.col("cn")), "rate": ratio(F.col("cn"), F.col("all_n"))})
    few = F.col("rate") <= most_rate
    kind = F.when(few & (F.col("precision") >= least_precision), 2).when(few, 1).otherwise(0)
    best = s.groupBy(*by).agg(F.max(F.struct(kind.alias("kind"), "f1", "precision", (-F.col("rate")).alias("r"), (-F.col("threshold")).alias("t"))).alias("m"))
    return best.select(*by, (-F.col("m.t")).alias("threshold"), F.col("m.f1").alias("source_f1"), (F.col("m.kind") == 2).alias("constraint_satisfied"))


def regime_counts(preds: DataFrame, regimes: int) -> DataFrame:
    """Score counts with returns by profile, fold, split and dominant regime, as a table: the one pass over the rows."""
    return written(m.score_counts(preds.withColumn("regime", m.dominant("regime_prob_", regimes)), [*KEYS, "split", "regime"], returns="forward_return"), "regime-counts")


def regime_thresholds(preds: DataFrame, regimes: int, official: DataFrame, least_val: int = 80, least_test: int = 40, least_longs: int = 5, most_rate: float = 0.70, least_precision: float = 0.30, gates=rules.REGIME_FOLD, counts: DataFrame | None = None) -> DataFrame:
    """Per profile and fold: a threshold for each regime with enough val rows, val longs and test rows, the official one
    for the others; figures on val and test rows, and the reasons against it. official: `review.threshold_diagnostics`;
    counts: `regime_counts` of preds, made if not given."""
    by = [*KEYS, "regime"]
    counts = regime_counts(preds, regimes) if counts is None else counts
    steps = written(m.steps_of_counts(counts.where("split IN ('val', 'test')"), [*KEYS, "split", "regime"]), "policy-steps")
    val, test = steps.where("split = 'val'"), steps.where("split = 'test'")
    n = steps.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("split") == s, F.col(c))), F.lit(0)).alias(f"{s}_{c}") for s in ("val", "test") for c in ("all_n", "all_pos")])
    enough = n.where((F.col("val_all_n") >= least_val) & (F.col("test_all_n") >= least_test) & (F.col("val_all_pos") >= least_longs)).select(*by)
    chosen = validation_choice(val.join(enough, by), by, most_rate, least_precision)
    fallback = official.select(*KEYS, F.col("constrained_threshold").alias("fallback_threshold"), *[F.col(f"test_{c}_constrained").alias(f"official_{c}") for c in ("f1", "precision", "recall", "pred_rate")])
    used = written(n.select(*by).join(chosen, by, "left").join(fallback, KEYS).withColumn("used", F.coalesce("threshold", "fallback_threshold")), "regime-thresholds")
    out = used.groupBy(*KEYS).agg(F.count("threshold").alias("regime_threshold_count"), *[F.first(c).alias(c) for c in ("fallback_threshold", "official_f1", "official_precision", "official_recall", "official_pred_rate")])
    both = None
    for side, s in (("val", val), ("test", test)):
        # a regime's counts at its threshold, added up over the fold's regimes
        at = s.join(used.select(*by, "used"), by)
        hit = F.max(F.when(F.col("threshold") >= F.col("used"), F.struct("cn", "cpos", "cret", "crets")))
        g = at.groupBy(*by).agg(hit.alias("h"), F.max("all_n").alias("all_n"), F.max("all_pos").alias("all_pos"))
        add = lambda c: F.coalesce(F.sum(c), F.lit(0))
        f = g.groupBy(*KEYS).agg(F.count("*").alias("regimes"), *[add(f"h.{c}").alias(c) for c in ("cn", "cpos", "cret", "crets")], F.sum("all_n").alias("all_n"), F.sum("all_pos").alias("all_pos"))
        ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
        made = {"f1": F.coalesce(F.try_divide(2.0 * F.col("cpos"), F.col("cn") + F.col("all_pos")), F.lit(0.0)), "precision": ratio("cpos", "cn"), "recall": ratio("cpos", "all_pos"), "pred_rate": ratio("cn", "all_n"), "mean_return": F.try_divide(F.col("cret"), F.col("crets")), "lift": F.try_divide(F.try_divide(F.col("cpos"), F.col("cn")), F.col("all_pos") / F.col("all_n")), "regimes": F.col("regimes")}
        f = f.select(*KEYS, *[x.alias(f"{side}_{k}") for k, x in made.items()])
        both = f if both is None else both.join(f, KEYS)
    out = out.join(both, KEYS).withColumn("f1_delta", F.col("test_f1") - F.col("official_f1"))
    out = out.withColumn("reject_reason", rules.reasons(gates))
    return out.withColumn("passed_fold", F.col("reject_reason") == "").withColumnRenamed("test_regimes", "regime_count").drop("val_regimes")


def regime_threshold_summary(folds: DataFrame, gates=rules.REGIME_POLICY) -> DataFrame:
    """One row a profile of `regime_thresholds`: means over folds and whether the policy is worth a review."""
    g = folds.groupBy("profile").agg(
        F.countDistinct("fold").alias("fold_count"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("test_f1", "test_precision", "test_pred_rate", "test_mean_return", "official_f1", "official_pred_rate", "f1_delta", "regime_threshold_count")],
        F.avg(flag(F.col("passed_fold"))).alias("passed_fold_rate"),
        F.avg(above(F.col("test_mean_return"), 0.0)).alias("positive_return_fold_rate"),
    )
    g = g.withColumn("reject_reason", rules.reasons(gates))
    return g.withColumn("next_action", F.when(F.col("reject_reason") == "", "pre_register_regime_threshold_policy_for_future_oos_review").otherwise("diagnostic_only_do_not_promote"))


def reliability_gates(preds: DataFrame, official: DataFrame, top_bands: DataFrame, gates: dict[str, tuple[rules.Rule, ...]] = rules.RELIABILITY) -> DataFrame:
    """Per profile, fold and gate: whether the fold's val rows pass, beside what its test rows then show."""
    val, test = preds.where("split = 'val'"), preds.where("split = 'test'")
    scored = val.where("label IS NOT NULL AND prob_long IS NOT NULL")
    # distinct scores with their rows and longs: all but the correlation follows from them
    steps = written(m.score_steps(scored, KEYS), "val-steps")
    n, pos, x = F.col("n"), F.col("pos"), F.col("threshold")
    mean = lambda v, of: F.try_divide(F.sum(v * of), F.sum(of))
    means = steps.groupBy(*KEYS).agg(mean(x, n).alias("_mean"))
    off = x - F.col("_mean")
    plain = steps.join(means, KEYS).groupBy(*KEYS).agg((mean(x, pos) - mean(x, n - pos)).alias("val_score_gap"), (F.sum("pos") / F.sum("n")).alias("val_label_rate"), F.sqrt(mean(off * off, n)).alias("val_prob_std"), mean(flag(x >= 0.5), n).alias("val_pred_rate_050"), (F.min(x) < F.max(x)).alias("_spread"))
    ap = m.average_precision_of(steps, KEYS)
    two = F.col("_spread") & (F.col("val_label_rate") > 0) & (F.col("val_label_rate") < 1)
    v = plain.join(m.rank_ic(scored, KEYS, undefined=None).select(*KEYS, F.col("rank_ic").alias("val_rank_ic")), KEYS, "left")
    v = v.join(m.ks_of(steps, KEYS).withColumnRenamed("ks", "val_score_ks"), KEYS, "left")
    v = v.join(ap, KEYS, "left").withColumn("val_average_precision", F.when(two, F.col("average_precision"))).drop("average_precision", "_spread")
    t = m.rank_ic(test, KEYS).select(*KEYS, F.col("rank_ic").alias("test_rank_ic"))
    t = t.join(official.select(*KEYS, F.col("test_f1_constrained").alias("test_official_f1"), F.col("test_pred_rate_constrained").alias("test_official_rate")), KEYS, "left")
    t = t.join(top_bands.select(*KEYS, F.col("lift").alias("test_top_10_lift"), F.col("mean_return").alias("test_top_10_return")), KEYS, "left")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("gate"), (rules.reasons(own) == "").alias("gate_passed")) for name, own in gates.items()]))
    return v.join(t, KEYS).withColumn("g", each).select("*", "g.gate", "g.gate_passed").drop("g")


def reliability_summary(detail: DataFrame, gates=rules.RELIABLE) -> DataFrame:
    """One row a profile and gate: the accepted folds beside all, what the gate catches and loses, and the reasons against it."""
    x, ok = F.col("test_rank_ic"), F.col("gate_passed")
    of = lambda f, c: f(F.when(ok, c))
    g = detail.groupBy("profile", "gate").agg(
        F.count("*").alias("folds"),
        F.count_if(ok).alias("accepted_folds"),
        F.avg(x).alias("all_rank_ic_mean"),
        F.stddev_samp(x).alias("all_rank_ic_std"),
        of(F.avg, x).alias("accepted_rank_ic_mean"),
        of(F.stddev_samp, x).alias("accepted_rank_ic_std"),
        F.avg(F.when(ok, flag(x > 0))).alias("accepted_positive_ic_fraction"),
        of(F.avg, F.col("test_official_f1")).alias("accepted_f1_mean"),
        of(F.avg, F.col("test_top_10_return")).alias("accepted_top_10_return_mean"),
        F.avg("test_official_f1").alias("_f1"),
        *[F.count_if(c).alias(n) for n, c in (("_neg", x < 0), ("_pos", x > 0), ("_rneg", ~ok & (x < 0)), ("_rpos", ~ok & (x > 0)))],
    )
    g = g.withColumns({
        "accepted_fraction": F.col("accepted_folds") / F.col("folds"),
        "rejected_negative_capture_rate": F.try_divide(F.col("_rneg"), F.col("_neg")),
        "false_reject_positive_rate": F.try_divide(F.col("_rpos"), F.col("_pos")),
        "accepted_mean_delta": F.col("accepted_rank_ic_mean") - F.col("all_rank_ic_mean"),
        "accepted_std_delta": F.col("accepted_rank_ic_std") - F.col("all_rank_ic_std"),
        "accepted_f1_delta": F.col("accepted_f1_mean") - F.col("_f1"),
    })
    return g.withColumn("reject_reason", rules.reasons(gates)).drop("_neg", "_pos", "_rneg", "_rpos", "_f1")


def oos_monitor(preds: DataFrame, anchor: Column, least_bars: int, preferred_bars: int, bar_seconds: int = 3600, enabled: bool = True, status: str = "", roll_forward: bool = False) -> DataFrame:
    """One row a profile: bars of unseen time since an anchor, whether they are enough, whether the holdout is locked, and
    what is next. A profile whose data end before the anchor has no new bars."""
    g = preds.groupBy("profile").agg(F.max("ts").alias("latest_data_end")).withColumn("anchor_data_end", anchor)
    seconds = F.unix_timestamp(F.col("latest_data_end").cast("timestamp")) - F.unix_timestamp(F.col("anchor_data_end").cast("timestamp"))
    g = g.withColumn("new_bars", F.greatest(F.lit(0), F.floor(seconds / bar_seconds)).cast("long"))
    spent = any(x in status.lower() for x in ("failed", "invalidated", "retired"))
    ready = (F.col("new_bars") >= least_bars) & F.lit(least_bars > 0)
    return g.withColumns({
        "least_bars_remaining": F.greatest(F.lit(0), least_bars - F.col("new_bars")),
        "preferred_bars_remaining": F.greatest(F.lit(0), preferred_bars - F.col("new_bars")),
        "ready": ready,
        "preferred_ready": (F.col("new_bars") >= preferred_bars) & F.lit(preferred_bars > 0),
        "roll_forward_locked": F.lit(enabled and spent and not roll_forward),
        "next_action": F.lit("monitor_disabled") if not enabled else F.when(ready, "future_oos_window_available").otherwise("wait_for_new_unseen_bars"),
    })


def transferred(preds: DataFrame, most_rate: float, least_precision: float, alpha: float = 0.35) -> DataFrame:
    """Thresholds that earlier folds suggest (last, mean, median, weighted mean) on each fold's test rows, beside the
    fold's own val threshold: profile, fold, policy, threshold, figures, differences. A fold without earlier ones has its own alone."""
    steps = steps_of(preds)
    own = m.constrained_of(steps.where("split = 'val'"), KEYS, F.lit(most_rate), least_precision).select(*KEYS, "threshold")
    seen = reports.over_prior_folds(own, alpha)
    names = {"own_validation": "threshold", "last_fold": "last_threshold", "prior_mean": "prior_mean", "prior_median": "prior_median", "prior_ewm": "prior_ewm"}
    seen = written(seen, "prior-thresholds")  # a row a fold
    at = m.at_steps(steps.where("split = 'test'"), seen, KEYS, names).join(seen, KEYS)
    fields = ("f1", "precision", "recall", "pred_rate", "mean_return")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(c).alias("used_threshold"), *[F.col(f"{x}_{n}").alias(x) for x in fields]) for n, c in names.items()]))
    each = at.select(*KEYS, F.col("f1_own_validation").alias("own_f1"), F.col("pred_rate_own_validation").alias("own_rate"), rows.alias("p")).select(*KEYS, "own_f1", "own_rate", "p.*")
    return each.where("used_threshold IS NOT NULL").select(*KEYS, "policy", F.col("used_threshold").alias("threshold"), *fields, (F.col("f1") - F.col("own_f1")).alias("f1_delta"), (F.col("pred_rate") - F.col("own_rate")).alias("rate_delta"))
