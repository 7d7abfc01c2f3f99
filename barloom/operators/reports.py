"""Evaluation tables over predictions: bands, transfers, forensics, blends and gates.

All take the predictions of any number of profiles at once; (profile, fold) are grouping keys,
never loops.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import flag
from barloom.operators import metrics as m
from barloom.operators import ranks


#: Families of feature names without their timeframe, by the first pattern that matches.
FAMILIES = (
    (r"^fut_.*funding", "futures_funding_context"),
    (r"^fut_.*(toptrader|long_short|taker_long_short)", "futures_positioning_context"),
    (r"^fut_(oi|.*_oi_)", "futures_open_interest_context"),
    (r"^fut_", "futures_context"),
    (r"^ih15_", "order_flow_intrahour"),
    (r"_x_.*(rv14_rank|gk14_rank|atr14_rank)|(rv14_rank|gk14_rank|atr14_rank).*_x_", "flow_volatility_interaction"),
    (r"^.*?(log_return|realized_vol|gk_vol|atr|adx|vwap|denoised|volume_log_zscore).*?_stable_", "volatility_structure_stable"),
    (r"_stable_", "order_flow_v2_stable"),
    (r"orderflow_efficiency|absorption_pressure|cvd_price_divergence|large_trade_pressure|cvd_pressure", "order_flow_v2_raw"),
    (r"taker_imbalance|taker_buy_ratio_delta|taker_buy_ratio_zscore", "order_flow_v2_bounded"),
    (r"true_cvd|cvd_cumulative|taker_buy_ratio|taker_sell_ratio|buy_sell_imbalance", "order_flow_tier1"),
    (r"vpt|whale|vol_per_trade|large_trade_ratio", "whale"),
    (r"log_return|realized_vol|gk_vol|atr|adx|vwap|denoised", "volatility_structure"),
)


def timeframe(name: Column) -> Column:
    own = F.regexp_replace(name, "^4h_", "")
    return F.when(own.startswith("fut_"), "futures").when(own.startswith("ih15_"), "intrahour").when(name.startswith("4h_"), "4h").otherwise("1h")


def family(name: Column) -> Column:
    own, out = F.regexp_replace(name, "^4h_", ""), F.lit("other")
    for pattern, kind in reversed(FAMILIES):
        out = F.when(own.rlike(pattern), kind).otherwise(out)
    return out


def threshold_transfer(preds: DataFrame, by: list[str], most_rate: float, least_precision: float) -> DataFrame:
    """The constrained threshold of each key's val rows, applied to its test rows."""
    v = m.constrained_f1(preds.where("split = 'val'"), by, most_rate, least_precision).select(*by, "threshold", F.col("f1").alias("val_f1"))
    t = preds.where("split = 'test'").join(v, by)
    return t.groupBy(*by).agg(F.first("threshold").alias("threshold"), F.first("val_f1").alias("val_f1"), *[x.alias(k) for k, x in m.at_threshold("prob_long", "label", F.col("threshold")).items()])


def over_prior_folds(thresholds: DataFrame, alpha: float = 0.35) -> DataFrame:
    """thresholds (profile, fold, threshold) plus what earlier folds suggest: the last, mean, median and weighted mean."""
    o = Window.partitionBy("profile").orderBy("fold")  # a row a fold
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.collect_list("threshold").over(before)
    return thresholds.withColumns({
        "last_threshold": F.lag("threshold").over(o),
        "prior_mean": F.avg("threshold").over(before),
        "prior_median": F.percentile("threshold", 0.5).over(before),
        "seen": seen,
    }).withColumn("prior_ewm", F.when(F.size("seen") > 0, F.aggregate(F.slice("seen", 2, 1_000_000), F.get("seen", F.lit(0)), lambda a, x: (1 - alpha) * a + alpha * x))).drop("seen")


def prior_thresholds(preds: DataFrame, most_rate: float, least_precision: float, alpha: float = 0.35) -> DataFrame:
    """Each fold's val threshold beside what earlier folds suggest."""
    v = m.constrained_f1(preds.where("split = 'val'"), ["profile", "fold"], most_rate, least_precision).select("profile", "fold", "threshold")
    return over_prior_folds(v, alpha)


def banded(df: DataFrame, by: list[str]) -> DataFrame:
    """What bands need of the rows, made once."""
    return ranks.settled(df.select(*by, "row_pos", "prob_long", "label", "forward_return"), "band-rows")


def bin_totals(df: DataFrame, by: list[str], bins: int) -> DataFrame:
    """by, bin (of the first-come rank of the score), and the bin's rows, positives, sum and count of returns, and gains."""
    r = F.col("forward_return")
    sums = {"n": F.lit(1), "pos": F.col("label"), "ret": r, "rets": flag(r.isNotNull()), "hits": flag(r > 0)}
    return ranks.bin_sums(banded(df, by), [F.col("prob_long"), F.col("row_pos")], bins, by, sums)


def score_lift(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    g = bin_totals(df, by, bins).withColumn("mean_return", F.try_divide("ret", "rets")).drop("ret", "rets", "hits")
    whole = Window.partitionBy(*by)
    base = F.sum("pos").over(whole) / F.sum("n").over(whole)
    return g.withColumns({"rate": F.col("pos") / F.col("n"), "is_top": F.col("bin") == bins - 1}).withColumn("lift", F.try_divide(F.col("rate"), base))


def score_bands(df: DataFrame, by: list[str], bands: list[tuple[str, int, int]], bins: int = 10) -> DataFrame:
    """Rows, selection rate, precision, recall, F1, lift and mean return of every band of quantile bins; a row is in each band that has its bin."""
    per_bin = bin_totals(df, by, bins)
    whole = Window.partitionBy(*by)
    per_bin = per_bin.withColumns({"all_n": F.sum("n").over(whole), "all_pos": F.sum("pos").over(whole)})
    of = F.filter(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, a, b in bands]), lambda x: (F.col("bin") >= x["lo"]) & (F.col("bin") <= x["hi"]))
    g = per_bin.withColumn("b", F.explode(of)).groupBy(*by, F.col("b.band").alias("band")).agg(*[F.sum(c).alias(c) for c in ("n", "pos", "ret", "rets", "hits")], F.first("all_n").alias("all_n"), F.first("all_pos").alias("all_pos"))
    return g.withColumns({
        "precision": F.col("pos") / F.col("n"),
        "recall": F.try_divide(F.col("pos"), F.col("all_pos")),
        "lift": F.try_divide(F.col("pos") / F.col("n"), F.col("all_pos") / F.col("all_n")),
        "mean_return": F.try_divide(F.col("ret"), F.col("rets")),
        "hit_rate": F.col("hits") / F.col("n"),
        "selection_rate": F.col("n") / F.col("all_n"),
        "f1": F.coalesce(F.try_divide(2.0 * F.col("pos"), F.col("n") + F.col("all_pos")), F.lit(0.0)),
    })


def band_ic(df: DataFrame, by: list[str], bands: list[tuple[str, int, int]], bins: int = 10) -> DataFrame:
    """Rank correlation of score and return within each band."""
    return m.rank_ic(m.bands_of(df.select(*by, "row_pos", "prob_long", "forward_return"), by, bins, bands), [*by, "band"]).select(*by, "band", F.col("rank_ic").alias("rank_ic_within_band"))


def lift_by_fold(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """The lowest and the highest bin of each fold and the rank correlation of bin and rate, ties at their mean; null where all rates are equal."""
    b = score_lift(df, by, bins)
    whole = Window.partitionBy(*by)  # a row a bin
    rate = F.round("rate", 12)
    rank = F.rank().over(whole.orderBy(rate)) + (F.count("*").over(Window.partitionBy(*by, rate)) - 1) / 2
    pick = lambda f, c: f(c, "bin")
    g = b.withColumn("_rank", rank).groupBy(*by).agg(
        F.sum("n").alias("n"),
        *[pick(f, c).alias(f"{name}_{c}") for name, f in (("bottom", F.min_by), ("top", F.max_by)) for c in ("rate", "lift", "mean_return")],
        F.when(F.min(rate) < F.max(rate), F.corr("bin", "_rank")).alias("rate_spearman"),
    )
    return g.withColumns({"rate_spread": F.col("top_rate") - F.col("bottom_rate"), "return_spread": F.col("top_mean_return") - F.col("bottom_mean_return")})


def reasons(*pairs: tuple[str, Column]) -> Column:
    """The names of the conditions that hold, joined by semicolons."""
    return F.concat_ws(";", *[F.when(cond, name) for name, cond in pairs])


def payoff_alignment(df: DataFrame, by: list[str], bands: list[tuple[str, int, int]]) -> DataFrame:
    b = score_bands(df, by, bands)
    return b.groupBy("profile", "band").agg(F.count("*").alias("folds"), (F.sum("hits") / F.sum("n")).alias("hit_rate"), F.avg("mean_return").alias("mean_return"), F.corr("precision", "mean_return").alias("precision_return_corr"))


def fold_table(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Every fold's correlation, F1, average precision, rates, score quantiles and returns."""
    q = F.percentile("prob_long", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = df.groupBy(*by).agg(
        F.avg("label").alias("label_rate"),
        F.avg("prob_long").alias("mean_prob"),
        F.stddev_pop("prob_long").alias("prob_std"),
        F.avg("forward_return").alias("mean_return"),
        F.stddev_pop("forward_return").alias("return_std"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.avg(flag(F.col("prob_long") >= threshold)).alias("pred_rate"),
        m.at_threshold("prob_long", "label", F.lit(threshold))["f1"].alias("long_f1"),
        q.alias("_q"),
    )
    g = g.withColumns({f"prob_p{p}": F.get("_q", F.lit(i)) for i, p in enumerate((10, 50, 90))}).drop("_q")
    return m.rank_ic(df, by).join(g, by).join(m.average_precision(df, by).withColumnRenamed("average_precision", "prauc"), by, "left").fillna(0.0, ["prauc"])


#: The fold metrics that recent folds are held against.
FOLD_METRICS = ("rank_ic", "long_f1", "prauc", "label_rate", "pred_rate", "mean_prob", "prob_std", "mean_return")


def recent_folds(folds: DataFrame, recent: int = 5) -> DataFrame:
    """Per profile and metric: the mean over all folds and over the last ones, their difference, extremes and names."""
    back = folds.withColumn("_back", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("fold"))))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in FOLD_METRICS]))
    x = back.withColumn("_x", each).select("profile", "fold", "_back", "_x.*").where("v IS NOT NULL")
    near = F.when(F.col("_back") <= recent, F.col("v"))
    g = x.groupBy("profile", "metric").agg(F.avg("v").alias("all_mean"), F.avg(near).alias("recent_mean"), F.min(near).alias("recent_min"), F.max(near).alias("recent_max"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_back") <= recent, F.col("fold")))), ",").alias("recent_folds"))
    return g.withColumn("recent_minus_all", F.col("recent_mean") - F.col("all_mean"))


def phase_report(test: DataFrame, mean: float = 0.03, std: float = 0.03, positive: float = 0.75, f1: float = 0.45, random_like: float = 0.01, suspicious: float = 0.20) -> DataFrame:
    """One row a profile: means over folds, the score's separation of the classes, checks, and alerts on a
    correlation that is near zero or too good."""
    folds = fold_table(test, ["profile", "fold"])
    g = folds.groupBy("profile").agg(F.count("*").alias("folds"), F.avg("rank_ic").alias("mean_ic"), F.stddev_pop("rank_ic").alias("std_ic"), F.avg(flag(F.col("rank_ic") > 0)).alias("positive_fraction"), F.avg("long_f1").alias("mean_f1"), F.avg("prauc").alias("mean_prauc"))
    on, off = F.avg(F.when(F.col("label") == 1, F.col("prob_long"))), F.avg(F.when(F.col("label") == 0, F.col("prob_long")))
    g = g.join(test.groupBy("profile").agg((on - off).alias("separation")), "profile")
    g = g.withColumns({"ic_ok": F.col("mean_ic") > mean, "std_ok": F.col("std_ic") < std, "positive_ok": F.col("positive_fraction") > positive, "f1_ok": F.col("mean_f1") > f1, "separation_ok": F.coalesce(F.col("separation") > 0, F.lit(False))})
    alerts = reasons(("rank_ic_near_random", F.abs("mean_ic") <= random_like), ("rank_ic_suspiciously_high", F.col("mean_ic") >= suspicious))
    return g.withColumns({"passed": F.col("ic_ok") & F.col("std_ok") & F.col("positive_ok") & F.col("f1_ok") & F.col("separation_ok"), "alerts": alerts})


def tails(ic: DataFrame, worst: int = 5) -> DataFrame:
    up, n = F.row_number().over(Window.partitionBy("profile").orderBy("rank_ic", "fold")), F.count("*").over(Window.partitionBy("profile"))
    k = ic.withColumns({"up": up, "folds": n})
    x = F.col("rank_ic")
    return k.groupBy("profile").agg(F.avg(F.when(F.col("up") <= worst, x)).alias(f"worst_{worst}"), F.avg(F.when(F.col("up") <= F.ceil(0.2 * F.col("folds")), x)).alias("cvar_20"), F.count_if(x < 0).alias("negative"), F.avg(flag(x < 0)).alias("negative_fraction"))


def unpivoted(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """by, forward_return, feature, v: one row a feature, NaN and infinities missing."""
    finite = lambda f: F.nullif(F.nullif(F.nullif(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))), F.lit(float("inf"))), F.lit(float("-inf")))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), finite(f).alias("v")) for f in features]))
    return df.select(*by, "forward_return", each.alias("x")).select(*by, "forward_return", "x.*")


def feature_ics(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Per key and feature: rank correlation with the return, mean, deviation and count; features unpivoted once."""
    keys = [*by, "feature"]
    long = ranks.settled(unpivoted(df, by, features).where("v IS NOT NULL AND forward_return IS NOT NULL"), "feature-rows")
    stats = long.groupBy(*keys).agg(F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v"))
    ic = m.rank_ic(long, keys, "v", "forward_return", least=1).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("rank_ic").alias("feature_ic"), "n")
    return stats.join(ic, ranks.same(keys, "_of_")).select(*keys, "feature_ic", "mean_v", "std_v", "n")


def fold_quality(ic: DataFrame, good_ic: float = 0.10, bad_ic: float = -0.08) -> DataFrame:
    """profile, fold, rank_ic, quality: good, bad, or neutral between the two bounds."""
    q = F.when(F.col("rank_ic") >= good_ic, "good").when(F.col("rank_ic") <= bad_ic, "bad").otherwise("neutral")
    return ic.select("profile", "fold", "rank_ic", q.alias("quality"))


def good_bad_summary(ic: DataFrame, good_ic: float = 0.10, bad_ic: float = -0.08) -> DataFrame:
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("quality") == kind, F.col("fold"))))
    g = fold_quality(ic, good_ic, bad_ic).groupBy("profile").agg(of("good").alias("good"), of("bad").alias("bad"))
    return g.select("profile", *[x for k in ("good", "bad") for x in (F.array_join(k, ",").alias(f"{k}_folds"), F.size(k).alias(f"{k}_fold_count"))])


def feature_forensics(df: DataFrame, features: list[str], good_ic: float = 0.10, bad_ic: float = -0.08, least_ic: float = 0.02) -> DataFrame:
    """Each bad fold's features beside those of all good folds' rows together.

    Rows get one cohort each (the good rows of a profile, or a bad fold), so features are ranked once. The
    deviation is that of both cohorts' rows together, from their counts, means and deviations."""
    q = fold_quality(m.rank_ic(df, ["profile", "fold"]), good_ic, bad_ic).where("quality <> 'neutral'")
    cohort = F.when(F.col("quality") == "bad", F.col("fold"))
    x = feature_ics(df.join(q, ["profile", "fold"]).withColumn("cohort", cohort), ["profile", "cohort"], features).where("n >= 3")
    good = x.where("cohort IS NULL").select("profile", "feature", *[F.col(c).alias(f"g_{c}") for c in ("feature_ic", "mean_v", "std_v", "n")])
    bad = x.where("cohort IS NOT NULL").withColumnRenamed("cohort", "fold").join(q.where("quality = 'bad'").select("profile", "fold", "rank_ic"), ["profile", "fold"])
    j = bad.join(good, ["profile", "feature"])
    n, gap = F.col("n") + F.col("g_n"), F.col("mean_v") - F.col("g_mean_v")
    pooled = F.sqrt((F.col("n") * F.pow("std_v", F.lit(2)) + F.col("g_n") * F.pow("g_std_v", F.lit(2))) / n + F.col("n") * F.col("g_n") * gap * gap / (n * n))
    strong = (F.abs("feature_ic") >= least_ic) & (F.abs("g_feature_ic") >= least_ic)
    return j.select(
        "profile",
        F.col("fold").alias("bad_fold"),
        F.col("rank_ic").alias("bad_fold_rank_ic"),
        "feature",
        timeframe(F.col("feature")).alias("timeframe"),
        family(F.col("feature")).alias("family"),
        F.col("g_feature_ic").alias("good_feature_ic"),
        F.col("feature_ic").alias("bad_feature_ic"),
        (F.col("feature_ic") - F.col("g_feature_ic")).alias("delta_ic"),
        (strong & (F.signum("feature_ic") != F.signum("g_feature_ic"))).alias("signal_reversal"),
        F.col("g_mean_v").alias("good_mean"),
        F.col("mean_v").alias("bad_mean"),
        gap.alias("mean_diff"),
        F.coalesce(F.try_divide(F.abs(gap), pooled), F.lit(0.0)).alias("abs_standardized_diff"),
    )


def top_names(by: Column, most: int = 5) -> Column:
    """The features of the largest values, joined; equal values by name."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.round(by, 9)).alias("v"), F.col("feature").alias("name"))))
    return F.array_join(F.transform(F.slice(pairs, 1, most), lambda x: x["name"]), ",")


def group_forensics(forensics: DataFrame) -> DataFrame:
    """Feature forensics by profile, bad fold, timeframe and family."""
    return forensics.groupBy("profile", "bad_fold", "bad_fold_rank_ic", "timeframe", "family").agg(
        F.countDistinct("feature").alias("feature_count"),
        F.avg("good_feature_ic").alias("mean_good_feature_ic"),
        F.avg("bad_feature_ic").alias("mean_bad_feature_ic"),
        F.avg("delta_ic").alias("mean_delta_ic"),
        F.avg(F.abs("delta_ic")).alias("mean_abs_delta_ic"),
        F.avg(flag(F.col("signal_reversal"))).alias("signal_reversal_rate"),
        F.avg("abs_standardized_diff").alias("mean_abs_standardized_diff"),
        top_names(F.abs("delta_ic")).alias("top_delta_features"),
        top_names(F.col("abs_standardized_diff")).alias("top_shifted_features"),
    )


def forensics_watchlist(forensics: DataFrame, by: list[str], least_folds: int, least_reversals: float, least_delta: float, action: str) -> DataFrame:
    """What fails in several bad folds: recommended for action where signals reverse or drift often enough.

    forensics: feature_forensics (by feature) or group_forensics (by family), with its per-row columns."""
    per_group = "signal_reversal_rate" in forensics.columns
    delta, absolute, reversed_ = ("mean_delta_ic", F.col("mean_abs_delta_ic"), F.col("signal_reversal_rate")) if per_group else ("delta_ic", F.abs("delta_ic"), flag(F.col("signal_reversal")))
    shift = F.col("mean_abs_standardized_diff" if per_group else "abs_standardized_diff")
    g = forensics.groupBy("profile", *by).agg(
        F.countDistinct("bad_fold").alias("bad_fold_count"),
        F.array_join(F.array_sort(F.collect_set("bad_fold")), ",").alias("bad_folds"),
        F.avg(delta).alias("mean_delta_ic"),
        F.avg(absolute).alias("mean_abs_delta_ic"),
        F.avg(reversed_).alias("signal_reversal_rate"),
        F.avg(shift).alias("mean_abs_standardized_diff"),
    )
    often = (F.col("bad_fold_count") >= least_folds) & ((F.col("signal_reversal_rate") >= least_reversals) | (F.col("mean_abs_delta_ic") >= least_delta))
    return g.withColumn("recommended_action", F.when(often, action).otherwise("monitor"))


def regime_by_fold(df: DataFrame, regimes: int, bad_ic: float = -0.08, threshold: float = 0.5) -> DataFrame:
    """Every fold's rows by their likeliest regime: correlation, rates, return and F1 beside the fold's own correlation."""
    t = df.withColumn("regime", m.dominant("regime_prob_", regimes))
    by = ["profile", "fold", "regime"]
    f1 = m.at_threshold("prob_long", "label", F.lit(threshold))["f1"]
    g = t.groupBy(*by).agg(F.avg("label").alias("label_rate"), F.avg(flag(F.col("prob_long") >= threshold)).alias("pred_rate"), F.avg("forward_return").alias("mean_return"), f1.alias("f1"))
    whole = m.rank_ic(df, ["profile", "fold"]).select("profile", "fold", F.col("rank_ic").alias("fold_rank_ic"), (F.col("rank_ic") <= bad_ic).alias("is_bad_fold"))
    return m.rank_ic(t, by).join(g, by).join(whole, ["profile", "fold"])


def feature_audit(df: DataFrame, features: list[str], good_ic: float = 0.10, bad_ic: float = -0.08, most: int = 30) -> DataFrame:
    """Features of all good folds' rows beside those of all bad folds': means, shift, and KS distance; the most different ones."""
    q = fold_quality(m.rank_ic(df, ["profile", "fold"]), good_ic, bad_ic).where("quality <> 'neutral'").select("profile", "fold", "quality")
    long = unpivoted(df.join(q, ["profile", "fold"]), ["profile", "quality"], features).where("v IS NOT NULL")
    by = ["profile", "feature"]
    of = lambda kind, f: f(F.when(F.col("quality") == kind, F.col("v")))
    g = long.groupBy(*by).agg(of("good", F.avg).alias("good_mean"), of("bad", F.avg).alias("bad_mean"), F.stddev_pop("v").alias("std"), of("good", F.count).alias("ng"), of("bad", F.count).alias("nb")).where("ng >= 3 AND nb >= 3")
    g = g.withColumn("mean_diff", F.col("good_mean") - F.col("bad_mean")).withColumn("abs_standardized_diff", F.coalesce(F.try_divide(F.abs("mean_diff"), F.col("std")), F.lit(0.0)))
    k = m.ks(long, by, "v", F.col("quality") == "good")
    place = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc(F.round("ks", 9)), F.desc(F.round("abs_standardized_diff", 9)), "feature"))
    return g.join(k, by).withColumn("place", place).where(F.col("place") <= most).drop("std", "ng", "nb")


def side_by_side(preds: DataFrame, profiles: list[str], keys: list[str], rank_by: list[str], more: dict[str, list[str]] | None = None) -> DataFrame:
    """keys, and by profile (its place in profiles): n_i (rows), prob_i, rank_i (share of ranks within rank_by); of each
    profile in `more` also its columns named there. One row a key, whatever the profiles are blended to."""
    more = more or {}
    extra = sorted({c for cs in more.values() for c in cs})
    some = ranks.settled(preds.where(F.col("profile").isin(*profiles)).select("profile", *dict.fromkeys([*keys, *rank_by]), "prob_long", *extra), "blend-rows")
    ranked = ranks.average_rank(some, ["profile", *rank_by], "prob_long", "_rank", share=True)
    of = lambda p, c: F.when(F.col("profile") == p, F.col(c) if isinstance(c, str) else c)
    aggs = [x for i, p in enumerate(profiles) for x in (F.count(of(p, F.lit(1))).cast("int").alias(f"n_{i}"), F.max(of(p, "prob_long")).alias(f"prob_{i}"), F.max(of(p, "_rank")).alias(f"rank_{i}"))]
    return ranked.groupBy(*keys).agg(*aggs, *[F.max(of(p, c)).alias(c) for p, cs in more.items() for c in cs])


def blends(preds: DataFrame, combos: dict[str, tuple[tuple[str, ...], tuple[float, ...] | None]], keys: list[str], rank_by: list[str]) -> DataFrame:
    """blend, method, keys, score, and the spread of the profiles' scores, for rows that all profiles of a blend have.

    combos: name -> (profiles, weights or None). Scores are probabilities (prob_*) or their share of ranks within
    profile and rank_by (rank_*), plain means or, with weights, weighted means. A row's profiles are brought together
    once and all its blends are made of that."""
    profiles = sorted({p for members, _ in combos.values() for p in members})
    return blended(side_by_side(preds, profiles, keys, rank_by), profiles, combos, keys)


def blended(beside: DataFrame, profiles: list[str], combos: dict, keys: list[str]) -> DataFrame:
    """blends from the rows that side_by_side gives."""
    made = []
    for name, (members, weights) in combos.items():
        if weights is not None and (len(weights) != len(members) or min(weights) < 0 or sum(weights) <= 0):
            raise ValueError(f"{name}: weights must be as many as profiles, not negative, and add up to more than zero")
        share = [1 / len(members) if weights is None else x / sum(weights) for x in weights or members]
        at = [profiles.index(p) for p in members]
        here = F.lit(True)
        for i in at:
            here = here & (F.col(f"n_{i}") == 1)
        for kind in ("prob", "rank"):
            x = [F.col(f"{kind}_{i}") for i in at]
            add = lambda values: sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
            n = sum((v.isNotNull().cast("int") for v in x), F.lit(0))  # missing scores count as in an aggregate
            mean = add(x) / F.nullif(n, F.lit(0))
            spread = F.sqrt(add([(v - mean) * (v - mean) for v in x]) / F.nullif(n - 1, F.lit(0)))
            ends = [f(*x) if len(x) > 1 else x[0] for f in (F.least, F.greatest)]
            score = F.when(n > 0, F.round(add([v * w for v, w in zip(x, share, strict=True)]), 12))
            row = F.struct(F.lit(name).alias("blend"), F.lit(f"{kind}_{'mean' if weights is None else 'weighted'}").alias("method"), score.alias("score"), F.when(n > 1, spread).alias("profile_std"), ends[0].alias("profile_min"), ends[1].alias("profile_max"), F.lit(len(members)).cast("long").alias("profiles"))
            made.append(F.when(here, row))
    own = [c for c in beside.columns if c not in keys and not c.startswith(("n_", "prob_", "rank_"))]
    each = beside.withColumn("_b", F.explode(F.array_compact(F.array(*made))))
    return each.select("_b.blend", "_b.method", *keys, *[f"_b.{c}" for c in ("score", "profile_std", "profile_min", "profile_max", "profiles")], *own)


def all_blends(profiles: list[str], weighted: dict[str, tuple[float, ...]] | None = None) -> dict:
    """Every pair and, of three or more, all profiles together; plus named weights over all of them."""
    combos = {"+".join(c): (c, None) for c in combinations(profiles, 2)}
    if len(profiles) > 2:
        combos["+".join(profiles)] = (tuple(profiles), None)
    return combos | {name: (tuple(profiles), x) for name, x in (weighted or {}).items()}


def profile_delta(ic: DataFrame, control: str) -> DataFrame:
    """Every other profile's folds beside the control's; fold tables are one row a key."""
    c = ic.where(F.col("profile") == control).select("fold", F.col("rank_ic").alias("control_ic"))
    return ic.where(F.col("profile") != control).join(c, "fold").withColumns({"delta": F.col("rank_ic") - F.col("control_ic"), "improved": F.col("rank_ic") > F.col("control_ic")})


def policy_over_windows(preds: DataFrame, windows: list[tuple[str, str, str]], threshold: float) -> DataFrame:
    """A frozen threshold over named closed time windows, which may overlap."""
    of = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(f"timestamp_ntz'{a}'").alias("a"), F.expr(f"timestamp_ntz'{b}'").alias("b")) for n, a, b in windows]), lambda x: (F.col("ts") >= x["a"]) & (F.col("ts") <= x["b"]))
    t = preds.where(F.col("prob_long") >= threshold).withColumn("x", F.explode(of))
    return t.groupBy("profile", F.col("x.name").alias("window_name")).agg(F.count("*").alias("n"), F.avg("label").alias("precision"), F.avg("forward_return").alias("mean_return"))


def pool_adjacent(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit."""
    level, total, size = [], [], []
    for v, k in zip(y.tolist(), weight.tolist(), strict=True):
        level.append(v)
        total.append(k)
        size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            k = total[-2] + total[-1]
            level[-2:] = [(level[-2] * total[-2] + level[-1] * total[-1]) / k]
            total[-2:] = [k]
            size[-2:] = [size[-2] + size[-1]]
    return np.repeat(level, size)


CHUNKS = 64


def isotonic_curve(val: DataFrame, by: list[str], score: str = "prob_long", label: str = "label") -> DataFrame:
    """by, lo, hi, n, y: the blocks of the isotonic fit on every distinct score. Blocks are pooled in score chunks
    first and then across them, which gives the same fit: adjacent violators may be pooled in any order."""
    points = val.groupBy(*by, F.col(score).alias("lo")).agg(F.count("*").cast("double").alias("n"), F.avg(F.col(label).cast("double")).alias("y"))
    points = points.select(*by, "lo", F.col("lo").alias("hi"), "n", "y", F.floor(F.col("lo") * CHUNKS).alias("chunk"))

    def pool(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        lo, hi, n, y = (table[c].to_numpy() for c in ("lo", "hi", "n", "y"))
        level = pool_adjacent(y, n)
        first = np.flatnonzero(np.r_[True, level[1:] != level[:-1]])
        keys = [table[k].take(pa.array(first)) for k in by]
        return pa.table([*keys, lo[first], hi[np.r_[first[1:], len(lo)] - 1], np.add.reduceat(n, first), level[first]], names=[*by, "lo", "hi", "n", "y"])

    schema = points.drop("chunk").schema
    return points.groupBy(*by, "chunk").applyInArrow(pool, schema).groupBy(*by).applyInArrow(pool, schema)


def isotonic(preds: DataFrame, by: list[str], score: str = "prob_long", label: str = "label") -> DataFrame:
    """preds plus calibrated: isotonic regression on each key's val rows, applied to all its rows; linear between
    fitted points, flat beyond them. One class, or one score, gives the share of long labels."""
    curve = isotonic_curve(preds.where("split = 'val'"), by, score, label)
    knots = curve.select(*by, F.explode(F.array(F.struct(F.col("lo").alias("x"), "y"), F.struct(F.col("hi").alias("x"), "y"))).alias("k")).distinct()
    asked = preds.select(*by, F.col(score).alias("x")).distinct()
    both = asked.withColumn("k", F.lit(None).cast(knots.schema["k"].dataType)).unionByName(knots.select(*by, F.col("k.x").alias("x"), "k"))
    # the nearest points at or below, and at or above: over distinct scores, points before scores that equal them
    order = Window.partitionBy(*by)
    up, down = order.orderBy("x", F.col("k").isNull()), order.orderBy(F.desc("x"), F.col("k").isNull())
    so_far = lambda o: F.last("k", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumns({"_lo": so_far(up), "_hi": so_far(down)}).where("k IS NULL")
    share = (F.col("x") - F.col("_lo.x")) / F.nullif(F.col("_hi.x") - F.col("_lo.x"), F.lit(0.0))
    y = F.coalesce(F.col("_lo.y") + (F.col("_hi.y") - F.col("_lo.y")) * share, F.col("_lo.y"), F.col("_hi.y"))
    return preds.join(met.select(*by, F.col("x").alias(score), y.alias("calibrated")), [*by, score])


def platt(preds: DataFrame, by: list[str], score: str = "prob_long", label: str = "label", rounds: int = 50) -> DataFrame:
    """preds plus calibrated: logistic regression on the score of each key's val rows, half the squared slope as
    penalty, by Newton steps on counts of distinct scores. One class, or one score, gives the share of long labels."""
    points = preds.where("split = 'val'").groupBy(*by, F.col(score).alias("x")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("pos"))

    def fit(table: pa.Table) -> pa.Table:
        x, n, pos = (table[c].to_numpy() for c in ("x", "n", "pos"))
        share = float(pos.sum() / n.sum())
        a = b = 0.0
        if 0 < share < 1 and len(x) > 1:
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-(a * x + b)))
                r, v = n * p - pos, n * p * (1 - p)
                g = np.array([(r * x).sum() + a, r.sum()])
                h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum()]])
                da, db = np.linalg.solve(h, g)
                a, b = a - da, b - db
                if abs(da) + abs(db) < 1e-10:
                    break
        flat = share if share in (0.0, 1.0) or len(x) < 2 else None
        return pa.table([*(table[k].slice(0, 1) for k in by), pa.array([float(a)]), pa.array([float(b)]), pa.array([flat], pa.float64())], names=[*by, "_a", "_b", "_flat"])

    zero = [F.lit(0.0).alias(c) for c in ("_a", "_b")]
    curve = points.groupBy(*by).applyInArrow(fit, points.select(*by, *zero, F.lit(None).cast("double").alias("_flat")).schema)
    return preds.join(curve, by).withColumn("calibrated", F.coalesce("_flat", 1 / (1 + F.exp(-(F.col("_a") * F.col(score) + F.col("_b")))))).drop("_a", "_b", "_flat")


def mtf_leakage(df: DataFrame, by: list[str], ts: str, source: str, available: str, hours: int = 4) -> DataFrame:
    """Whether a slower bar was used before its end: rows with a match, those whose bar is available later than the
    row's time, and those whose bar isn't available exactly `hours` after its start."""
    t, src, at = F.col(ts), F.col(source), F.col(available)
    late, shifted = F.count_if(at > t), F.count_if(at != F.expr(f"`{source}` + interval {hours} hours"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count(src).alias("matched"), late.alias("available_late"), shifted.alias("available_wrong"), ((late == 0) & (shifted == 0)).alias("passed"))
