"""What differs between folds: features of bad against good rows, scores of a fold against all other good folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import metrics as m
from barloom.operators import ranks, reports
from barloom.sources.shared import written

#: Families of feature names without a leading 4h_, by the first of these that a name has. A caret
#: stands for the start. Names with 4h_ keep it before their family but for the first two.
DRIFT_FAMILIES = (
    (("^ih15_",), "ih15_intrahour_order_flow"),
    (("^fut_", "funding", "open_interest", "positioning"), "futures_context"),
    (("large_trade_pressure", "signed_ltp", "^ltp"), "large_trade_pressure"),
    (("cvd_pressure",), "cvd_pressure"),
    (("taker", "imbalance", "cvd", "orderflow", "absorption", "pressure"), "order_flow"),
    (("whale", "vpt", "vol_per_trade", "large_trade_ratio"), "whale_ticket_size"),
    (("volume", "trade_share"), "volume_context"),
    (("realized_vol", "gk_vol", "atr", "adx", "vwap", "return"), "volatility_structure"),
)


def drift_family(name: Column) -> Column:
    own, out = F.regexp_replace(name, "^4h_", ""), F.lit("other")
    prefix = F.when(name.startswith("4h_"), "4h_").otherwise("")
    for i, (tokens, kind) in reversed(list(enumerate(DRIFT_FAMILIES))):
        if i == 1:  # the first two have no prefix
            out = F.concat(prefix, out)
        out = F.when(own.rlike("|".join(tokens)), kind).otherwise(out)
    return out


def feature_drift(df: DataFrame, features: list[str], target: float = 0.03, least: int = 4) -> DataFrame:
    """A profile's features over the rows of its bad folds against those of its good ones, each pooled: shift of the mean,
    correlation with the return, gap between the labels, reversals, a score of suspicion and the likely issue.

    Bad folds have a negative correlation, or one under the target where none is negative; good ones reach the target."""
    ic = m.rank_ic(df, ["profile", "fold"]).select("profile", "fold", F.round("rank_ic", 12).alias("_ic"))
    whole = Window.partitionBy("profile")  # a row a fold
    ic = ic.withColumn("_negative", F.max((F.col("_ic") < 0).cast("int")).over(whole))
    kind = F.when(F.col("_ic") < F.when(F.col("_negative") == 1, 0.0).otherwise(target), "bad").when(F.col("_ic") >= target, "good")
    ic = written(ic.withColumn("cohort", kind).where("cohort IS NOT NULL"), "drift-folds")
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("cohort") == k, F.col("fold"))))
    folds = ic.groupBy("profile").agg(F.when(F.max("_negative") == 1, "negative_rank_ic").otherwise(f"rank_ic_below_target_{target:.3f}").alias("bad_definition"), of("bad").alias("_bad"), of("good").alias("_good"))
    folds = folds.select("profile", "bad_definition", *[x for k in ("bad", "good") for x in (F.size(f"_{k}").alias(f"{k}_fold_count"), F.array_join(f"_{k}", ",").alias(f"{k}_fold_ids"))])
    rows = df.join(ic.select("profile", "fold", "cohort"), ["profile", "fold"])
    keys = ["profile", "cohort", "feature"]
    long = ranks.settled(reports.unpivoted(rows, ["profile", "cohort", "label"], features).where("v IS NOT NULL"), "drift-rows")
    stats = long.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("count"), (F.avg(F.when(F.col("label") == 1, F.col("v"))) - F.avg(F.when(F.col("label") == 0, F.col("v")))).alias("gap"))
    x = stats.join(m.rank_ic(long, keys, "v", "forward_return", least, undefined=None).select(*keys, F.col("rank_ic").alias("ic")), keys, "left")
    of_ = lambda k: x.where(F.col("cohort") == k).select("profile", "feature", *[F.col(c).alias(f"{k}_{c}") for c in ("mean", "std", "count", "gap", "ic")])
    j = of_("bad").join(of_("good"), ["profile", "feature"]).join(folds, "profile")
    c = F.col
    j = j.withColumns({
        "drift_effect": F.try_divide(c("bad_mean") - c("good_mean"), F.nullif(F.round(F.sqrt((c("bad_std") * c("bad_std") + c("good_std") * c("good_std")) / 2), 12), F.lit(0.0))),
        "ic_delta": c("bad_ic") - c("good_ic"),
        "gap_delta": c("bad_gap") - c("good_gap"),
    })
    yes = lambda x: F.coalesce(x, F.lit(False))
    reversed_ = lambda a, b, least_: yes((F.round(c(a), 9) * F.round(c(b), 9) < 0) & (F.round(F.abs(a), 9) >= least_) & (F.round(F.abs(b), 9) >= least_))
    j = j.withColumns({"ic_reversal": reversed_("bad_ic", "good_ic", 0.02), "gap_reversal": reversed_("bad_gap", "good_gap", 0.03), "drift_flag": yes(F.round(F.abs("drift_effect"), 9) >= 0.5)})
    up_to = lambda name, most: F.coalesce(F.least(F.abs(name), F.lit(most)), F.lit(0.0))
    worth = lambda name, w: F.when(c(name), w).otherwise(0.0)
    score = up_to("drift_effect", 3.0) + up_to("ic_delta", 2.0) + 0.5 * up_to("gap_delta", 2.0) + worth("ic_reversal", 1.0) + worth("gap_reversal", 0.75) + worth("drift_flag", 0.5)
    score = F.when(c("drift_effect").isNull() & c("ic_delta").isNull() & c("gap_delta").isNull(), 0.0).otherwise(score)
    issue = (
        F.when(c("ic_reversal") & c("gap_reversal"), "feature_signal_and_label_gap_reversal")
        .when(c("ic_reversal"), "feature_return_ic_reversal")
        .when(c("gap_reversal"), "feature_label_gap_reversal")
        .when(c("drift_flag"), "bad_fold_distribution_drift")
        .when(yes(F.round("ic_delta", 9) < -0.08), "bad_fold_feature_return_ic_degrades")
        .otherwise("monitor")
    )
    return j.withColumns({"family": drift_family(c("feature")), "suspect_score": score, "issue": issue})


def score_shift(df: DataFrame, target: float = 0.03, bins: int = 10) -> DataFrame:
    """Each fold's scores against those of all other folds whose correlation reaches the target, or of all other folds
    where there is none: KS distance, population stability index, means, deviations, quartile ranges, entropies, the issue.

    Nothing is compared fold by fold: counts over a profile's distinct scores are run up once, for all folds and for
    the good ones, and a fold's own counts are taken off them. A quantile of the others is found by its rank, which
    is the rank among the others plus the fold's own scores below it."""
    by, keys = ["profile"], ["profile", "fold"]
    p = F.least(F.greatest(F.col("x"), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = df.where(F.col("prob_long").isNotNull()).withColumn("x", F.col("prob_long"))
    ic = written(m.rank_ic(df, keys).select(*keys, "rank_ic", (F.round("rank_ic", 12) >= target).cast("int").alias("good")), "shift-folds")
    h = -(p * F.ln(p) + (1 - p) * F.ln(1 - p))
    own = written(rows.groupBy(*keys, "x").agg(F.count("*").alias("n")).join(ic.select(*keys, "good"), keys), "shift-scores")

    # folds and profiles: counts and sums
    sums = lambda w: {"n": F.sum(w), "s": F.sum(w * F.col("x")), "q": F.sum(w * F.col("x") * F.col("x")), "h": F.sum(w * h)}
    fold = own.groupBy(*keys).agg(F.max("good").alias("good"), *[c.alias(f"own_{k}") for k, c in sums(F.col("n")).items()])
    every = fold.groupBy("profile").agg(F.count("*").alias("folds"), F.sum("good").alias("good_folds"), *[F.sum(f"own_{k}").alias(f"all_{k}") for k in "nsqh"], *[F.sum(F.col("good") * F.col(f"own_{k}")).alias(f"good_{k}") for k in "nsqh"])
    f = fold.join(every, "profile").withColumn("use_good", F.col("good_folds") - F.col("good") > 0)
    f = f.withColumn("sub", F.when(F.col("use_good"), F.col("good")).otherwise(1))
    f = f.withColumns({f"ref_{k}": F.when(F.col("use_good"), F.col(f"good_{k}")).otherwise(F.col(f"all_{k}")) - F.col("sub") * F.col(f"own_{k}") for k in "nsqh"})
    f = f.withColumn("ref_folds", F.when(F.col("use_good"), F.col("good_folds") - F.col("good")).otherwise(F.col("folds") - 1)).where("ref_n > 0")
    f = written(f, "shift-totals")  # a row a fold

    # running counts: of the profile's scores, good and all, and of the fold's own
    per_x = own.groupBy(*by, "x").agg(F.sum("n").alias("an"), F.sum(F.col("n") * F.col("good")).alias("gn"))
    grid = written(ranks.cumulative(per_x, by, [F.col("x")], {"ac": "an", "gc": "gn"}), "shift-grid")
    mine = ranks.cumulative(own, keys, [F.col("x")], {"cn": "n"}).drop("good")
    at = mine.join(grid, [*by, "x"]).join(f, keys)
    base = lambda all_, good: F.when(F.col("use_good"), F.col(good)).otherwise(F.col(all_))
    at = at.withColumn("upto", base("ac", "gc") - F.col("sub") * F.col("cn"))
    at = written(at.withColumn("below", F.col("upto") - (base("an", "gn") - F.col("sub") * F.col("n"))), "shift-own")

    # the fold's own distribution is constant between its scores, the others' rises: the largest gap is at a score or just before one
    gaps = F.greatest(F.abs(F.col("cn") / F.col("own_n") - F.col("upto") / F.col("ref_n")), F.abs((F.col("cn") - F.col("n")) / F.col("own_n") - F.col("below") / F.col("ref_n")))
    # ranks (from 1) of the others that quantiles lie between
    qs = {**{f"e{i}": i / bins for i in range(bins + 1)}, "p25": 0.25, "p75": 0.75}
    place = lambda q, up: (F.ceil if up else F.floor)(F.round((F.col("ref_n") - 1) * q, 9)).cast("long") + 1
    own_q = lambda q: F.max_by("x", F.when(F.col("cn") - F.col("n") < q, F.col("x")))
    own_place = lambda q, up: (F.ceil if up else F.floor)(F.round((F.col("own_n") - 1) * q, 9)).cast("long") + 1
    shifts = [F.sum(F.when(F.col("below") < place(q, up), F.col("n")).otherwise(0)).alias(f"{name}_{int(up)}") for name, q in qs.items() for up in (False, True)]
    quart = [own_q(own_place(q, up)).alias(f"own_{name}_{int(up)}") for name, q in (("p25", 0.25), ("p75", 0.75)) for up in (False, True)]
    g = at.groupBy(*keys).agg(F.max(gaps).alias("ks"), *shifts, *quart).join(f, keys)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(up).alias("up"), (place(q, up) + F.col("sub") * F.col(f"{name}_{int(up)}")).alias("k")) for name, q in qs.items() for up in (False, True)])
    asks = g.select(*keys, "use_good", F.explode(wanted).alias("w")).select(*keys, "use_good", "w.*")
    # all ranks asked of a profile, a few for each fold, meet each of its distinct scores
    listed = asks.groupBy("profile").agg(F.collect_list(F.struct("fold", "use_good", "name", "up", "k")).alias("asked"))
    hit = F.filter("asked", lambda a: F.when(a["use_good"], (a["k"] > F.col("gc") - F.col("gn")) & (a["k"] <= F.col("gc"))).otherwise((a["k"] > F.col("ac") - F.col("an")) & (a["k"] <= F.col("ac"))))
    found = grid.join(listed, "profile").select("profile", "x", F.explode(hit).alias("a")).select("profile", F.col("a.fold").alias("fold"), F.col("a.name").alias("name"), F.col("a.up").alias("up"), F.col("a.k").alias("k"), "x")
    lo, hi = (F.max(F.when(F.col("up") == up, F.col("x"))) for up in (False, True))
    ends = found.groupBy(*keys, "name").agg(lo.alias("lo"), hi.alias("hi")).join(f.select(*keys, "ref_n"), keys)
    q_of = F.element_at(F.create_map(*[F.lit(v) for kv in qs.items() for v in kv]), F.col("name"))
    spot = F.round((F.col("ref_n") - 1) * q_of, 9)
    values = written(ends.select(*keys, "name", (F.col("lo") + (spot - F.floor(spot)) * (F.col("hi") - F.col("lo"))).alias("v")), "shift-quantiles")

    # stability index: bins between the others' quantiles, open at both ends
    v_of = lambda name: F.max(F.when(F.col("name") == name, F.col("v")))
    cuts = values.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("name").startswith("e"), F.col("v")))).alias("edges"), (v_of("p75") - v_of("p25")).alias("ref_iqr"))
    limits = at.groupBy(*keys).agg(F.min("x").alias("own_lo"), F.max("x").alias("own_hi"))
    cuts = cuts.join(limits, keys)
    low, high = F.least(F.col("own_lo"), F.element_at("edges", 1)), F.greatest(F.col("own_hi"), F.element_at("edges", -1))
    even = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: low + i * (high - low) / bins)
    inner = F.when(F.size("edges") >= 3, F.slice("edges", F.lit(2), F.size("edges") - 2)).when(low < high, even).otherwise(F.array().cast("array<double>"))
    cuts = written(cuts.select(*keys, "ref_iqr", inner.alias("inner")), "shift-cuts")  # a row a fold
    own_bins = own.join(cuts, keys).groupBy(*keys, F.size(F.filter("inner", lambda e: e <= F.col("x"))).alias("bin")).agg(F.sum("n").alias("a"))
    # the others' count below an edge: the profile's, less the fold's own below it
    per_edge = cuts.select(*keys, F.posexplode("inner").alias("i", "e")).join(f.select(*keys, "use_good"), keys)
    edge_list = per_edge.groupBy("profile").agg(F.array_sort(F.collect_set("e")).alias("all_edges"))
    parts = grid.join(edge_list, "profile").groupBy("profile", F.size(F.filter("all_edges", lambda e: e <= F.col("x"))).alias("part"), "all_edges").agg(F.sum("an").alias("an"), F.sum("gn").alias("gn"))
    by_edge = parts.withColumn("e", F.explode(F.filter("all_edges", lambda e: F.array_position("all_edges", e) > F.col("part")))).groupBy("profile", "e").agg(F.sum("an").alias("a_below"), F.sum("gn").alias("g_below"))
    own_below = own_bins.select(*keys, F.col("bin"), "a")
    grid_bins = cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"), F.size("inner").alias("edges"))
    b = grid_bins.join(own_below, [*keys, "bin"], "left").fillna(0, ["a"])
    order = Window.partitionBy(*keys).orderBy("bin")  # a row a bin
    b = b.withColumn("own_upto", F.sum("a").over(order))
    edge_counts = per_edge.join(by_edge, ["profile", "e"], "left").select(*keys, F.col("i").alias("bin"), F.coalesce(F.when(F.col("use_good"), F.col("g_below")).otherwise(F.col("a_below")), F.lit(0)).alias("below"))
    b = b.join(edge_counts, [*keys, "bin"], "left").join(f.select(*keys, "sub", "own_n", "ref_n"), keys)
    upto = F.when(F.col("bin") == F.col("edges"), F.col("ref_n")).otherwise(F.col("below") - F.col("sub") * F.col("own_upto"))
    b = b.withColumn("ref_upto", upto).withColumn("e", F.col("ref_upto") - F.coalesce(F.lag("ref_upto").over(order), F.lit(0)))
    share = lambda c, n: F.greatest(F.col(c) / F.col(n), F.lit(1e-6))
    psi = b.groupBy(*keys).agg(F.sum((share("a", "own_n") - share("e", "ref_n")) * F.ln(share("a", "own_n") / share("e", "ref_n"))).alias("psi"))

    out = g.join(psi, keys).join(cuts.select(*keys, "ref_iqr"), keys).join(ic.select(*keys, "rank_ic"), keys)
    mean = lambda k: F.col(f"{k}_s") / F.col(f"{k}_n")
    std = lambda k: F.sqrt(F.greatest(F.lit(0.0), F.col(f"{k}_q") / F.col(f"{k}_n") - mean(k) * mean(k)))
    own_at = lambda name, q: F.col(f"own_{name}_0") + (F.round((F.col("own_n") - 1) * q, 9) - F.floor(F.round((F.col("own_n") - 1) * q, 9))) * (F.col(f"own_{name}_1") - F.col(f"own_{name}_0"))
    entropy = F.col("own_h") / F.col("own_n") - F.col("ref_h") / F.col("ref_n")
    issue = F.when(F.round("psi", 9) >= 0.25, "major_score_distribution_shift").when(F.round("ks", 9) >= 0.20, "large_score_distribution_ks_shift").when(F.round(F.abs(entropy), 9) >= 0.05, "score_uncertainty_shift").otherwise("monitor")
    low_ic = F.round("rank_ic", 12)
    return out.select(
        *keys,
        "rank_ic",
        F.when(low_ic < 0, "negative_rank_ic").when(low_ic < target, "below_target_rank_ic").otherwise("rank_ic_ok").alias("bucket"),
        F.when(F.col("use_good"), f"other_folds_rank_ic_ge_{target:.3f}").otherwise("all_other_folds").alias("reference"),
        "ref_folds",
        "ks",
        "psi",
        mean("own").alias("mean_prob"),
        mean("ref").alias("ref_mean_prob"),
        (mean("own") - mean("ref")).alias("mean_delta"),
        std("own").alias("prob_std"),
        F.try_divide(std("own"), std("ref")).alias("std_ratio"),
        (own_at("p75", 0.75) - own_at("p25", 0.25)).alias("iqr"),
        "ref_iqr",
        entropy.alias("entropy_delta"),
        issue.alias("issue"),
    )


def score_shift_summary(shift: DataFrame, target: float = 0.03) -> DataFrame:
    """One row a profile: whether its bad folds are those whose scores shift."""
    high = (F.round("psi", 9) >= 0.25) | (F.round("ks", 9) >= 0.20)
    bad = F.round("rank_ic", 12) < target
    g = shift.groupBy("profile").agg(
        F.count("*").alias("fold_count"),
        F.count_if(bad).alias("bad_fold_count"),
        *[f(c).alias(f"{n}_{c}") for c in ("ks", "psi") for n, f in (("mean", F.avg), ("max", F.max))],
        *[F.avg(F.when(bad if k == "bad" else ~bad, F.col("psi"))).alias(f"{k}_psi_mean") for k in ("bad", "good")],
        F.count_if(high).alias("high_shift_folds"),
        F.array_join(F.array_sort(F.collect_list(F.when(high, F.col("fold")))), ",").alias("high_shift_fold_ids"),
    )
    some = F.col("high_shift_folds") > 0
    issue = F.when(some & F.coalesce(F.round(F.col("bad_psi_mean") - F.col("good_psi_mean"), 9) > 0.05, F.lit(False)), "bad_folds_show_score_distribution_shift").when(some, "score_distribution_shift_not_specific_to_bad_folds").otherwise("monitor")
    return g.withColumn("issue", issue)
