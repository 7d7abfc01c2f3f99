"""Evaluation metrics of scored rows, grouped by any keys.

The input is one table of predictions (keys, score, label, forward_return, ...). Curves are
taken over distinct scores: rows are first summed by score, so what is ordered in a window is
at most the distinct scores of a group, however many rows share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import flag
from barloom.operators import ranks


def rank_ic(df: DataFrame, by: list[str], x: str = "prob_long", y: str = "forward_return", least: int = 3, undefined: float | None = 0.0) -> DataFrame:
    """Spearman correlation with mean ranks of ties; `undefined` (0, or None for NULL) for fewer than `least` rows or a constant side."""
    r = ranks.rank_sums(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, y)
    spread = (F.col("xx") > 0) & (F.col("yy") > 0) & (F.col("n") >= least)
    ic = F.when(spread, F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0)))
    return r.select(*by, F.coalesce(ic, F.lit(undefined).cast("double")).alias("rank_ic"), "n")


def at_threshold(score: str, label: str, threshold: Column) -> dict[str, Column]:
    """Confusion counts and their ratios (0 where undefined) as aggregates."""
    p, y = flag(F.col(score) >= threshold) == 1, F.col(label) == 1
    tp, fp, fn, tn = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & y), F.count_if(~p & ~y)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "pred_rate": ratio(tp + fp, F.count("*"))}


def score_steps(df: DataFrame, by: list[str], score: str = "prob_long", label: str = "label", returns: str | None = None) -> DataFrame:
    """Per distinct score, descending: n and pos of it, cumulative cn and cpos, totals all_n and all_pos.

    With returns, also cumulative sums (cret) and counts (crets) of that column. Thresholds, curves and confusion
    counts all follow from this table: no other pass over the rows is needed."""
    return steps_of_counts(ranks.settled(score_counts(df, by, score, label, returns)), by)


def score_counts(df: DataFrame, by: list[str], score: str = "prob_long", label: str = "label", returns: str | None = None) -> DataFrame:
    """Per distinct score (threshold): its rows n and longs pos; with returns, also their sum and count (ret, rets)."""
    aggs = [F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")]
    if returns:
        aggs += [F.sum(returns).alias("ret"), F.count(returns).alias("rets")]
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(*aggs)


def steps_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """score_steps from score_counts of the same keys or more: counts of the others are added up."""
    own = [c for c in ("n", "pos", "ret", "rets") if c in counts.columns]
    if set(counts.columns) != {*by, "threshold", *own}:
        counts = ranks.settled(counts.groupBy(*by, "threshold").agg(*[F.sum(c).alias(c) for c in own]))
    return ranks.cumulative(counts, by, [F.desc("threshold")], {f"c{c}": c for c in own}, {"all_n": "cn", "all_pos": "cpos"})


def average_precision(df: DataFrame, by: list[str], score: str = "prob_long", label: str = "label") -> DataFrame:
    """Step area under precision and recall; 0 if a class is missing."""
    return average_precision_of(score_steps(df, by, score, label), by)


def average_precision_of(steps: DataFrame, by: list[str]) -> DataFrame:
    gain = F.sum(F.col("pos") / F.col("all_pos") * F.col("cpos") / F.col("cn"))
    one = (F.max("all_pos") == 0) | (F.max("all_pos") == F.max("all_n"))
    return steps.where("all_pos > 0").groupBy(*by).agg(F.when(one, 0.0).otherwise(gain).alias("average_precision"))


def at_rank(k: Column, value: Column | None = None) -> Column:
    """Over a key's steps: the score (or another value) of the row with the k-th largest score, as an aggregate."""
    covers = (F.col("cn") - F.col("n") < k) & (k <= F.col("cn"))
    return F.max(F.when(covers, F.col("threshold") if value is None else value))


def quantile_of(q: float) -> Column:
    """Over a key's steps: the linear quantile of its rows' scores, as an aggregate that holds no list of scores."""
    at = (F.col("all_n") - 1) * F.lit(q)
    low, high = at_rank(F.col("all_n") - F.floor(at)), at_rank(F.col("all_n") - F.ceil(at))
    return low + (F.max(at) - F.floor(F.max(at))) * (high - low)


def f1_of(pos: Column, n: Column, all_pos: Column) -> Column:
    return F.round(F.coalesce(F.try_divide((2 * pos).cast("double"), (n + all_pos).cast("double")), F.lit(0.0)), 12)


def best_f1(df: DataFrame, by: list[str], score: str = "prob_long", label: str = "label") -> DataFrame:
    """The threshold of the largest F1; the lowest such threshold. With one class alone, the median score."""
    return best_of(score_steps(df, by, score, label), by)


def best_of(steps: DataFrame, by: list[str]) -> DataFrame:
    """best_f1 from a table of score steps."""
    s = steps.withColumn("f1", f1_of(F.col("cpos"), F.col("cn"), F.col("all_pos")))
    middle = F.floor((F.col("all_n") + 1) / 2)
    g = s.groupBy(*by).agg(
        F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("m"),
        quantile_of(0.5).alias("median"),
        at_rank(middle, F.col("cn")).alias("cn"),
        at_rank(middle, F.col("cpos")).alias("cpos"),
        F.max("all_pos").alias("all_pos"),
        F.max("all_n").alias("all_n"),
    )
    one = (F.col("all_pos") == 0) | (F.col("all_pos") == F.col("all_n"))
    return g.select(*by, F.when(one, F.col("median")).otherwise(-F.col("m.t")).alias("threshold"), F.when(one, f1_of(F.col("cpos"), F.col("cn"), F.col("all_pos"))).otherwise(F.col("m.f1")).alias("f1"))


def constrained_f1(df: DataFrame, by: list[str], most_rate: float, least_precision: float, score: str = "prob_long", label: str = "label") -> DataFrame:
    """The largest F1 with a prediction rate in (0, most_rate] and a precision of at least least_precision;
    ties by precision, lower rate, higher threshold. The unconstrained best, with the reason, where none qualifies.
    A threshold between scores, such as 0.5, predicts what the next score does, and the higher one wins the tie."""
    return constrained_of(score_steps(df, by, score, label), by, F.lit(most_rate), least_precision)


def constrained_of(steps: DataFrame, by: list[str], most_rate: Column, least_precision: float) -> DataFrame:
    """constrained_f1 from a table of score steps; most_rate may be one of its columns."""
    s = steps.withColumns({"f1": f1_of(F.col("cpos"), F.col("cn"), F.col("all_pos")), "precision": F.round(F.col("cpos") / F.col("cn"), 12), "rate": F.col("cn") / F.col("all_n")})
    ok = s.where((F.col("rate") <= most_rate) & (F.col("precision") >= least_precision))
    top = ok.groupBy(*by).agg(F.max(F.struct("f1", "precision", (-F.col("rate")).alias("r"), "threshold")).alias("m"))
    plain = best_of(steps, by).withColumnRenamed("threshold", "t0").withColumnRenamed("f1", "f0")
    return plain.join(top, by, "left").select(*by, F.coalesce("m.threshold", "t0").alias("threshold"), F.coalesce("m.f1", "f0").alias("f1"), F.col("m").isNotNull().alias("constrained"), F.when(F.col("m").isNull(), "no_threshold_satisfies_pred_rate_precision").otherwise("").alias("reject_reason"))


def at_steps(steps: DataFrame, thresholds: DataFrame, by: list[str], names: dict[str, str | Column]) -> DataFrame:
    """What thresholds make of the rows behind a table of score steps: by, rows, base_rate, and for each name
    tp, n, f1, precision, recall, pred_rate and, if the steps have returns, mean_return, all with _name.

    thresholds: one row a key; names -> its column or an expression."""
    has_returns = "cret" in steps.columns
    kept = ["cn", "cpos", *(["cret", "crets"] if has_returns else [])]
    aggs = [F.max("all_n").alias("rows"), F.max("all_pos").alias("_pos")]
    for name, t in names.items():
        # cn grows as scores fall, so that the largest is that of the last score at or above the threshold
        aggs.append(F.max(F.when(F.col("threshold") >= F.col("_t_" + name), F.struct(*kept))).alias("_at_" + name))
    own = thresholds.select(*by, *[(F.col(t) if isinstance(t, str) else t).cast("double").alias("_t_" + name) for name, t in names.items()])
    g = steps.join(own, by).groupBy(*by).agg(*aggs)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = [*by, "rows", ratio(F.col("_pos"), F.col("rows")).alias("base_rate")]
    for name in names:
        n, tp = F.coalesce(F.col(f"_at_{name}.cn"), F.lit(0)), F.coalesce(F.col(f"_at_{name}.cpos"), F.lit(0))
        made = {"tp": tp, "n": n, "f1": ratio(2 * tp, n + F.col("_pos")), "precision": ratio(tp, n), "recall": ratio(tp, F.col("_pos")), "pred_rate": ratio(n, F.col("rows"))}
        if has_returns:
            made["mean_return"] = F.try_divide(F.col(f"_at_{name}.cret"), F.col(f"_at_{name}.crets"))
        out += [x.alias(f"{k}_{name}") for k, x in made.items()]
    return g.select(*out)


def ks(df: DataFrame, by: list[str], x: str, is_a: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of x between rows where is_a holds and the others; NULL without rows of both."""
    v = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count_if(is_a).alias("a"), F.count_if(~is_a).alias("b"))
    v = ranks.cumulative(ranks.settled(v), by, [F.col(x)], {"_ca": "a", "_cb": "b"}, {"_ta": "_ca", "_tb": "_cb"})
    gap = F.abs(F.try_divide(F.col("_ca"), F.col("_ta")) - F.try_divide(F.col("_cb"), F.col("_tb")))
    return v.withColumn("gap", gap).groupBy(*by).agg(F.max("gap").alias("ks"))


def ks_of(steps: DataFrame, by: list[str]) -> DataFrame:
    """ks of the scores of longs and others, from a table of score steps."""
    share = F.try_divide(F.col("cpos"), F.col("all_pos")) - F.try_divide(F.col("cn") - F.col("cpos"), F.col("all_n") - F.col("all_pos"))
    return steps.groupBy(*by).agg(F.max(F.abs(share)).alias("ks"))


def psi(df: DataFrame, by: list[str], x: str, is_expected: Column, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index over bins cut at the expected rows' quantiles; empty bins count eps."""
    qs = [i / bins for i in range(1, bins)]
    e = df.where(is_expected).groupBy(*by).agg(F.array_distinct(F.percentile(x, F.array(*[F.lit(q) for q in qs]))).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    # where quantiles all but coincide, bins of equal width
    equal = F.array(*[F.col("lo") + q * (F.col("hi") - F.col("lo")) for q in qs])
    edges = e.select(*by, F.when((F.size("q") < 2) & (F.col("hi") > F.col("lo")), equal).otherwise(F.col("q")).alias("edges"))
    at = df.join(edges, by).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(x))))
    n = at.groupBy(*by, "bin").agg(F.count_if(is_expected).alias("e"), F.count_if(~is_expected).alias("a"))
    grid = edges.select(*by, F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    w_ = Window.partitionBy(*by)
    g = grid.join(n, [*by, "bin"], "left").fillna(0, ["e", "a"])
    share = lambda c: F.greatest(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(w_)), F.lit(0.0)), F.lit(eps))
    e, a = share("e"), share("a")
    return g.withColumn("t", (a - e) * F.ln(a / e)).groupBy(*by).agg(F.sum("t").alias("psi"))


def calibration_bins(df: DataFrame, by: list[str], bins: int = 10, score: str = "prob_long", label: str = "label") -> DataFrame:
    """Equal-width bins (a, b] of [0, 1], the lowest closed: count, mean score and rate."""
    b = F.greatest(F.ceil(F.col(score) * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_prob"), F.avg(label).alias("rate"))


def calibration_table(df: DataFrame, by: list[str], bins: int = 10, score: str = "prob_long", label: str = "label", tie: str = "row_pos") -> DataFrame:
    """Equal-count bins of the first-come rank of the score: count, mean score and rate."""
    whole = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    b = ranks.quantile_bin(ranks.settled(whole.select(*by, score, label, tie), "calibration-rows"), [F.col(score), F.col(tie)], bins, by)
    return b.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_prob"), F.avg(label).alias("rate"))


def calibration_error(df: DataFrame, by: list[str], bins: int = 10, score: str = "prob_long", label: str = "label", equal_count: bool = False) -> DataFrame:
    """Expected and maximum calibration error, over bins of equal width or of equal count."""
    c = (calibration_table if equal_count else calibration_bins)(df, by, bins, score, label).withColumn("gap", F.abs(F.col("mean_prob") - F.col("rate")))
    return c.groupBy(*by).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def probability_quality(score: str = "prob_long", label: str = "label") -> dict[str, Column]:
    """Brier score, log loss, entropy, sharpness and spread as aggregates."""
    p, y = F.col(score), F.col(label).cast("double")
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return {
        "brier": F.avg((p - y) * (p - y)),
        "log_loss": F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))),
        "entropy": F.avg(-(q * F.ln(q) + (1 - q) * F.ln(1 - q))),
        "sharpness": F.avg(p * (1 - p)),
        "prob_std": F.stddev_pop(p),
    }


def dominant(prefix: str, n: int) -> Column:
    """Number of the largest of prefix0..n-1; the first wins ties."""
    a = F.array(*[F.col(f"{prefix}{i}") for i in range(n)])
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def bands_of(df: DataFrame, by: list[str], bins: int, bands: list[tuple[str, int, int]], score: str = "prob_long", tie: str = "row_pos") -> DataFrame:
    """Rows once for each score band (name, low bin, high bin) that has their quantile bin."""
    binned = ranks.quantile_bin(ranks.settled(df, "band-rows"), [F.col(score), F.col(tie)], bins, by)
    of = F.filter(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, a, b in bands]), lambda x: (F.col("bin") >= x["lo"]) & (F.col("bin") <= x["hi"]))
    return binned.withColumn("_b", F.explode(of)).withColumn("band", F.col("_b.band")).drop("_b")
