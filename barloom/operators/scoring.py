"""Walk-forward model scores, seeds, and permutation importance.

Each fold fits the scaler and a logistic regression on its train rows and scores val and test rows; all folds, and
all seeds of them, are one fit (`logistic`). The neural scorer of the original pipelines needs packages that are
not here; a regression on the same features stands in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import flag
from barloom.operators import logistic
from barloom.operators import metrics as m
from barloom.operators import ranks
from barloom.operators.labels import Folds, with_folds
from barloom.operators.reports import family, timeframe
from barloom.sources.shared import written


def robust_scaled(df: DataFrame, train: DataFrame, columns: list[str], by: str = "fold") -> DataFrame:
    """(x - median) / interquartile range of the train rows of the same `by`; a zero range divides by 1; missing becomes 0."""
    q = train.groupBy(by).agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}") for c in columns])
    at = lambda c, i: F.get(f"_q_{c}", F.lit(i))
    span = lambda c: F.coalesce(F.nullif(at(c, 2) - at(c, 0), F.lit(0.0)), F.lit(1.0))
    return df.join(q, by, "left").withColumns({c: F.coalesce((F.col(c) - at(c, 1)) / span(c), F.lit(0.0)) for c in columns}).drop(*[f"_q_{c}" for c in columns])


def walk_forward_scores(rows: DataFrame, folds: Folds, columns: list[str], label: str = "label", ridge: float = 0.01) -> DataFrame:
    """rows (with pos) of every fold's val and test ranges plus fold, split and prob_long: logistic regressions of all folds
    in one fit. Rows are placed and scaled once for all folds; a fold without both classes in training scores 0.5."""
    placed = with_folds(rows, folds)
    scaled = written(robust_scaled(placed, placed.where("role = 'train'"), columns), "scaled-rows")
    models = logistic.fit(scaled.where("role = 'train'"), ["fold"], columns, label, ridge=ridge).select("fold", "beta")  # a row a fold
    out = scaled.where("role <> 'train'").join(models, "fold", "left")
    prob = F.coalesce(logistic.probability(columns), F.lit(0.5))
    return out.select(*[c for c in rows.columns if c not in columns], "fold", F.col("role").alias("split"), prob.alias("prob_long"))


def seed_scores(rows: DataFrame, folds: Folds, columns: list[str], seeds: int, key: list[str], label: str = "label", ridge: float = 0.01) -> DataFrame:
    """walk_forward_scores of several seeds: each fits on a bootstrap of a fold's train rows, weights being Poisson numbers
    of a hash of the row's key and the seed, so that reruns agree. All folds and seeds are one fit."""
    placed = with_folds(rows, folds)
    scaled = written(robust_scaled(placed, placed.where("role = 'train'"), columns), "scaled-rows")
    each = F.explode(F.array(*[F.lit(s) for s in range(seeds)]))
    train = scaled.where("role = 'train'").withColumn("seed", each).withColumn("_times", logistic.poisson(key, F.col("seed"))).where("_times > 0")
    models = logistic.fit(train, ["fold", "seed"], columns, label, "_times", ridge).select("fold", "seed", "beta")
    out = scaled.where("role <> 'train'").withColumn("seed", each).join(models, ["fold", "seed"], "left")
    prob = F.coalesce(logistic.probability(columns), F.lit(0.5))
    return out.select(*[c for c in rows.columns if c not in columns], "fold", "seed", F.col("role").alias("split"), prob.alias("prob_long"))


def seed_audit(scores: DataFrame, key: list[str], returns: str) -> DataFrame:
    """Per fold: correlations of its seeds on test rows (mean, sample deviation, extremes) beside that of their mean score."""
    test = scores.where("split = 'test'")
    each = m.rank_ic(test, ["fold", "seed"], "prob_long", returns)
    g = each.groupBy("fold").agg(F.count("*").alias("seeds"), F.avg("rank_ic").alias("mean_ic"), F.stddev_samp("rank_ic").alias("std_ic"), F.min("rank_ic").alias("min_ic"), F.max("rank_ic").alias("max_ic"))
    mean = test.groupBy(*key, "fold").agg(F.avg("prob_long").alias("prob_long"), F.first(returns).alias(returns), F.stddev_samp("prob_long").alias("_spread"))
    spread = mean.groupBy("fold").agg(F.avg("_spread").alias("mean_seed_spread"))
    whole = m.rank_ic(mean, ["fold"], "prob_long", returns).select("fold", F.col("rank_ic").alias("ensemble_ic"))
    return g.join(whole, "fold").join(spread, "fold")


def permutation_importance(df: DataFrame, score, columns: list, by: list[str], repeats: int = 2, target: str = "forward_return", seed: int = 0) -> DataFrame:
    """Loss of rank correlation when a column's values are dealt out anew within each key.

    score: a function from a DataFrame to a Column. Values are matched by rank under a hash, so that reruns deal
    alike; columns in a tuple are moved together. A key's rows are numbered once by their place and once a repeat by
    the hash; a row meets what each repeat deals it, and only then becomes its variants, a column and repeat each."""
    groups = [(g,) if isinstance(g, str) else tuple(g) for g in columns]
    moved_columns = sorted({c for g in groups for c in g})
    df = ranks.settled(df, "importance-rows")
    base = m.rank_ic(df.withColumn("_s", score(df)), by, "_s", target).withColumnRenamed("rank_ic", "base_ic").drop("n")
    met = ranks.cumulative(df, by, [F.col("row_pos")], {"_i": F.lit(1)})
    for r in range(repeats):
        key = F.xxhash64("row_pos", F.lit(seed), F.lit(r))
        dealt = ranks.cumulative(df.select(*by, "row_pos", *moved_columns), by, [key, F.col("row_pos")], {"_i": F.lit(1)})
        dealt = dealt.select(*by, "_i", *[F.col(c).alias(f"_m{r}_{c}") for c in moved_columns])
        met = met.join(dealt, [*by, "_i"])
    met = ranks.settled(met, "importance-dealt")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.lit(r).alias("r")) for i in range(len(groups)) for r in range(repeats)]))
    mixed = met.withColumn("_v", each).withColumns({"_g": F.col("_v.g"), "_r": F.col("_v.r")}).drop("_v")
    takes = lambda c, r: F.col("_g").isin(*[i for i, g in enumerate(groups) if c in g]) & (F.col("_r") == r)
    for c in moved_columns:
        value = F.col(c)
        for r in range(repeats):
            value = F.when(takes(c, r), F.col(f"_m{r}_{c}")).otherwise(value)
        mixed = mixed.withColumn(c, value)
    ic = m.rank_ic(mixed.withColumn("_s", score(mixed)), [*by, "_g", "_r"], "_s", target).drop("n")
    drop = ic.join(base, by).withColumn("drop", F.col("base_ic") - F.col("rank_ic"))
    names = F.array(*[F.lit("+".join(g)) for g in groups])
    return drop.groupBy(*by, F.get(names, "_g").alias("feature")).agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("std_drop"))


def group_importance(importance: DataFrame, by: list[str]) -> DataFrame:
    """Importance of features by timeframe and family."""
    x = importance.withColumns({"timeframe": timeframe(F.col("feature")), "family": family(F.col("feature"))})
    v = F.col("mean_drop")
    return x.groupBy(*by, "timeframe", "family").agg(
        F.countDistinct("feature").alias("features"),
        F.count("*").alias("rows"),
        F.avg(v).alias("mean_rank_ic_drop"),
        F.percentile(v, 0.5).alias("median_rank_ic_drop"),
        F.min(v).alias("min_rank_ic_drop"),
        F.max(v).alias("max_rank_ic_drop"),
        F.avg(flag(v > 0)).alias("positive_drop_rate"),
        F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("total_positive_drop"),
    )
