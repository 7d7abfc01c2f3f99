"""Values of the training losses on scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def focal(p: Column, label: Column, gamma: float = 2.0, alpha: float = 0.6) -> Column:
    """Mean focal loss; p is clipped away from 0 and 1 by the caller."""
    return F.avg(F.when(label == 1, -alpha * F.pow(1 - p, F.lit(gamma)) * F.ln(p)).otherwise(-(1 - alpha) * F.pow(p, F.lit(gamma)) * F.ln(1 - p)))


def pairwise_margin(rows: DataFrame, by: list[str], batch: Column, margin: float = 0.25, logit: str = "_z", label: str = "label") -> DataFrame:
    """Mean over batches of the mean softplus(margin - (positive - negative)) of a batch's pairs; 0 for a batch with one
    class or under 3 rows. The loss is local to batches, so pairs are bounded by the batch, never by the fold."""
    of = lambda y: F.collect_list(F.when(F.col(label) == y, F.col(logit)))
    b = rows.groupBy(*by, batch.alias("_batch")).agg(of(1).alias("_p"), of(0).alias("_n"))
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    each = F.aggregate("_p", F.lit(0.0), lambda s, p: s + F.aggregate("_n", F.lit(0.0), lambda t, n: t + soft(margin - (p - n))))
    pairs = F.size("_p") * F.size("_n")
    value = F.when((F.size("_p") + F.size("_n") >= 3) & (pairs > 0), each / pairs).otherwise(0.0)
    return b.groupBy(*by).agg(F.avg(value).alias("margin"))


def loss_values(rows: DataFrame, by: list[str], batch: Column, ic_weight: float, margin_weight: float, score: str = "prob_long", label: str = "label", target: str = "forward_return") -> DataFrame:
    """by, focal, ic_loss (minus the correlation of score and return), margin, and their weighted sum."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    z = rows.withColumn("_z", F.ln(p / (1 - p)))
    g = z.groupBy(*by).agg(focal(p, F.col(label)).alias("focal"), (-F.corr(score, target)).alias("ic_loss"))
    g = g.join(pairwise_margin(z, by, batch, label=label), by)
    return g.withColumn("loss", F.col("focal") + ic_weight * F.col("ic_loss") + margin_weight * F.col("margin"))
