"""As-of joins: each left row with the latest right row at or before it.

Both sides are stacked and cut into chunks of time; inside a chunk the last right row seen so far is the match.
What stands before a chunk comes from a scan over one row a chunk: the last right row of the key's earlier chunks.
Rows are shuffled once, by key and chunk; there is no range join and no task holds a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
CHUNK_SECONDS = 30 * 86400


def asof(left: DataFrame, right: DataFrame, by: str = "symbol", time: str = "ts", tolerance_seconds: int | None = None, prefix: str = "r_", chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """left plus right's columns, prefixed; NULL without a match, or one older than the tolerance (inclusive).

    The result is the same for any chunk length. A left row without a time matches nothing."""
    cols = [c for c in right.columns if c != by]
    packed = F.struct(*[F.col(c).alias(prefix + c) for c in cols])
    chunk = F.floor(F.expr(f"timestampdiff(SECOND, {EPOCH}, cast(`{time}` as timestamp_ntz))") / chunk_seconds).cast("long")
    stacked = left.withColumn("_side", F.lit(1)).unionByName(right.select(by, time, packed.alias("_right")).withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_chunk", chunk)
    # right before left at equal times
    w = Window.partitionBy(by, "_chunk").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = stacked.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    lasts = stacked.groupBy(by, "_chunk").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col(time))).alias("_last"))
    earlier = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    entering = lasts.select(F.col(by).alias("_by"), F.col("_chunk").alias("_of"), F.last("_last", ignorenulls=True).over(earlier).alias("_entering"))
    met = met.join(entering, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_chunk") == F.col("_of")), "left")
    met = met.withColumn("_right", F.coalesce("_right", "_entering"))
    if tolerance_seconds is not None:
        age = F.expr(f"timestampdiff(MICROSECOND, _right.`{prefix}{time}`, {time})")
        met = met.withColumn("_right", F.when(age <= tolerance_seconds * 1_000_000, F.col("_right")))
    return met.select(*left.columns, "_right.*")
