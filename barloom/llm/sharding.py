"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard scores a key with -w / ln(u), u a hash of (key, shard) in (0, 1); the highest
score wins, so a shard gets keys in proportion to its weight, and a new shard takes keys only
into itself: no score of the old shards changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import text_of


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.lit(-float(weight)) / F.ln(u)


def place(key: Column, weights: list[float]) -> Column:
    """The shard of a key; a tie in score, which doubles make all but impossible, goes to the lower shard."""
    ranked = [F.struct(score(key, i, w).alias("score"), F.lit(-i).alias("rank")) for i, w in enumerate(weights)]
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    return (-best["rank"]).cast("int")


def numbered(df: DataFrame, group: str, order: list[str], buckets: int = 1024, slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 in each group, without any group in one task: rows are ordered by
    a hash bucket of the order columns, then by these; only group x bucket counts are summed up."""
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = bucketed.withColumn("_rank", F.row_number().over(within))
    # at most groups x buckets rows of 24 bytes: a bound that no input moves
    return ranked.join(F.broadcast(starts), [group, "_bucket"]).withColumn(slot, F.col("_start") + F.col("_rank") - 1).drop("_bucket", "_n", "_rank", "_start")


def shard_documents(docs: DataFrame, shards: int = 24, weights: list[float] | None = None, new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    A null text has size 8 and the checksum of empty text; null ids are one key like any other;
    repeated rows share a shard and get slots of their own; an empty table gives no rows; other
    columns are ignored."""
    weights = weights or [1.0] * shards
    key = F.col("doc_id")
    slim = docs.select(
        "doc_id",
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, weights).alias("shard"),
        place(key, [*weights, new_weight]).alias("grown_shard"),
    )
    return numbered(slim, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
