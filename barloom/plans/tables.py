"""Domain tables derived from the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as ops
from barloom.operators import ranks

SYMBOLS = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % SYMBOLS).cast("string")).alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_id").alias("tick"),
        F.col("value").alias("price"),
        (1 + F.col("event_id") % 10).alias("size"),
        F.col("event_type").isin("click", "purchase").alias("is_buy"),
    )


def bars(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    return ops.build_bars(ticks(spark, sf_dir), seconds)


BUCKET = {3600: "date_trunc('hour', ts)", 900: "time_bucket(INTERVAL '15 minutes', ts)", 14400: "time_bucket(INTERVAL '4 hours', ts)"}


def bars_cte(name: str = "bars", seconds: int = 3600) -> str:
    return f"""{name} AS (
  SELECT symbol, {BUCKET[seconds]} AS ts, arg_min(price, (ts, tick)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick)) AS close,
    sum(size)::DOUBLE AS volume, sum(price * size) AS quote_volume, count(*) AS num_trades,
    sum(CASE WHEN is_buy THEN size ELSE 0 END)::DOUBLE AS taker_buy_base_vol, sum(CASE WHEN is_buy THEN price * size ELSE 0 END) AS taker_buy_quote_vol
  FROM (SELECT 'S' || (user_id % {SYMBOLS}) AS symbol, ts, event_id AS tick, value AS price, 1 + event_id % 10 AS size, event_type IN ('click', 'purchase') AS is_buy FROM events)
  GROUP BY ALL)"""


PROFILES = {"control": (7919, 104729, 1299709), "alpha": (6101, 50021, 99991), "beta": (3571, 7001, 15013)}


#: Columns of a prediction.
ORDER = ("profile", "row_pos", "fold", "split", "ts", "label", "prob_long", "forward_return", "regime_prob_0", "regime_prob_1", "regime_prob_2", "f_quantity", "f_price", "4h_tax")
#: What most reports use beside profile and score.
USED = ("row_pos", "fold", "split", "ts", "label", "forward_return")


def preds(spark: SparkSession, sf_dir: str, profiles: tuple[str, ...] = ("control",), only: tuple[str, ...] | None = None) -> DataFrame:
    """One prediction a (order, line) and profile: score, label, return, fold, split, regimes, features.

    only: the columns beside profile and score that a query uses several times; large tables are then kept as one
    row a line, from which the profiles' scores are made at each reading."""
    c = F.col
    # whether the least flag is R, without a string: Spark sorts all rows for the least of strings, and hashes them for numbers
    returned = F.max(c("l_returnflag") == "R") & ~F.max(c("l_returnflag") < "R")
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(x).alias(x) for x in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")], returned.alias("returned"))
    scores = F.array(*[F.struct(F.lit(p).alias("profile"), (((c("l_partkey") * a + c("l_suppkey") * b + c("l_linenumber") * d) % 10007) / F.lit(10006.0)).alias("prob_long")) for p, (a, b, d) in PROFILES.items() if p in profiles])
    near = [1 / (1 + F.abs(c("l_quantity") - m)) for m in (9, 25, 41)]
    whole = near[0] + near[1] + near[2]
    columns = [
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("row_pos"),
        (F.year("l_shipdate") - 1995).alias("fold"),
        F.when(c("l_linenumber") % 2 == 0, "val").otherwise("test").alias("split"),
        c("l_shipdate").cast("timestamp_ntz").alias("ts"),
        c("returned").cast("int").alias("label"),
        ((c("l_discount") - 0.05) / 10).alias("forward_return"),
        *[(x / whole).alias(f"regime_prob_{i}") for i, x in enumerate(near)],
        c("l_quantity").alias("f_quantity"), c("l_extendedprice").alias("f_price"), c("l_tax").alias("4h_tax"),
    ]
    lines = l.select("l_partkey", "l_suppkey", "l_linenumber", *columns)
    if only:
        lines = ranks.settled(lines.select("l_partkey", "l_suppkey", "l_linenumber", *only), "lines")
    own = [x for x in lines.columns if not x.startswith("l_")]
    out = lines.withColumn("s", F.explode(scores)).select("s.profile", *own, "s.prob_long")
    return out.select(*[x for x in ORDER if x in out.columns])


def preds_cte(profiles: tuple[str, ...] = ("control",)) -> str:
    scored = " UNION ALL ".join(f"SELECT '{p}' AS profile, (l_partkey * {a} + l_suppkey * {b} + l_linenumber * {d}) % 10007 / 10006.0::DOUBLE AS prob_long, * FROM li" for p, (a, b, d) in PROFILES.items() if p in profiles)
    return f"""li AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice,
    min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(l_returnflag) AS l_returnflag, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL),
preds AS (
  SELECT profile, l_orderkey * 8 + l_linenumber AS row_pos, (year(l_shipdate) - 1995)::INT AS fold, CASE WHEN l_linenumber % 2 = 0 THEN 'val' ELSE 'test' END AS split,
    l_shipdate AS ts, (l_returnflag = 'R')::INT AS label, prob_long, (l_discount - 0.05) / 10 AS forward_return,
    n0 / (n0 + n1 + n2) AS regime_prob_0, n1 / (n0 + n1 + n2) AS regime_prob_1, n2 / (n0 + n1 + n2) AS regime_prob_2,
    l_quantity AS f_quantity, l_extendedprice AS f_price, l_tax AS "4h_tax"
  FROM (SELECT *, 1 / (1 + abs(l_quantity - 9)) AS n0, 1 / (1 + abs(l_quantity - 25)) AS n1, 1 / (1 + abs(l_quantity - 41)) AS n2 FROM ({scored})))"""
