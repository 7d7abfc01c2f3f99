"""Running sums, ranks and quantile bins within keys, however many rows a key has.

Rows are dealt into ranges of (key, order) by Spark's range partitioning and written once. A range's sums and the
sums of a key's earlier ranges (at most as many rows as there are keys and ranges together) give each range what
stands before it; the rest is a window inside a range. No task holds a key, and rows that tie are summed up first
where their order does not matter. Tables of counts are written before they are ordered (`settled`): what decides
between a window and ranges is then their own size, not that of the rows they were counted from.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.shared import written

#: Inputs that Spark estimates to be smaller are ordered by plain windows: one task can hold a key of them.
LOCAL_BYTES = 64 << 20

UP = Window.unboundedPreceding


def ranges_for(df: DataFrame) -> int:
    """1 for a small input, else the session's shuffle partitions. Only the plan is looked at; results are the same."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 if size < LOCAL_BYTES else max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Steps of a plan that are worth keeping the results of; reading a table again costs less than writing it.
COSTLY = {"Aggregate", "Distinct", "Join", "Window", "Sort", "Repartition", "RepartitionByExpression", "MapInArrow", "MapInPandas", "FlatMapGroupsInArrow"}


def settled(df: DataFrame, name: str = "counts") -> DataFrame:
    """df, which is read several times; written first if Spark estimates it to be large and it is more than a table's
    rows and columns, so that it is made once and its size is known."""
    if ranges_for(df) == 1:
        return df
    steps = re.findall(r"^[\s:+-]*(\w+)", str(df._jdf.queryExecution().optimizedPlan()), re.MULTILINE)
    return written(df, name) if COSTLY & set(steps) else df


def same(by: list[str], prefix: str) -> Column:
    """Whether keys, null ones too, equal those named with a prefix."""
    return reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"{prefix}{b}")) for b in by], F.lit(True))


def cumulative(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str | Column], totals: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """df plus, for each of sums, the sum of its column over the key's rows up to this one in the order; and for each of
    totals (name -> a name of sums) the key's whole sum. A null counts as nothing; rows that tie in the order are
    taken one after another; null keys are keys."""
    totals = totals or {}
    n = ranges or ranges_for(df)
    value = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))
    if n == 1:
        upto, whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(UP, 0), Window.partitionBy(*by)
        out = {name: F.sum(value(c)).over(upto) for name, c in sums.items()}
        return df.withColumns(out | {name: F.sum(value(sums[of])).over(whole) for name, of in totals.items()})
    dealt = df.repartitionByRange(n, *[F.col(b) for b in by], *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    parts = dealt.groupBy(*by, "_range").agg(*[F.sum(value(c)).alias(f"_in_{name}") for name, c in sums.items()])
    earlier, key = Window.partitionBy(*by).orderBy("_range").rowsBetween(UP, -1), Window.partitionBy(*by)
    starts = parts.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col("_range").alias("_of_range"),
        *[F.coalesce(F.sum(f"_in_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums],
        *[F.sum(f"_in_{of}").over(key).alias(name) for name, of in totals.items()],
    )
    starts = written(starts, "range-starts")  # small, and known to be
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(UP, 0)
    local = dealt.withColumns({name: F.sum(value(c)).over(within) for name, c in sums.items()})
    met = local.join(starts, same(by, "_by_") & (F.col("_range") == F.col("_of_range"))).withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in sums})
    return met.select(*df.columns, *sums, *totals)


def numbered(df: DataFrame, by: list[str], order: list[Column], number: str, count: str, ranges: int | None = None) -> DataFrame:
    """df plus the row's number in its key from 1, and the key's rows."""
    return cumulative(df, by, order, {number: F.lit(1)}, {count: number}, ranges)


def value_ranks(df: DataFrame, by: list[str], x: str, ranges: int | None = None) -> DataFrame:
    """by, x, and for every distinct value: _rank (mean rank of its rows) and _all (rows of the key)."""
    counts = settled(df.groupBy(*by, x).agg(F.count("*").alias("_n")))
    ran = cumulative(counts, by, [F.col(x)], {"_upto": "_n"}, {"_all": "_upto"}, ranges)
    return ran.select(*by, x, (F.col("_upto") - (F.col("_n") - 1) / 2).alias("_rank"), "_all")


def average_rank(df: DataFrame, by: list[str], x: str, out: str, share: bool = False, ranges: int | None = None) -> DataFrame:
    """df plus the rank of x in its key, ties at their mean; with share, over the key's rows: in (0, 1].

    Small inputs take it from a window. Else ranks are those of distinct values, brought back to the rows by a join
    that Spark can split where a value is very common. A null ranks first, as in a window."""
    n = ranges or ranges_for(df)
    if n == 1:
        rank = F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2
        return df.withColumn(out, rank / F.count("*").over(Window.partitionBy(*by)) if share else rank)
    keys = [*by, x]
    ranked = written(value_ranks(df, by, x, ranges), "value-ranks").withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return df.join(ranked, same(keys, "_of_")).select(*[F.col(c) for c in df.columns if c != out], (F.col("_rank") / F.col("_all") if share else F.col("_rank")).alias(out))


def rank_sums(df: DataFrame, by: list[str], x: str, y: str, ranges: int | None = None) -> DataFrame:
    """by, n, and the sums of products of the mean ranks of x and y, less their means: xy, xx, yy. No row is ordered: y's
    ranks come from its distinct values, are added up over each distinct x, and the distinct x are ordered."""
    rows = settled(df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")), "rank-pairs")
    middle = (F.col("_all") + 1) / 2
    off = value_ranks(rows, by, "_y", ranges).select(*[F.col(k).alias(f"_of_{k}") for k in [*by, "_y"]], (F.col("_rank") - middle).alias("_off"))
    off = settled(off, "rank-offsets")
    per_x = rows.join(off, same([*by, "_y"], "_of_")).groupBy(*by, "_x").agg(F.count("*").alias("_n"), F.sum("_off").alias("_s"), F.sum(F.col("_off") * F.col("_off")).alias("_q"))
    ran = cumulative(settled(per_x), by, [F.col("_x")], {"_upto": "_n"}, {"_all": "_upto"}, ranges)
    d = F.col("_upto") - (F.col("_n") - 1) / 2 - middle
    return ran.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(d * F.col("_s")).alias("xy"), F.sum(F.col("_n") * d * d).alias("xx"), F.sum("_q").alias("yy"))


def bin_of(r: Column, q: int) -> Column:
    """The bin of the row that is the r-th of its key's _rows."""
    bins = F.least(F.lit(q), F.col("_rows"))
    return F.when(F.col("_rows") == 1, 0).otherwise(F.greatest(F.ceil((r - 1) * bins / (F.col("_rows") - 1)) - 1, F.lit(0))).cast("int")


def quantile_bin(df: DataFrame, order: list[Column], q: int, by: list[str], out: str = "bin", ranges: int | None = None) -> DataFrame:
    """df plus the equal-count bin of the first-come rank: bins are cut at linear quantiles of 1..n, as ntile does not.

    Large inputs are not ordered: the counts of the distinct values of the first order column give all rows of a value
    one bin, but for the few values that a cut goes through (under q a key), whose rows alone are numbered. df is read
    several times; only the columns that are needed should be in it."""
    of = lambda r: bin_of(r, q)
    if ranges or ranges_for(df) == 1 or len(order) < 2:
        return numbered(df, by, order, "_r", "_rows", ranges).withColumn(out, of(F.col("_r"))).drop("_r", "_rows")
    valued = df.withColumn("_v", order[0])
    counts = settled(valued.groupBy(*by, "_v").agg(F.count("*").alias("_n")))
    spans = cumulative(counts, by, [F.col("_v")], {"_upto": "_n"}, {"_rows": "_upto"})
    before = F.col("_upto") - F.col("_n")
    spans = spans.select(*[F.col(k).alias(f"_of_{k}") for k in [*by, "_v"]], "_rows", before.alias("_before"), of(before + 1).alias("_first"), of(F.col("_upto")).alias("_last"))
    met = valued.join(settled(spans, "value-bins"), same([*by, "_v"], "_of_"))
    whole = met.where("_first = _last").select(*df.columns, F.col("_first").alias(out))
    cut = settled(met.where("_first < _last").select(*df.columns, "_v", "_before", "_rows"), "cut-values")
    cut = cumulative(cut, [*by, "_v"], order[1:], {"_r": F.lit(1)}).withColumn(out, of(F.col("_before") + F.col("_r")))
    return whole.unionByName(cut.select(*df.columns, out))


def bin_sums(df: DataFrame, order: list[Column], q: int, by: list[str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """by, bin and, for each of sums, the sum of its column over the rows of the bin that `quantile_bin` gives them.

    Large inputs are summed up by the distinct values of the first order column: no row is joined or moved but those of
    the few values that a cut goes through (under q a key). df is read twice; only the columns that are needed should be in it."""
    total = [F.sum(name).alias(name) for name in sums]
    if (ranges or ranges_for(df)) == 1 or len(order) < 2:
        return quantile_bin(df, order, q, by, "bin", ranges).groupBy(*by, "bin").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    of = lambda r: bin_of(r, q)
    valued = df.withColumn("_v", order[0])
    counts = settled(valued.groupBy(*by, "_v").agg(F.count("*").alias("_n"), *[F.sum(c).alias(name) for name, c in sums.items()]))
    spans = cumulative(counts, by, [F.col("_v")], {"_upto": "_n"}, {"_rows": "_upto"}, ranges)
    before = F.col("_upto") - F.col("_n")
    spans = settled(spans.select(*by, "_v", "_rows", before.alias("_before"), of(before + 1).alias("_first"), of(F.col("_upto")).alias("_last"), *sums), "value-bins")
    whole = spans.where("_first = _last").withColumn("bin", F.col("_first"))
    cut = written(spans.where("_first < _last").select(*[F.col(k).alias(f"_of_{k}") for k in [*by, "_v"]], "_before", "_rows"), "cut-spans")  # under q a key
    rows = written(valued.join(cut, same([*by, "_v"], "_of_")).select(*df.columns, "_v", "_before", "_rows"), "cut-values")
    placed = cumulative(rows, [*by, "_v"], order[1:], {"_r": F.lit(1)}, ranges=ranges).withColumn("bin", of(F.col("_before") + F.col("_r")))
    parts = whole.select(*by, "bin", *sums).unionByName(placed.groupBy(*by, "bin").agg(*[F.sum(c).alias(name) for name, c in sums.items()]))
    return parts.groupBy(*by, "bin").agg(*total)
