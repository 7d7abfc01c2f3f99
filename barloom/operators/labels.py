"""Forward-looking labels and walk-forward folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import safe_div


def triple_barrier(bars: DataFrame, atr: str, up: float = 2.0, down: float = 5.0, horizon: int = 10) -> DataFrame:
    """Long-only: the first of take-profit (close + up * atr), stop-loss (close - down * atr) and the
    horizon. Both in one bar count as the stop. Rows without `horizon` later bars or a positive atr go."""
    w = Window.partitionBy("symbol").orderBy("ts")
    ahead = F.collect_list(F.struct("pos", "high", "low", "close", "ts")).over(w.rowsBetween(1, horizon))
    tp, sl = F.col("close") + up * F.col(atr), F.col("close") - down * F.col(atr)
    b = bars.withColumns({"_ahead": ahead, "_tp": tp, "_sl": sl})
    b = b.where((F.size("_ahead") == horizon) & (F.col(atr) > 0))
    b = b.withColumn("_hit", F.get(F.filter("_ahead", lambda x: (x["high"] >= F.col("_tp")) | (x["low"] <= F.col("_sl"))), F.lit(0)))
    end = F.element_at("_ahead", -1)
    hit_tp, hit_sl = F.col("_hit.high") >= F.col("_tp"), F.col("_hit.low") <= F.col("_sl")
    kind = F.when(F.col("_hit").isNull(), "time").when(hit_tp & hit_sl, "both_sl_first").when(hit_sl, "sl").otherwise("tp")
    b = b.withColumn("hit_type", kind)
    exit_price = F.when(F.col("hit_type") == "time", end["close"]).when(F.col("hit_type") == "tp", F.col("_tp")).otherwise(F.col("_sl"))
    return b.withColumns({
        "label": (F.col("hit_type") == "tp").cast("int"),
        "exit_bar": F.coalesce("_hit.pos", end["pos"]).cast("long"),
        "exit_ts": F.coalesce("_hit.ts", end["ts"]),
        "tb_return": safe_div(exit_price - F.col("close"), F.col("close")),
    }).drop("_ahead", "_tp", "_sl", "_hit")


def forward_return(bars: DataFrame, horizon: int = 10) -> DataFrame:
    ahead = F.lead("close", horizon).over(Window.partitionBy("symbol").orderBy("ts"))
    return bars.withColumn(f"fwd_return_{horizon}h", safe_div(ahead, F.col("close")) - 1)


@dataclass(frozen=True)
class Folds:
    """Ranges of row numbers [lo, hi) of train, (purge), val, (embargo), test, moved on by step."""

    train: int
    val: int
    test: int
    step: int
    purge: int = 24
    embargo: int = 6

    def ranges(self) -> list[tuple[str, int, int]]:
        v, t = self.train + self.purge, self.train + self.purge + self.val + self.embargo
        return [("train", 0, self.train), ("val", v, v + self.val), ("test", t, t + self.test)]

    def number(self, rows: Column) -> Column:
        """How many whole folds rows have."""
        return F.greatest(F.floor((rows - self.ranges()[-1][2]) / self.step) + 1, F.lit(0)).cast("int")


def walk_forward(bars: DataFrame, folds: Folds, key: str = "symbol") -> DataFrame:
    """key, fold, role, lo, hi of every fold that a key's rows fill."""
    n = bars.groupBy(key).agg(F.count("*").alias("rows")).withColumn("n", folds.number(F.col("rows"))).where("n > 0")
    at = n.select(key, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("fold"))
    roles = F.array(*[F.struct(F.lit(role).alias("role"), (F.col("fold") * folds.step + lo).cast("long").alias("lo"), (F.col("fold") * folds.step + hi).cast("long").alias("hi")) for role, lo, hi in folds.ranges()])
    return at.select(key, "fold", F.explode(roles).alias("x")).select(key, "fold", "x.*")


def of_role(role: str):
    return lambda fold: F.struct(fold.alias("fold"), F.lit(role).alias("role"))


def with_folds(rows: DataFrame, folds: Folds, key: str = "symbol") -> DataFrame:
    """Each row (with pos, counted from 0 in its key) once for every fold and role that has it. The fold numbers of
    a row follow from its position: nothing is joined, whatever the number of folds."""
    last = folds.number(F.max("pos").over(Window.partitionBy(key)) + 1) - 1
    r = rows.withColumn("_last", last)
    spans = []
    for role, lo, hi in folds.ranges():
        first, end = F.greatest(F.floor((F.col("pos") - hi) / folds.step) + 1, F.lit(0)), F.least(F.floor((F.col("pos") - lo) / folds.step), F.col("_last"))
        of = F.when(first <= end, F.sequence(first.cast("int"), end.cast("int"))).otherwise(F.array().cast("array<int>"))
        spans.append(F.transform(of, of_role(role)))
    return r.withColumn("_x", F.explode(F.concat(*spans))).withColumns({"fold": F.col("_x.fold"), "role": F.col("_x.role")}).drop("_x", "_last")
