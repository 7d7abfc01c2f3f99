"""Ridge logistic regressions of many keys at once, by Newton steps.

A round is one aggregation by key: the gradient and the curvature of every key are sums of columns, taken JVM-side
with partial aggregation, whatever number of keys (folds, folds and seeds) there are. What is solved outside the
sums is one small system a key. The objective is that of MLlib's classifier with standardised features: mean log loss
plus half of ridge times the squares of the coefficients in units of the features' deviations; no ridge on the intercept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import finite
from barloom.sources.shared import removed, written

#: The longest Newton step of a coefficient, in deviations of its feature.
LONGEST = 5.0


def linear(columns: list[str], beta: str = "beta") -> Column:
    """The linear predictor; beta ends with the intercept."""
    return reduce(lambda a, b: a + b, [F.col(c).cast("double") * F.get(beta, F.lit(i)) for i, c in enumerate(columns)], F.get(beta, F.lit(len(columns))))


def probability(columns: list[str], beta: str = "beta") -> Column:
    return 1 / (1 + F.exp(-linear(columns, beta)))


def fit(train: DataFrame, by: list[str], columns: list[str], label: str = "label", weight: str | None = None, ridge: float = 0.01, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """by, beta (an array: a coefficient a column, then the intercept), steps, for every key that has both labels.

    Steps end when none is longer than tolerance (in deviations); as they converge quadratically, what is left is about
    its square. weight: how often a row counts (a column; 1 if none). Rows whose label, weight or a column is null or
    not finite don't count: one of them would leave its key no sums, and the solver fails on those."""
    p = len(columns)
    x = [F.col(f"x{i}") for i in range(p)] + [F.lit(1.0)]
    rows = train.select(*by, F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    rows = rows.withColumns({c: finite(F.col(c)) for c in rows.columns if c not in by})
    rows = written(rows.na.drop(subset=["y", "w", *[f"x{i}" for i in range(p)]]).where("w > 0"), "logistic-rows")
    w, y = F.col("w"), F.col("y")
    moments = [F.sum(w * c).alias(f"s{i}") for i, c in enumerate(x[:-1])] + [F.sum(w * c * c).alias(f"q{i}") for i, c in enumerate(x[:-1])]
    start = rows.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * y).alias("pos"), *moments).where("pos > 0 AND pos < n")
    var = [F.greatest(F.lit(0.0), (F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1.0))) for i in range(p)]
    state = start.select(*by, F.array(*var).cast("array<double>").alias("var"), F.array(*[F.lit(0.0)] * p, F.ln(F.col("pos") / (F.col("n") - F.col("pos")))).alias("beta"), F.lit(float("inf")).alias("step"), F.lit(0).alias("steps"))
    state = written(state, "logistic-state")  # a row a key
    pairs = list(combinations_with_replacement(range(p + 1), 2))
    schema = state.schema

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["var", "beta", "steps", "n", *[f"g{i}" for i in range(p + 1)], *[f"h{i}" for i in range(len(pairs))]]).to_pylist():
                beta, penalty = np.array(r["beta"]), ridge * np.append(r["var"], 0.0)
                h = np.zeros((p + 1, p + 1))
                for k, (i, j) in enumerate(pairs):
                    h[i, j] = h[j, i] = r[f"h{k}"] / r["n"]
                g = np.array([r[f"g{i}"] for i in range(p + 1)]) / r["n"] - penalty * beta
                move = np.linalg.lstsq(h + np.diag(penalty) + 1e-12 * np.eye(p + 1), g, rcond=None)[0]
                size = float(np.max(np.abs(move) * np.append(np.sqrt(r["var"]), 1.0)))
                move *= min(1.0, LONGEST / size) if size > 0 else 1.0
                out.append((beta + move, size, r["steps"] + 1))
            numbers = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), batch.column("var"), pa.array([o[0].tolist() for o in out], numbers), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.int32())], names=[*by, "var", "beta", "step", "steps"])

    for _ in range(rounds):
        met = rows.join(state.select(*by, "beta"), by)
        z = reduce(lambda a, b: a + b, [c * F.get("beta", F.lit(i)) for i, c in enumerate(x)])
        mu = 1 / (1 + F.exp(-z))
        met = met.withColumn("r", w * (y - mu)).withColumn("v", w * mu * (1 - mu))
        sums = met.groupBy(*by).agg(F.sum(w).alias("n"), *[F.sum(F.col("r") * c).alias(f"g{i}") for i, c in enumerate(x)], *[F.sum(F.col("v") * x[i] * x[j]).alias(f"h{k}") for k, (i, j) in enumerate(pairs)])
        before, state = state, written(state.drop("step").join(sums, by).mapInArrow(solve, schema), "logistic-state")
        removed(before)
        far = state.agg(F.max("step")).first()[0]  # one number
        if far is None or far < tolerance:
            break
    return state.select(*by, "beta", "steps")


def poisson(row: list[str], seed: Column) -> Column:
    """How often a row counts in a bootstrap of a seed: a Poisson number of mean one from a hash of the row and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(*row, seed), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    # chances of at most 0, 1, 2, ... of a Poisson number of mean one
    total, term, out = 0.0, np.exp(-1.0), F.lit(9)
    bounds = []
    for k in range(9):
        total += term
        bounds.append((k, float(total)))
        term /= k + 1
    for k, bound in reversed(bounds):
        out = F.when(u < bound, k).otherwise(out)
    return out
