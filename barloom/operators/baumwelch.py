"""Baum-Welch fits of many keys at once, each over all its rows, by chunks of time.

A round is three steps over tables. Every chunk is summed up to the product of its rows' matrices (`regime.filtered`
uses the same line); a key's products, one row a chunk, are run through forwards and backwards, which gives each
chunk the probabilities that enter it and the weights of what follows it; with these every chunk adds up its part
of the expectation: visits, moves, means and covariances by state. Their sums, one row a key, are the next model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import ranks
from barloom.operators.chunks import EPOCH
from barloom.operators.regime import FLOOR, RIDGE, Hmm, as_numbers, densities, from_numbers, normalised
from barloom.sources.shared import removed, written

NUMBERS = pa.list_(pa.float64())
CHUNK_SECONDS = 30 * 86400


def first_models(rows: DataFrame, columns: list[str], states: int, key: str, time: str) -> DataFrame:
    """key, model: states are quantile blocks of the first column, with the key's own covariance; keys of too few rows have none."""
    d = len(columns)
    n = ranks.numbered(rows, [key], [F.col(columns[0]), F.col(time)], "_r", "_n")
    size, more = F.floor(F.col("_n") / states), F.col("_n") % states
    r, large = F.col("_r") - 1, (F.floor(F.col("_n") / states) + 1) * (F.col("_n") % states)
    block = F.when(r < large, F.floor(r / (size + 1))).otherwise(more + F.floor((r - large) / size))
    cross = [(i, j) for i in range(d) for j in range(d)]
    mean = n.groupBy(key, block.alias("_b")).agg(F.max("_n").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)])
    mean = mean.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("_b", *[f"m{i}" for i in range(d)]))).alias("m"))  # a row a state
    cov = rows.groupBy(key).agg(*[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in cross])
    met = mean.where(F.col("n") >= 10 * states).join(cov, key)
    stay, move = F.lit(0.9), F.lit(0.1 / max(1, states - 1))
    numbers = [F.lit(float(states)), *[F.lit(1 / states)] * states, *[stay if i == j else move for i in range(states) for j in range(states)]]
    numbers += [F.get("m", F.lit(k))[f"m{i}"] for k in range(states) for i in range(d)]
    numbers += [F.col(f"c{i}_{j}") + (RIDGE if i == j else 0.0) for _ in range(states) for i, j in cross]
    return met.select(key, F.array(*[x.cast("double") for x in numbers]).alias("model"))


def product(h: Hmm, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a chunk does to the probabilities that enter it, and those that leave it if it starts afresh; at scale one."""
    p, first = np.eye(len(h.start)), normalised(h.start * b[0])
    for t in range(len(b)):
        p = p @ h.move * b[t]
        p /= p.max()
        if t:
            first = normalised(first @ h.move * b[t])
    return p, first


def expectation(h: Hmm, x: np.ndarray, b: np.ndarray, entering: np.ndarray | None, leaving: np.ndarray) -> list[float]:
    """A chunk's sums: the first row's probabilities (zero unless the key starts here), moves, visits, and first and second
    moments about the present means, by state."""
    n, k = b.shape
    al, be = np.empty_like(b), np.empty_like(b)
    for t in range(n):
        before = entering if t == 0 else al[t - 1]
        al[t] = normalised((h.start if before is None else before @ h.move) * b[t])
    be[-1] = leaving
    for t in range(n - 2, -1, -1):
        be[t] = normalised(h.move @ (b[t + 1] * be[t + 1]))
    g = al * be
    g /= g.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(n):
        before = entering if t == 0 else al[t - 1]
        if before is not None:
            xi = np.outer(before, b[t] * be[t]) * h.move
            pairs += xi / xi.sum()
    off = x[:, None, :] - h.means
    first = g[0] if entering is None else np.zeros(k)
    return [*first, *pairs.ravel(), *g.sum(axis=0), *np.einsum("tk,tkd->kd", g, off).ravel(), *np.einsum("tk,tki,tkj->kij", g, off, off).ravel()]


def maximised(h: Hmm, sums: np.ndarray) -> Hmm:
    k, d = h.means.shape
    first, pairs, w, m1, m2 = np.split(sums, np.cumsum([k, k * k, k, k * d]))
    w = np.maximum(w, FLOOR)
    off, pairs = m1.reshape(k, d) / w[:, None], pairs.reshape(k, k) + FLOOR
    covs = m2.reshape(k, d, d) / w[:, None, None] - off[:, :, None] * off[:, None, :] + RIDGE * np.eye(d)
    first = np.maximum(first, FLOOR)
    return Hmm(first / first.sum(), pairs / pairs.sum(axis=1, keepdims=True), h.means + off, covs)


def fit_by_key(df: DataFrame, columns: list[str], states: int = 3, rounds: int = 30, key: str = "symbol", time: str = "ts", chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """key, model (`regime.as_numbers`; states by their first column's mean) from all rows of each key. Missing inputs count as 0;
    keys of fewer than ten rows a state have no model. To fit by fold, make the fold part of the key."""
    clean = [F.coalesce(F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double")), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)]
    own = [f"x{i}" for i in range(len(columns))]
    chunk = F.floor(F.expr(f"timestampdiff(SECOND, {EPOCH}, cast(`{time}` as timestamp_ntz))") / chunk_seconds).cast("long")
    rows = written(df.select(key, time, chunk.alias("_chunk"), *clean), "hmm-rows")
    models = written(first_models(rows, own, states, key, time), "hmm-models")
    form = lambda *more: rows.select(key, "_chunk", *[F.lit(None).cast("array<double>").alias(c) for c in more]).schema

    def data(table: pa.Table) -> tuple[pa.Table, Hmm, np.ndarray, np.ndarray]:
        table = table.sort_by(time)
        h, x = from_numbers(np.array(table["model"][0].as_py())), np.column_stack([table[c].to_numpy() for c in own])
        return table, h, x, np.maximum(densities(h, x), 1e-300)

    def summed(table: pa.Table) -> pa.Table:
        table, h, _, b = data(table)
        p, first = product(h, b)
        return pa.table([table[key].slice(0, 1), table["_chunk"].slice(0, 1), pa.array([[*p.ravel(), *first]], NUMBERS)], names=[key, "_chunk", "_line"])

    def run_through(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        lines = [np.array(x) for x in table["_line"].to_pylist()]
        products = [x[: states * states].reshape(states, states) for x in lines]
        entering, at = [], None
        for p, x in zip(products, lines):
            entering.append(at)
            at = x[states * states :] if at is None else normalised(at @ p)
        leaving, after = [], np.full(states, 1 / states)
        for p in reversed(products):
            leaving.append(after)
            after = normalised(p @ after)
        made = [pa.array([None if x is None else x.tolist() for x in v], NUMBERS) for v in (entering, leaving[::-1])]
        return pa.table([table[key], table["_chunk"], *made], names=[key, "_chunk", "_entering", "_leaving"])

    def added(table: pa.Table) -> pa.Table:
        table, h, x, b = data(table)
        entering = table["_entering"][0].as_py()
        sums = expectation(h, x, b, None if entering is None else np.array(entering), np.array(table["_leaving"][0].as_py()))
        return pa.table([table[key].slice(0, 1), table["_chunk"].slice(0, 1), table["model"].slice(0, 1), pa.array([[float(v) for v in sums]], NUMBERS)], names=[key, "_chunk", "model", "_sums"])

    def next_model(table: pa.Table) -> pa.Table:
        h = maximised(from_numbers(np.array(table["model"][0].as_py())), np.array(table["_sums"].to_pylist()).sum(axis=0))
        return pa.table([table[key].slice(0, 1), pa.array([[float(v) for v in as_numbers(h)]], NUMBERS)], names=[key, "model"])

    modelled = rows.select(key, F.lit(None).cast("array<double>").alias("model")).schema
    for _ in range(rounds):
        met = rows.join(models, key)
        lines = met.groupBy(key, "_chunk").applyInArrow(summed, form("_line"))
        ends = lines.groupBy(key).applyInArrow(run_through, form("_entering", "_leaving"))
        sums = met.join(ends, [key, "_chunk"]).groupBy(key, "_chunk").applyInArrow(added, form("model", "_sums"))
        before, models = models, written(sums.groupBy(key).applyInArrow(next_model, modelled), "hmm-models")  # a row a chunk, then a key
        removed(before)

    def in_order(table: pa.Table) -> pa.Table:
        h = from_numbers(np.array(table["model"][0].as_py()))
        by = np.argsort(h.means[:, 0], kind="stable")
        return pa.table([table[key], pa.array([[float(v) for v in as_numbers(Hmm(h.start[by], h.move[np.ix_(by, by)], h.means[by], h.covs[by]))]], NUMBERS)], names=[key, "model"])

    return models.groupBy(key).applyInArrow(in_order, modelled)
