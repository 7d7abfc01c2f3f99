"""Gaussian hidden Markov regimes: fitted per key, filtered forward only.

Fitting sees a bounded number of rows of each key, its first `train_rows`; filtering sees all rows, in order and by
chunks of time, and a row's probabilities depend on no later row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.chunks import CHUNK_SECONDS, Line, Values, carried
from barloom.sources.shared import written

FLOOR, RIDGE = 1e-12, 1e-6


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    covs: np.ndarray


def densities(h: Hmm, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(h.start)))
    for k in range(len(h.start)):
        c = h.covs[k] + RIDGE * np.eye(x.shape[1])
        d = x - h.means[k]
        out[:, k] = -0.5 * (np.einsum("ij,ij->i", d, np.linalg.solve(c, d.T).T) + np.linalg.slogdet(c)[1] + x.shape[1] * np.log(2 * np.pi))
    return np.exp(np.clip(out, -700, 700))


def floored(h: Hmm) -> tuple[np.ndarray, np.ndarray]:
    """Start and transition probabilities, none under FLOOR."""
    start, move = np.maximum(h.start, FLOOR), np.maximum(h.move, FLOOR)
    return start / start.sum(), move / move.sum(axis=1, keepdims=True)


def normalised(a: np.ndarray) -> np.ndarray:
    """a over its sum; uniform where that isn't a positive number."""
    total = a.sum()
    return a / total if np.isfinite(total) and total > 0 else np.full(len(a), 1 / len(a))


def forward_filter(h: Hmm, x: np.ndarray, entering: np.ndarray | None = None) -> np.ndarray:
    """P(state | rows so far), normalised at each row; entering: the probabilities before the first row, if not a fresh start."""
    b, (start, move) = np.maximum(densities(h, x), 1e-300), floored(h)
    out, a = np.empty_like(b), entering
    for t in range(len(x)):
        a = normalised((start if a is None else a @ move) * b[t])
        out[t] = a
    return out


def as_numbers(h: Hmm) -> list[float]:
    return [float(len(h.start)), *h.start, *h.move.ravel(), *h.means.ravel(), *h.covs.ravel()]


def from_numbers(x: np.ndarray) -> Hmm:
    k = int(x[0])
    d = int(round((-k + (k * k + 4 * k * (len(x) - 1 - k - k * k)) ** 0.5) / (2 * k)))
    at = np.cumsum([1, k, k * k, k * d])
    return Hmm(x[1 : at[1]], x[at[1] : at[2]].reshape(k, k), x[at[2] : at[3]].reshape(k, d), x[at[3] :].reshape(k, d, d))


def filtered(df: DataFrame, model: str, columns: list[str], states: int, key: str = "symbol", time: str = "ts", chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """df, but for the column model, plus regime_prob_0..: forward probabilities under the key's model (`as_numbers`), by
    chunks of time.

    The filter is linear but for its scale: a chunk is the product of its rows' matrices (transition, then densities),
    kept at scale one, and what it makes of a fresh start. Products are run through in order, one row a chunk, then the
    chunks are filled. A key starts afresh: to start afresh at each split, make the split part of the key. Missing inputs
    count as 0."""
    outputs = [f"regime_prob_{i}" for i in range(states)]

    def parts(x: Values) -> tuple[Hmm, np.ndarray]:
        return from_numbers(x["params"]), np.nan_to_num(np.column_stack([x[c] for c in columns]), nan=0.0, posinf=0.0, neginf=0.0)

    def line(x: Values) -> Line:
        h, data = parts(x)
        b, (start, move) = np.maximum(densities(h, data), 1e-300), floored(h)
        product, first = np.eye(states), start * b[0] / max((start * b[0]).sum(), 1e-300)
        for t in range(len(b)):
            product = product @ move * b[t]
            product /= product.max()
            if t:
                first = normalised(first @ move * b[t])
        return [*product.ravel().tolist(), *first.tolist()]

    def moved(state: Line | None, made: Line) -> Line:
        product, first = np.array(made[: states * states]).reshape(states, states), made[states * states :]
        return first if state is None else normalised(np.array(state) @ product).tolist()

    def filled(x: Values, state: Line | None) -> Values:
        h, data = parts(x)
        p = forward_filter(h, data, None if state is None else np.array(state))
        return {c: p[:, i] for i, c in enumerate(outputs)}

    return carried(df, columns, outputs, line, moved, filled, key, time, chunk_seconds, model)


@dataclass(frozen=True)
class Weights:
    """How far the weight of a state may fall before its mean and covariance are restored."""

    gamma_floor: float = 0.02
    least_share: float = 0.08
    most_ratio: float = 15.0


def online_step(n: np.ndarray, gamma: np.ndarray, limits: Weights) -> tuple[np.ndarray, list[int]]:
    """State weights after one row, and the states that are restored to the fitted means and covariances: those under
    the least share, whose weight is raised to it."""
    own = np.maximum(gamma, limits.gamma_floor)
    n = n + own / own.sum()
    total = n.sum()
    starving = np.flatnonzero(n / total < limits.least_share)
    if n.max() / max(n.min(), FLOOR) <= limits.most_ratio and not len(starving):
        return n, []
    n[starving] = np.maximum(n[starving], total * limits.least_share)
    return n, starving.tolist()


def online_weights(df: DataFrame, states: int, limits: Weights = Weights(), key: str = "symbol", time: str = "ts") -> DataFrame:
    """df (key, time, regime_prob_0..) plus state_weight_0.., bars_since_start and restored (the states, joined by commas).

    The recursion is not linear, so a key's rows go through one task in order, batch by batch: what a task holds is one
    batch and a weight a state. `streaming.bars.stream_weights` is the same on a stream."""
    probs = [f"regime_prob_{i}" for i in range(states)]
    schema = df.select("*", *[F.lit(0.0).alias(f"state_weight_{i}") for i in range(states)], F.lit(0).cast("long").alias("bars_since_start"), F.lit("").alias("restored")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, seen = object(), np.ones(states), 0
        for batch in batches:
            weights, counts, restored = np.empty((batch.num_rows, states)), [], []
            gammas = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in probs])
            for i, own in enumerate(batch.column(key).to_pylist()):
                if own != last:
                    last, n, seen = own, np.ones(states), 0
                n, states_ = online_step(n, gammas[i], limits)
                seen += 1
                weights[i] = n
                counts.append(seen)
                restored.append(",".join(map(str, states_)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(w) for w in weights.T.copy()), pa.array(counts, pa.int64()), pa.array(restored)], names=schema.names)

    return df.repartition(F.col(key)).sortWithinPartitions(key, time).mapInArrow(run, schema)


def fit(x: np.ndarray, states: int = 3, rounds: int = 30, seed: int = 0) -> Hmm:
    """Baum-Welch with full covariances, from quantile blocks of the first column; states are ordered by its mean."""
    order = np.array_split(np.argsort(x[:, 0], kind="stable"), states)
    cov = np.atleast_2d(np.cov(x.T)) + RIDGE * np.eye(x.shape[1])
    h = Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1)), np.array([x[i].mean(axis=0) for i in order]), np.array([cov] * states))
    for _ in range(rounds):
        b = np.maximum(densities(h, x), 1e-300)
        al, sc = np.empty_like(b), np.empty(len(x))
        for t in range(len(x)):
            a = (h.start if t == 0 else al[t - 1] @ h.move) * b[t]
            sc[t] = a.sum()
            al[t] = a / sc[t]
        be = np.ones_like(b)
        pairs = np.zeros((states, states))
        for t in range(len(x) - 2, -1, -1):
            be[t] = h.move @ (b[t + 1] * be[t + 1]) / sc[t + 1]
            pairs += np.outer(al[t], b[t + 1] * be[t + 1]) * h.move / sc[t + 1]
        g = al * be
        g /= g.sum(axis=1, keepdims=True)
        w = np.maximum(g.sum(axis=0), FLOOR)
        means = g.T @ x / w[:, None]
        covs = np.array([((x - means[k]) * g[:, k : k + 1]).T @ (x - means[k]) / w[k] + RIDGE * np.eye(x.shape[1]) for k in range(states)])
        h = Hmm(np.maximum(g[0], FLOOR) / np.maximum(g[0], FLOOR).sum(), (pairs + FLOOR) / (pairs + FLOOR).sum(axis=1, keepdims=True), means, covs)
    by = np.argsort(h.means[:, 0], kind="stable")
    return Hmm(h.start[by], h.move[np.ix_(by, by)], h.means[by], h.covs[by])


def fitted(df: DataFrame, columns: list[str], train_rows: int, states: int = 3, key: str = "symbol", time: str = "ts") -> DataFrame:
    """key, model: one fit a key on its first train_rows rows, as `as_numbers`; a key with too few rows has equal states."""
    schema = df.select(key, F.lit(None).cast("array<double>").alias("model")).schema
    first = Window.partitionBy(key).orderBy(time)
    train = df.select(key, time, *columns).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= train_rows).drop("_n")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        x = np.nan_to_num(np.column_stack([table[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]), nan=0.0, posinf=0.0, neginf=0.0)
        d = len(columns)
        h = fit(x, states) if len(x) >= 10 * states else Hmm(np.full(states, 1 / states), np.full((states, states), 1 / states), np.zeros((states, d)), np.array([np.eye(d)] * states))
        return pa.table([table[key].slice(0, 1), pa.array([as_numbers(h)], pa.list_(pa.float64()))], names=[key, "model"])

    return train.groupBy(key).applyInArrow(run, schema)


def with_regimes(df: DataFrame, columns: list[str], train_rows: int, states: int = 3, key: str = "symbol", time: str = "ts", chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """df plus regime_prob_0..: fitted on each key's first train_rows rows, filtered over all of them. Missing inputs count as 0."""
    models = written(fitted(df, columns, train_rows, states, key, time), "regime-models")  # a row a key
    return filtered(df.join(models, key), "model", columns, states, key, time, chunk_seconds)
