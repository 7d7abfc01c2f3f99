"""Exponentially weighted means, a recursion that windows cannot express.

y = (1 - a) y + a x from the first value on. A missing x keeps the weight decaying, so that
the next value counts as (1 - a)^gap against it; no value is given before `least` were seen.

A symbol's history is cut into chunks of time (see `chunks`). What a chunk does to the state that
enters it is one line of numbers, as the recursion is linear in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.chunks import CHUNK_SECONDS, Line, Values, carried


@dataclass
class State:
    """The mean so far (NaN before the first value), the weight it has against the next value, and values seen."""

    y: float = np.nan
    weight: float = 1.0
    seen: int = 0


def ewm_values(x: np.ndarray, alpha: float, least: int = 1, state: State | None = None) -> np.ndarray:
    """The recursion over x from a state, which is moved on."""
    s = state or State()
    out, y, weight, seen = np.full(len(x), np.nan), s.y, s.weight, s.seen
    for i, v in enumerate(x.tolist()):
        if v == v:
            y = v if y != y else (weight * y + alpha * v) / (weight + alpha)
            weight, seen = 1 - alpha, seen + 1
        elif y == y:
            weight *= 1 - alpha
        if seen >= least:
            out[i] = y
    s.y, s.weight, s.seen = y, weight, seen
    return out


def line(x: np.ndarray, alpha: float) -> tuple[int, int, float, float, float, float]:
    """What a chunk does to any state: (missing values before the first, values, the first, and with y the mean after
    the first: slope and offset of the last mean in y, weight at the end)."""
    at = np.flatnonzero(x == x)
    if not len(at):
        return len(x), 0, np.nan, 1.0, 0.0, 1.0
    slope, offset, weight = 1.0, 0.0, 1 - alpha
    for v in x[at[0] + 1 :].tolist():
        if v == v:
            keep = weight / (weight + alpha)
            slope, offset, weight = slope * keep, offset * keep + alpha * v / (weight + alpha), 1 - alpha
        else:
            weight *= 1 - alpha
    return int(at[0]), len(at), float(x[at[0]]), slope, offset, weight


def moved(s: State, alpha: float, lead: int, values: int, first: float, slope: float, offset: float, weight: float) -> State:
    """The state after a chunk."""
    own = s.weight * (1 - alpha) ** lead if s.y == s.y else s.weight
    if not values:
        return State(s.y, own, s.seen)
    y = first if s.y != s.y else (own * s.y + alpha * first) / (own + alpha)
    return State(slope * y + offset, weight, s.seen + values)


FIELDS = 6


def with_ewm(df: DataFrame, columns: dict[str, tuple[str, float, int]], key: str = "symbol", time: str = "ts", chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """df plus columns {name: (source, alpha, least)}, each the recursion over the key's rows in time order."""
    specs = list(columns.values())

    def lines(x: Values) -> Line:
        return [float(v) for source, alpha, _ in specs for v in line(x[source], alpha)]

    def states(state: Line | None, made: Line) -> Line:
        out = []
        for i, (_, alpha, _) in enumerate(specs):
            y, weight, seen = state[3 * i : 3 * i + 3] if state else (np.nan, 1.0, 0.0)
            lead, values, *rest = made[FIELDS * i : FIELDS * (i + 1)]
            s = moved(State(y, weight, int(seen)), alpha, int(lead), int(values), *rest)
            out += [float(s.y), float(s.weight), float(s.seen)]
        return out

    def filled(x: Values, state: Line | None) -> Values:
        out = {}
        for i, (name, (source, alpha, least)) in enumerate(columns.items()):
            y, weight, seen = state[3 * i : 3 * i + 3] if state else (np.nan, 1.0, 0.0)
            out[name] = ewm_values(x[source], alpha, least, State(y, weight, int(seen)))
        return out

    return carried(df, [source for source, *_ in specs], list(columns), lines, states, filled, key, time, chunk_seconds)


def adx(price: DataFrame, n: int = 14) -> DataFrame:
    """price (high, low, true_range, ...) plus plus_di, minus_di and adx: Wilder smoothing with alpha 1 / n."""
    from barloom.functions import windows as w
    from barloom.functions.scalars import safe_div

    up, down = F.col("high") - F.lag("high").over(w.ordered()), F.lag("low").over(w.ordered()) - F.col("low")
    moves = price.withColumns({"_up": F.when((up > down) & (up > 0), up).otherwise(0.0), "_down": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    a = 1.0 / n
    s = with_ewm(moves, {"_tr": ("true_range", a, n), "_p": ("_up", a, n), "_m": ("_down", a, n)})
    s = s.withColumns({"plus_di": 100 * safe_div(F.col("_p"), F.col("_tr")), "minus_di": 100 * safe_div(F.col("_m"), F.col("_tr"))})
    s = s.withColumn("_dx", 100 * safe_div(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return with_ewm(s, {"adx": ("_dx", a, n)}).drop("_up", "_down", "_tr", "_p", "_m", "_dx")
