"""Recursions and windows over a key's history by chunks.

A chunk is first summed up to a short line of numbers, side by side with all others; a key's lines are run
through in order, one row a chunk, which gives each chunk the state that enters it; then the chunks are
filled, side by side again. Windows that reach back a number of rows need no state: a chunk gets those rows as
guests (`in_chunks`). No task holds a key's whole history.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import ranks
from barloom.sources.shared import written

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
CHUNK_SECONDS = 365 * 86400

Values = dict[str, np.ndarray]
Line = list[float]


def carried(
    df: DataFrame,
    sources: list[str],
    outputs: list[str],
    line: Callable[[Values], Line],
    moved: Callable[[Line | None, Line], Line],
    filled: Callable[[Values, Line | None], Values],
    key: str,
    time: str,
    chunk_seconds: int = CHUNK_SECONDS,
    params: str | None = None,
) -> DataFrame:
    """df plus the outputs (doubles, NaN as NULL).

    params: a column of numbers (array of doubles), equal over a key, that the functions get as the values' "params"; the
    result has it no more.

    line: a chunk's values, in time order, to its line; moved: the state that leaves a chunk, from the one that
    enters it (None at first) and the chunk's line; filled: a chunk's outputs from its values and that state."""
    chunk = F.floor(F.expr(f"timestampdiff(SECOND, {EPOCH}, cast(`{time}` as timestamp_ntz))") / chunk_seconds).cast("long")
    cut = written(df.withColumn("_chunk", chunk), "chunks")  # read twice
    numbers = pa.list_(pa.float64())

    def values(table: pa.Table) -> Values:
        own = {c: table[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in sources}
        return own | ({"params": np.array(table[params][0].as_py(), float)} if params else {})

    def summed(table: pa.Table) -> pa.Table:
        made = line(values(table.sort_by(time)))
        return pa.table([table[key].slice(0, 1), table["_chunk"].slice(0, 1), pa.array([made], numbers)], names=[key, "_chunk", "_line"])

    def run_through(table: pa.Table) -> pa.Table:
        table, state, starts = table.sort_by("_chunk"), None, []
        for made in table["_line"].to_pylist():
            starts.append(state)
            state = moved(state, made)
        return pa.table([table[key], table["_chunk"], pa.array(starts, numbers)], names=[key, "_chunk", "_state"])

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        made = filled(values(table), table["_state"][0].as_py())
        for c in outputs:
            table = table.append_column(c, pa.array(made[c], from_pandas=True))
        return table.drop_columns(["_chunk", "_state", *([params] if params else [])])

    form = lambda c: cut.select(key, "_chunk", F.lit(None).cast("array<double>").alias(c)).schema
    lines = cut.select(key, time, "_chunk", *sorted({*sources, *([params] if params else [])} - {key, time})).groupBy(key, "_chunk").applyInArrow(summed, form("_line"))
    states = lines.groupBy(key).applyInArrow(run_through, form("_state"))
    schema = df.drop(*([params] if params else [])).select("*", *[F.lit(None).cast("double").alias(c) for c in outputs]).schema
    return cut.join(states, [key, "_chunk"]).select(*cut.columns, "_state").groupBy(key, "_chunk").applyInArrow(fill, schema)


#: Rows of a chunk of row-frame windows: a year of hourly bars.
CHUNK_ROWS = 8760


def in_chunks(
    df: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    before: int,
    after: int = 0,
    rows: int = CHUNK_ROWS,
    running: dict[str, Column] | None = None,
    key: str = "symbol",
    time: str | list[str] = "ts",
    ranges: int | None = None,
) -> DataFrame:
    """build(df), whose windows are over key in the order of time, with a key's rows dealt to chunks of `rows` rows.

    time: one column, or several where one alone leaves ties. Each chunk gets the `before` rows that precede it and the `after` rows that follow it as guests, which it sees but
    doesn't give back, so `before` must cover what the frames of build reach back to, nested ones added up. build takes
    the chunks for keys, and its result is the same for any chunk length but for columns that depend on all earlier
    rows: those are named in running (name -> what is summed up) and are the sums over the whole history."""
    if before > rows or after > rows:
        raise ValueError("a chunk must be as long as its guests reach")
    running = running or {}
    numbered = ranks.cumulative(df, [key], [F.col(c) for c in ([time] if isinstance(time, str) else time)], {"_pos": F.lit(1), **{f"_run_{c}": x for c, x in running.items()}}, ranges=ranges)
    at, place = F.col("_pos") - 1, F.pmod(F.col("_pos") - 1, F.lit(rows))
    own = F.floor(at / rows)
    homes = F.array_compact(F.array(own, F.when(place >= rows - before, own + 1) if before else F.lit(None).cast("long"), F.when((place < after) & (own > 0), own - 1) if after else F.lit(None).cast("long")))
    dealt = numbered.withColumn("_own", own).withColumn("_chunk", F.explode(homes))
    # to the windows of build a chunk is a key
    keyed = dealt.withColumn("_key", F.col(key)).withColumn(key, F.concat_ws("\x1f", F.col(key).cast("string"), F.col("_chunk").cast("string")))
    made = build(keyed).where(F.col("_chunk") == F.col("_own")).withColumn(key, F.col("_key"))
    made = made.withColumns({c: F.col(f"_run_{c}") for c in running})
    if "pos" in made.columns and "pos" not in df.columns:
        made = made.withColumn("pos", (F.col("_pos") - 1).cast(made.schema["pos"].dataType))
    return made.drop("_pos", "_own", "_chunk", "_key", *[f"_run_{c}" for c in running])
