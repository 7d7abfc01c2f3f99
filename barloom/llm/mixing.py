"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is f times its size takes each document floor(f) times, and once more
with inclusion probability f - floor(f). The flight phase moves these probabilities along
null-space directions of two constraints (words and documents), so both totals keep their
expected values exactly until at most two documents a block are undecided. Blocks of one
source fly apart, on hash buckets of bounded size; what they leave undecided meets in blocks
of blocks, level by level, until each source has a single landing problem: the words it is
short of are taken from a part of its last one or two documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import saved, text_of

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK, FAN_IN = 4096, 1024
EPS = 1e-9


def word_count(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in the text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size, ...) plus rank (code point order, null last), weight and target.

    Target = min(level * weight, most * size) with the level at which targets sum to all sizes:
    what resharing the excess by weight ends in. Windows here run over one row a source."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    by_cap = Window.partitionBy(F.lit(0)).orderBy("_cap", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))) + 1)
    ranked = sources.withColumn("rank", F.row_number().over(in_order) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    total, capped = F.sum("source_size").over(whole), F.coalesce(F.sum("source_size").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * float(most)
    level = (total - capped) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    tried = ranked.withColumn("_level", level)
    settled = F.min(F.when(F.col("_level") <= F.col("_cap"), F.struct("_cap", "rank", "_level"))).over(whole)["_level"]
    return tried.withColumn("target", F.coalesce(F.least(settled * F.col("weight"), F.col("_cap") * F.col("weight")), F.lit(0.0))).drop("_cap", "_level")


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, last: bool = False) -> np.ndarray:
    """Move fractional pi to 0 or 1 while keeping sum(pi * size) and sum(pi); at most two stay fractional
    (one if last, which gives up the document total there)."""
    pi, active, at = pi.tolist(), [], 0
    size = size.astype(float).tolist()
    todo = [i for i, p in enumerate(pi) if EPS < p < 1 - EPS]
    draws = rng.random(len(todo) + 3)
    step = 0
    while True:
        while len(active) < 3 and at < len(todo):
            active.append(todo[at])
            at += 1
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and last:
            a, b = (size[i] for i in active)
            u = (b, -a) if a or b else (1.0, -1.0)
        else:
            break
        up = min(((1 - pi[i]) / v if v > 0 else -pi[i] / v) for i, v in zip(active, u, strict=True) if v)
        down = min((pi[i] / v if v > 0 else (pi[i] - 1) / v) for i, v in zip(active, u, strict=True) if v)
        move = up if draws[step] * (up + down) < down else -down
        step += 1
        left = []
        for i, v in zip(active, u, strict=True):
            p = pi[i] + move * v
            if p < EPS or p > 1 - EPS:
                pi[i] = float(round(p))
            else:
                pi[i] = p
                left.append(i)
        active = left
    for i in range(len(pi)):
        if pi[i] < EPS or pi[i] > 1 - EPS:
            pi[i] = float(round(pi[i]))
    return np.array(pi)


def _fly(level: int, last: bool, seed: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("tie", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        rng = np.random.default_rng([seed, level, key[0].as_py(), key[1].as_py()])
        pi = flight(table["pi"].to_numpy(), table["size"].to_numpy(), rng, last)
        return table.set_column(table.schema.get_field_index("pi"), "pi", pa.array(pi))

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (double: how often the mix takes the document), taken.

    A null text has size 0; null is a source of its own, last in order; a source without words
    has target 0; repeated rows are documents of their own; an empty table gives no rows; other
    columns are ignored unless named in keep. Reruns draw the same numbers."""
    sized = saved(docs.select("doc_id", "source", word_count(text_of()).alias("size"), F.xxhash64(text_of(), F.col("doc_id")).alias("tie"), *(keep or [])), "mix-sizes")
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most)
    by_source = saved(by_source.withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "mix-sources")
    blocks = by_source.agg(F.max("blocks")).first()[0] or 1
    rows = sized.join(by_source, sized["source"].eqNullSafe(by_source["source"])).drop(by_source["source"])
    # sizes below the rounding of doubles aside, f is at most `most`
    whole = F.floor(F.col("f") + EPS)
    rows = rows.select(
        "doc_id", "source", "size", "tie", *(keep or []), "rank", "source_size", "target", whole.cast("int").alias("times"),
        F.greatest(F.col("f") - whole, F.lit(0.0)).alias("pi"), F.pmod(F.col("tie"), F.col("blocks")).alias("block"),
    )
    done, level = [], 0
    while True:
        last = blocks <= 1
        flown = saved(rows.groupBy("rank", "block").applyInArrow(_fly(level, last, seed), rows.schema), f"mix-flight-{level}")
        if last:
            done.append(flown)
            break
        undecided = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(flown.where(~undecided))
        rows = flown.where(undecided).withColumn("block", F.floor(F.col("block") / FAN_IN))
        blocks, level = -(-blocks // FAN_IN), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.col("times") + F.col("pi")
    return out.select("doc_id", "source", "size", *(keep or []), "source_size", "target", copies.alias("copies"), F.round(copies * F.col("size")).cast("long").alias("taken"))
