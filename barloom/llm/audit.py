"""Filter interaction audit: what each filter removes in every order of filters, from a packed bitmap index.

Each partition holds its rows as bitsets, one for each filter and label; rows are ordered by part, and a
part is a run of whole 64-bit words. AND-NOT with the filters of a subset leaves the survivors of any
order that starts with it, so 2^n subsets answer all n! orders; popcounts of the survivors and of their
intersections with the labels, added up for each part, are all that leaves a partition.

    kept after filters S      = K(S)
    removed by f after S      = K(S) - K(S + f)
    fails f, removed earlier  = (K() - K(f)) - removed
    fails f alone             = K(all but f) - K(all)
    removed, over all orders  = sum over S of |S|! (n - 1 - |S|)! (K(S) - K(S + f))
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import saved, text_of

FILTERS = "ABCDE"
MEASURES = ("kept", "good", "toxic")
#: Parts whose counts a task holds before it hands them on.
PARTS = 4096

WHITE = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters that look at one text, true where it fails. words: a column of its own."""
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, and a boolean column for each of the filters A to E."""
    read = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    split = read.withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    fails = text_failures(F.col("text"), F.col("words"))
    rows = saved(split.select("doc_id", "part", *[c.alias(f) for f, c in fails.items()], F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "audit-rows")
    # a table of its own, so that the join reads two exchanges and Spark can split the rows of a text with very many copies
    firsts = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "audit-copies")
    met = rows.join(firsts, "digest", "left")
    return met.select("doc_id", "part", *fails, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def labelled(fails: DataFrame, labels: DataFrame) -> DataFrame:
    """fails plus good and toxic: whether some row of labels has quality=1 or toxic=1 for the document."""
    some = labels.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    some = saved(some.where("good OR toxic"), "audit-labels")
    return fails.join(some, "doc_id", "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in ("good", "toxic")})


class Index:
    """Bitsets of a batch of rows, dealt by part."""

    def __init__(self, part: pa.Array, columns: dict[str, np.ndarray]):
        coded = part.dictionary_encode()
        self.parts = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        rows = np.bincount(code, minlength=len(self.parts))
        words = -(-rows // 64)
        self.first_word = np.cumsum(words) - words
        # a row's bit: its place in its part, after the whole words of the parts before
        self.bit = np.empty(len(code), np.int64)
        self.bit[order] = np.arange(len(code)) + np.repeat(64 * self.first_word - (np.cumsum(rows) - rows), rows)
        self.words = int(words.sum())
        self.sets = {name: self.packed(x) for name, x in columns.items()}
        self.all = self.packed(np.ones(len(code), bool))

    def packed(self, flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * self.words, bool)
        bits[self.bit] = flags
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def count(self, bits: np.ndarray) -> np.ndarray:
        """Bits set in each part."""
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.first_word)


def prefix_counts(index: Index, filters: str) -> np.ndarray:
    """(parts, subsets, measures): what survives each subset of the filters; bit i of a subset stands for filters[i]."""
    left = [index.all]
    for subset in range(1, 1 << len(filters)):
        top = subset.bit_length() - 1
        left.append(left[subset ^ 1 << top] & ~index.sets[filters[top]])
    return np.stack([np.stack([index.count(x), *[index.count(x & index.sets[m]) for m in MEASURES[1:]]], -1) for x in left], 1)


def survivors(flags: DataFrame, filters: str) -> DataFrame:
    """part and one array for each measure, indexed by subset: rows of the part that no filter of the subset fails."""
    n = 1 << len(filters)
    schema = "part string, subset int, " + ", ".join(f"{m} long" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            counts = np.concatenate(list(held.values()))
            made = [pa.array(np.repeat(np.array(list(held), object), n), pa.string()), pa.array(np.tile(np.arange(n, dtype=np.int32), len(held)))]
            held.clear()
            return pa.RecordBatch.from_arrays(made + [pa.array(counts[:, i]) for i in range(len(MEASURES))], names=["part", "subset", *MEASURES])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in (*filters, *MEASURES[1:])}
            index = Index(batch.column("part"), columns)
            for part, counts in zip(index.parts, prefix_counts(index, filters)):
                held[part] = held[part] + counts if part in held else counts
            if len(held) >= PARTS:
                yield out()
        if held:
            yield out()

    each = flags.select("part", *filters, *MEASURES[1:]).mapInArrow(run, schema)
    summed = each.groupBy("part", "subset").agg(*[F.sum(m).alias(m) for m in MEASURES])
    # one row for each subset: a group has 2^n rows, whatever the corpus
    rows = summed.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *MEASURES))).alias("x"))
    return rows.select("part", *[F.col(f"x.{m}").alias(m) for m in MEASURES])


def over_orders(kept: Column, filters: str) -> Column:
    """Array by filter: documents removed, summed over all orders."""
    n = len(filters)

    def total(i: int) -> Column:
        out = F.lit(0).cast("long")
        for s in range(1 << n):
            if not s >> i & 1:
                k = s.bit_count()
                out = out + (kept[s] - kept[s | 1 << i]) * F.lit(factorial(k) * factorial(n - 1 - k))
        return out

    return F.array(*[total(i) for i in range(n)])


def interactions(left: DataFrame, filters: str) -> DataFrame:
    """One row for each part, order and step."""
    n, bit = len(filters), {f: 1 << i for i, f in enumerate(filters)}
    # n! orders of n steps, whatever the corpus
    steps = [{"filter_order": "".join(o), "step": k + 1, "filter": filters.index(f), "before": sum(bit[g] for g in o[:k])} for o in permutations(filters) for k, f in enumerate(o)]
    dealt = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, filter: int, before: int>>")
    spread = left.withColumn("shapleys", over_orders(F.col("kept"), filters)).select("part", *MEASURES, "shapleys", F.inline(dealt))
    spread = spread.withColumn("own", F.element_at(F.array(*map(F.lit, bit.values())), F.col("filter") + 1)).withColumn("after", F.col("before").bitwiseOR(F.col("own")))
    at = lambda measure, subset: F.element_at(F.col(measure), subset + 1)
    lost = lambda measure: at(measure, F.col("before")) - at(measure, F.col("after"))
    everything = F.lit((1 << n) - 1)
    return spread.select(
        "part",
        "filter_order",
        "step",
        at("kept", F.col("after")).alias("kept"),
        lost("kept").alias("removed"),
        (at("kept", F.lit(0)) - at("kept", F.col("own")) - lost("kept")).alias("redundant"),
        (at("kept", everything - F.col("own")) - at("kept", everything)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.element_at("shapleys", F.col("filter") + 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty, and very long texts are read whole; a null source is the part of the empty source.
    A document with several rows of labels has a label if one of them gives it; null labels give none, and null
    ids have none. Repeated rows are documents of their own: of equal ids no one is smaller, a null id is
    neither smaller than another nor is any smaller than it. An empty table has no parts and gives no rows;
    other columns are ignored."""
    return interactions(survivors(labelled(failures(docs), labels), FILTERS), FILTERS)
