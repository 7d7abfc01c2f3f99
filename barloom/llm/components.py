"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is one group minimum and one join over the edges, so the graph stays distributed
and a hub's neighbours are spread by partial aggregation and skew-split joins. Each round is
written to the shared folder, which cuts lineage and survives a lost executor.

Spark sizes a table by its files: rows that explode makes count as the row they come from, and what files
hold in few bytes is large in memory. Joins of rows that grow with the corpus are dealt out by `shuffled`, so that
no such size makes Spark send one side through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import saved
from barloom.sources.shared import removed


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that deals out both sides by key, whatever sizes Spark takes them for."""
    return df.hint("merge")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: link each node's larger neighbours to its least neighbour;
    small: link its smaller neighbours to the least of them."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    met = both.join(shuffled(least), "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", F.col("low").alias("v")))
    return out.where("u > v").distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, root) for each node but the roots; root is the component's least node."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "cc-0")
    before = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        earlier, edges = edges, saved(_star(_star(edges, large=True), large=False), "cc")
        removed(earlier)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def least_and_last(keyed: DataFrame, payload: list[str], close: Callable[[list[Column], list[Column]], Column], seed: int | None = None) -> DataFrame:
    """(node, end, and the payload of both as end.*) of close pairs of a row of keyed (key, node, payload) with
    the least and the last node of its key: two rows at most for every row of keyed. With a seed, the order is that
    of a hash of key and node, so that a node meets other ends under each of its keys."""
    order = F.lit(0).cast("long") if seed is None else F.xxhash64(F.lit(seed), "key", "node")
    own = F.struct(order.alias("_o"), "node", *payload)
    ends = keyed.groupBy("key").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo.node != hi.node")
    met = keyed.join(shuffled(ends), "key").select("node", *payload, F.explode(F.array("lo", "hi")).alias("end"))
    return met.where((F.col("node") != F.col("end.node")) & close([F.col(c) for c in payload], [F.col("end")[c] for c in payload]))


def mixed_keys(keyed: DataFrame) -> DataFrame:
    """(key, size) of the keys of keyed (key, comp, ...) that hold several components."""
    return keyed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")


def with_main(rows: DataFrame, alone: int | None = None) -> DataFrame:
    """rows (key, comp, ...) plus main, the most populous component of the key, and size, its rows; written to a table.
    Keys of one component, in which `across` finds nothing, are left out, but with `alone` those of more rows than that."""
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size"), F.count("*").alias("comps"))
    kept = F.col("comps") > 1 if alone is None else (F.col("comps") > 1) | (F.col("size") > alone)
    return saved(rows.drop("size").join(shuffled(main.where(kept).select("key", F.col("m.comp").alias("main"), "size")), "key"), "cc-mixed")


def across(rows: DataFrame, payload: list[str], close: Callable[[list[Column], list[Column]], Column], searched: str | None = None) -> DataFrame:
    """Close pairs (a, b, comp_a, comp_b, payload of both) that share a key and are of different components.

    rows: key, main, node, comp, payload, as `with_main` gives them. In every key the members that are not of its
    most populous component meet all members of other components. A large group is that component wherever it is
    met, so its members aren't compared with each other, whatever numbers its nodes have. searched: an array of the
    groups of a row that are searched for all pairs elsewhere; pairs of one such group are left to that."""
    carried = [*payload, searched] if searched else payload
    side = lambda x: [F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in carried]]
    a, b = rows.where("comp != main").select("key", *side("a")), rows.select("key", "main", *side("b"))
    once = (F.col("comp_b") == F.col("main")) | (F.col("a") < F.col("b"))
    near = close([F.col(f"{c}_a") for c in payload], [F.col(f"{c}_b") for c in payload])
    met = a.join(shuffled(b), "key").where((F.col("comp_a") != F.col("comp_b")) & once & near)
    if searched:
        met = met.where(~F.coalesce(F.arrays_overlap(f"{searched}_a", f"{searched}_b"), F.lit(False))).drop(f"{searched}_a", f"{searched}_b")
    return met.drop("key", "main")


def merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """named (node, comp, ...) with comp replaced by the least comp reachable over links (comp_a, comp_b)."""
    roots = connected_components(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    return named.join(shuffled(roots.withColumnRenamed("node", "comp")), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")


def bucket_components(vertices: DataFrame, keyed: Callable[[DataFrame], DataFrame], payload: list[str], close: Callable[[list[Column], list[Column]], Column]) -> DataFrame:
    """(node, comp) of the graph that links nodes which share a key and are close; no bucket is expanded into its pairs.

    keyed(vertices) gives vertices' columns and one row a key. First every node is compared with the first
    and the last node of its buckets, which joins all but a few members of a large group into one component.
    Then only buckets that still hold several components are searched. What shares a component is linked
    already and all other close pairs are found, so the components are exact."""
    star = saved(least_and_last(keyed(vertices), payload, close).select(F.greatest("node", "end.node").alias("a"), F.least("node", "end.node").alias("b")).distinct(), "cc-star")
    named = saved(vertices.join(shuffled(connected_components(star)), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "cc-named")
    every = keyed(named).select("key", "node", "comp", *payload)
    return merged(named.select("node", "comp"), across(with_main(every.join(shuffled(mixed_keys(every)), "key")), payload, close).select("comp_a", "comp_b"))
