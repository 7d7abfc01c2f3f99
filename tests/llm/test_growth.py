"""Joins that once grew faster than their input, and files that stayed after their use."""

import time
from math import comb

import pytest
from pyspark.sql import functions as F

from barloom.llm import components, simhash
from barloom.llm.components import across, with_main
from barloom.sources.shared import CLEANUP, written


@pytest.mark.parametrize("bits", range(10, 31))
def test_a_fingerprint_meets_few_strangers(bits):
    m = simhash.blocks_for(1 << bits, 4)
    assert comb(m, m - 4) * 2.0 ** (bits - (64 // m) * (m - 4)) <= 4


def test_keys_of_one_component_are_left_out(spark):
    rows = spark.createDataFrame([(1, n, 7) for n in range(5)] + [(2, n, 7) for n in range(9)] + [(3, 1, 7), (3, 20, 8)], "key long, node long, comp long")
    assert {r["key"] for r in with_main(rows).collect()} == {3}
    assert sorted((r["key"], r["size"]) for r in with_main(rows, 6).distinct().groupBy("key", "size").count().collect()) == [(2, 9), (3, 2)]


def test_pairs_that_are_searched_elsewhere_are_not_made_again(spark):
    rows = [(1, 0, n, n, [5] if n < 8 else [6] if n < 10 else None) for n in range(12)]
    frame = spark.createDataFrame(rows, "key long, main long, node long, comp long, groups array<long>")
    every = lambda x, y: F.lit(True)
    pairs = lambda *more: {tuple(sorted((r["a"], r["b"]))) for r in across(frame.select("*", F.lit(1).alias("n")), ["n"], every, *more).collect()}
    group = {n: n < 8 and 5 or 6 for n in range(10)}
    assert pairs() == {(a, b) for a in range(12) for b in range(a + 1, 12)}
    assert pairs("groups") == {(a, b) for a, b in pairs() if group.get(a, -a) != group.get(b, -b)}


def test_keys_are_joined_once_with_what_is_known_of_their_node(spark):
    keys = spark.createDataFrame([(k, n) for k in range(4) for n in range(6)], "key long, node long")
    named = spark.createDataFrame([(n, n // 2, n) for n in range(6)], "node long, comp long, n long")
    for dense in ([], [(9, 0), (8, 0), (9, 1)]):
        groups = {n: {g for g, x in dense if x == n} for n in range(6)}
        got = simhash.searched(keys, named, spark.createDataFrame(dense, "main long, node long"), ["n"])
        rows = [(r["key"], r["node"], r["comp"], r["n"], set(r["groups"] or [])) for r in got.collect()]
        assert sorted(rows, key=lambda r: r[:2]) == [(k, n, n // 2, n, groups[n]) for k in range(4) for n in range(6)]
        # whether there are dense groups or not, and whatever components were joined, rows of keys go through one join
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 2 and "Join Inner" in plan


def test_shuffle_files_go_with_the_query_that_made_them(spark):
    files = lambda: sum("shuffle_" in str(x) for x in str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()).split(","))
    before, set_before = files(), spark.conf.get(CLEANUP, None)
    written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "shuffled")
    end = time.time() + 10
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(CLEANUP, None) == set_before


def test_rows_that_explode_makes_are_not_sent_to_all(spark, monkeypatch):
    # files of under 10 MB, which Spark would send through the driver with all the keys that explode makes of each row
    texts = [f"{' '.join(f'w{i // 3}x{j}' for j in range(60))} end{i % 3}" for i in range(60)]
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "small-docs")
    plans = []

    def planned(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    for module in (simhash, components):
        monkeypatch.setattr(module, "saved", planned)
    found = simhash.near_duplicates(docs)
    plans.append(("found", found._jdf.queryExecution().executedPlan().toString()))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute(texts)
    joins = [name for name, plan in plans if "Join" in plan]
    assert {"cc-star", "cc-named", "cc-mixed", "found"} <= set(joins)
    assert not [name for name, plan in plans if "Broadcast" in plan]
    # the pipeline shares the joins by key
    del plans[:]
    assert {r["doc_id"] for r in simhash.first_of_near_copies(docs).collect()} == set(range(0, 60, 3))
    assert not [name for name, plan in plans if name in ("cc-mixed", "cc", "near-pairs") and "Broadcast" in plan]


def brute(texts):
    fps = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return dict(enumerate(root))
