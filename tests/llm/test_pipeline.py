"""The stages of the corpus pipeline, each held against brute force on what it was given."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import simhash, toxicity
from barloom.llm.common import table
from barloom.llm.components import across, mixed_keys, with_main

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """documents and what each stage made of them."""
    out, docs = [table(spark, SF, "documents")], table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def test_toxicity_decides(spark, made):
    docs, kept = made[0], made[1]
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in docs if score[r["doc_id"]] < toxicity.THRESHOLD)


def first_of_groups(docs, least=0.8):
    """The least id of each component of pairs with a likeness of `least`, by all pairs."""
    sets = {r["doc_id"]: shingles(r["text"]) if (r["text"] or "").split() else set() for r in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in ids}


def test_near_copies_go_and_one_of_each_group_stays(made):
    assert sorted(r["doc_id"] for r in made[2]) == sorted(first_of_groups(made[1]))


def near_table(rng, strangers):
    """Documents of 60 words, a group of near copies of one of them, chains of edits, a passage that many share,
    and short texts."""
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
    out = [text(60) for _ in range(strangers)]
    base, passage = text(60), text(30)
    for _ in range(strangers // 2):
        words = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            words[at] = vocabulary[rng.integers(0, len(vocabulary))]
        out.append(words)
    out += [passage + text(rng.integers(8, 60)) for _ in range(strangers)]
    chain = text(80)
    for _ in range(20):
        chain = [*chain[2:], *text(2)]
        out.append(chain)
    out += [text(n) for n in range(9)] + [list("abcde"), list("abcdef"), list("abcdefghij"), list("abcdefghi")]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_near_copies_on_large_groups_match_all_pairs(spark):
    rows = near_table(np.random.default_rng(3), 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in simhash.first_of_near_copies(docs).collect())
    assert got == sorted(first_of_groups([{"doc_id": i, "text": t} for i, t in rows]))


def test_near_copies_with_ties_nulls_and_repeated_rows(spark):
    long = " ".join(f"v{i}" for i in range(50))
    rows = [(5, long), (5, long), (5, long + " tail"), (None, long), (7, None), (6, ""), (None, "  "), (None, "alone and without an id"), (3, "other"), (3, "another text")]
    got = simhash.first_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(5, got_text(got, 5)), (6, ""), (None, "alone and without an id"), (3, "other"), (3, "another text")], key=str)


def got_text(got, i):
    (text,) = [r["text"] for r in got if r["doc_id"] == i]
    return text


@pytest.mark.parametrize("base", [0x0123456789ABCDEF, 0x7123456789ABCDEF])
def test_a_large_group_is_never_compared_with_itself(spark, base):
    """Whatever numbers its members have: compared pairs stay near the number of members, not its square."""
    rng = np.random.default_rng(1)
    strangers = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).tolist()
    group = {base ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 4), replace=False)) for _ in range(800)}
    fps = spark.createDataFrame([(f,) for f in {*strangers, *group}], "fp long")
    every = fps.select(F.col("fp").alias("node"), F.lit(0).alias("comp"), F.col("fp").alias("bits"))
    named = every.withColumn("comp", F.when(F.bit_count(F.col("bits").bitwiseXOR(F.lit(base))) <= 8, F.lit(min(group))).otherwise(F.col("node")))
    masks = simhash.block_masks(6)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("node").bitwiseAND(F.lit(simhash._signed(masks[i] | masks[j])))) for i in range(6) for j in range(i)])
    rows = named.select("*", F.explode(keys).alias("key"))
    compared = across(with_main(rows.join(mixed_keys(rows), "key")), ["bits"], lambda x, y: F.lit(True)).count()
    assert compared < 30 * len(group)


def test_secrets_are_gone_and_documents_stay(made):
    before, after = made[2], made[3]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    for r in after:
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"] or "")
    same = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == same[r["doc_id"]] for r in after if "[secret]" not in (r["text"] or ""))


def test_mix_meets_targets(made):
    before, after = made[3], made[4]
    size = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert size(after) == pytest.approx(size(before), rel=0.01)
    copies = Counter(r["doc_id"] for r in after)
    assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in before}
    by = defaultdict(list)
    for r in after:
        by[r["source"]].append(r)
    assert set(by) <= {r["source"] for r in before}


def test_packing_takes_every_document(made):
    before, after = made[4], made[5]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert sum(r["start"] == 0 for r in after) == len(before)


def test_run_is_the_stages(spark, made):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r.asDict().values()) for r in got.collect()) == sorted(tuple(r[c] for c in got.columns) for r in made[5])
