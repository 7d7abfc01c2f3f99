"""Operators do the whole job: one small case for each place where they once did less."""

import math
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from barloom.llm import search, secrets
from barloom.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def whole_bm25(docs, query, k=10):
    tf = {i: Counter(t.split()) for i, t in docs}
    mean, n = sum(sum(c.values()) for c in tf.values()) / len(tf), len(tf)
    df = Counter(w for c in tf.values() for w in c)
    found = []
    for i, c in tf.items():
        norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
        s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in set(query.split()) if w in c)
        if s > 0:
            found.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(found)[:k]]


@pytest.mark.parametrize(("shard", "query_block"), [(8192, 1 << 14), (8, 1)])
def test_search_takes_every_word_of_a_query(spark, shard, query_block):
    rare = " ".join(f"r{i}" for i in range(40))
    docs = [(0, f"{rare} " + " ".join(f"c{i}" for i in range(60)))]
    # documents with only the words beyond the 32 rarest
    docs += [(d, " ".join(f"c{i}" for i in range(d % 7, 60, 1 + d % 5))) for d in range(1, 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = frame.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    got = defaultdict(list)
    for r in search.search(frame, asked, shard=shard, query_block=query_block).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for q in (0, 20):
        want = whole_bm25(docs, docs[q][1])
        assert len(want) == 10 and [d for d, _ in got[q]] == [d for d, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=1e-8)


def test_whole_text_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(ORACLES["op6_bm25_search"]).fetchall()
    got = [tuple(r) for r in QUERIES["op6_bm25_search"](spark, SF).select("query_id", "rank", "doc_id", "score").collect()]
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in sorted(want)]
    assert [r[3] for r in sorted(got)] == pytest.approx([r[3] for r in sorted(want)], abs=1e-5)


def test_search_skips_postings(spark):
    """Against an exhaustive sum: the same best documents, most postings of the query's terms never read."""
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(3000)]
    share = 1 / (np.arange(3000) + 3.0)
    topics = [rng.choice(vocabulary, 60) for _ in range(40)]
    docs = [(i, " ".join([*rng.choice(vocabulary, 80, p=share / share.sum()), *rng.choice(topics[i % 40], 40)])) for i in range(2000)]
    row = search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).first().asDict()
    mean = sum(len(t.split()) for _, t in docs) / len(docs)
    df = dict(zip(row["terms"], row["df"], strict=True))
    asked = read = 0
    for i in range(0, 2000, 50):
        words = sorted(search.term_of(w.encode()) for w in set(docs[i][1].split()))
        weights = np.array([math.log1p((2000 - df[w] + 0.5) / (df[w] + 0.5)) for w in words])
        shard = search.Shard({**row, "terms": np.array(row["terms"]), "df": np.array(row["df"])}, mean)
        places = shard.places(np.array(words, np.int64))
        hits, scores = shard.top(places, weights, 10, 0.0)
        sums = np.zeros(2000)
        shard.summed(places, weights, sums)
        all_postings = sum(df[w] for w in words)
        want = np.lexsort((np.arange(2000), -np.round(sums, search.DIGITS)))[:10]
        assert hits.tolist() == want.tolist() and scores == pytest.approx(sums[want], abs=1e-8)
        asked, read = asked + all_postings, read + shard.read - all_postings
        again = search.Shard({**row, "terms": np.array(row["terms"]), "df": np.array(row["df"])}, mean)
        assert again.top(places, weights, 10, float(scores[-1]))[0].tolist() == want.tolist()
        assert again.read <= all_postings
    assert read < 0.6 * asked


KEY88 = "aB3+" * 21 + "xY=="
URL = "https://host.example/" + "long/" * 80 + "tail"
USER80 = "u" * 80
SECRET = "password=" + "Zz9" * 300
FILL = " .," * 130 + " "  # under 400 code points


@pytest.mark.parametrize(
    ("text", "kinds", "left"),
    [
        (f"AKIA{'A1' * 8} at https://host.example/x {KEY88}", ["access", "endpoint", "bare"], ["aB3"]),
        (f"AKIA{'A1' * 8} {'aB3/' * 200}", ["access", "bare"], ["aB3"]),
        (f"{URL} password=hunter2hunter2", ["endpoint", "assign"], ["long", "tail"]),
        (f"user={USER80} password=hunter2hunter2", ["user", "assign"], ["uu"]),
        (f"{SECRET} https://host.example/path", ["assign", "endpoint"], ["example"]),
        (f"{SECRET}{FILL}user=someone", ["assign", "user"], ["someone"]),
        (f"{URL}{FILL}{SECRET}", ["endpoint", "assign"], ["long"]),
    ],
)
def test_secrets_of_any_length(spark, text, kinds, left):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    parts = secrets.scan(docs).first()["parts"]
    assert [secrets.KINDS[p["kind"]] for p in parts] == kinds
    out = secrets.redacted(docs).first()["text"]
    assert not any(x in out for x in left)


def test_secrets_out_of_scope_stay_apart(spark):
    texts = [f"{SECRET}{'~' * n} user=someone" for n in (0, 399, 400, 1200)]  # the gap is n and a space
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [len(r["parts"]) for r in secrets.scan(docs).orderBy("doc_id").collect()]
    assert got == [2, 2, 1, 1]


def test_search_adds_queries_up_together(spark, monkeypatch):
    """Many queries at once find what each finds alone; an index takes four bytes a posting, and no more where counts fit."""
    rng = np.random.default_rng(1)
    share = 1 / (np.arange(900) + 3.0)
    docs = [(i, " ".join(rng.choice([f"w{j}" for j in range(900)], 1 + i % 90, p=share / share.sum()))) for i in range(600)]
    docs += [(600 + i, docs[i][1]) for i in range(40)]
    row = search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).first().asDict()
    postings = sum(row["df"])
    assert len(row["docs"]) + len(row["tf"]) == 4 * postings and not {"by_doc"} & set(row)
    assert search.unpacked(search.packed(np.array([1 << 16, 3])), 2).tolist() == [1 << 16, 3]
    shard = search.Shard(row, 45.0)
    asked = [np.array([search.term_of(w.encode()) for w in sorted(set(docs[i][1].split()))] + [1]) for i in range(0, 640, 7)]
    places = [shard.places(a) for a in asked]
    weights = [np.where(p >= 0, np.log1p(640 / (1 + np.diff(shard.start)[p])), 1.0) for p in places]
    starts = np.r_[0, np.cumsum([len(p) for p in places])]
    plain = [shard.top(p, w, 10, 0.0) for p, w in zip(places, weights, strict=True)]
    for least in (np.zeros(len(asked)), np.array([float(s[-1]) for _, s in plain]), np.full(len(asked), 1e9)):
        for alone in (search.ALONE, 1):
            monkeypatch.setattr(search, "ALONE", alone)
            q, found, scores = shard.best(starts, np.concatenate(places), np.concatenate(weights), 10, least)
            for i, (d, s) in enumerate(plain):
                want = d if least[i] < 1e9 else []
                assert found[q == i].tolist() == list(want) and scores[q == i] == pytest.approx(s[: len(want)], abs=2e-9)


def test_search_parts_documents_by_their_words(spark, monkeypatch):
    """Documents with few words in common get indexes of their own; in those of others a query reads few postings."""
    rng = np.random.default_rng(2)
    share = 1 / (np.arange(400) + 3.0)
    words = {v: np.array([f"{v}{j}" for j in range(400)]) for v in "ab"}
    common = [f"c{j}" for j in range(6)]
    text = lambda v, n: [*rng.choice(words[v], n, p=share / share.sum()), *rng.choice(common, 4)]
    docs = [text("ab"[i % 3 == 0], 40) for i in range(900)]
    for name, value in (("LEAST_PARTED", 256), ("LEAST_PART", 64)):
        monkeypatch.setattr(search, name, value)
    parts = search.parts_of([np.array([search.term_of(w.encode()) for w in set(d)]) for d in docs])
    assert sorted(sorted(set(p % 3 == 0)) for p in parts) == [[False], [True]] and sorted(np.concatenate(parts)) == list(range(900))
    assert len(search.parts_of([np.array([1, 2])] * 500)) == len(search.parts_of([np.zeros(0, np.int64)] * 500)) == 1  # nothing to part by

    row = search.build(spark.createDataFrame([(i, " ".join(docs[i])) for i in range(900) if i % 3], "doc_id long, text string").coalesce(1)).first().asDict()
    shard = search.Shard(row, 44.0)
    asked = [np.array([search.term_of(w.encode()) for w in sorted(set(docs[i]))]) for i in range(0, 900, 9)]
    places = [shard.places(a) for a in asked]
    places = [p[p >= 0] for p in places]
    weights = [np.log1p(900 / (1 + np.diff(shard.start)[p])) for p in places]
    by_weight = [np.argsort(-w) for w in weights]
    places, weights = [p[o] for p, o in zip(places, by_weight)], [w[o] for w, o in zip(weights, by_weight)]
    starts = np.r_[0, np.cumsum([len(p) for p in places])]
    plain = [shard.top(p, w, 10, 0.0) for p, w in zip(places, weights, strict=True)]
    for least in (0.0, 0.5, 1.0, 1.2):  # shares of the queries' best scores
        floor = np.array([least * s[0] for _, s in plain])
        q, found, scores = shard.best(starts, np.concatenate(places), np.concatenate(weights), 10, floor)
        for i, (d, s) in enumerate(plain):
            want = [x for x, y in zip(d, s) if y >= floor[i] - 1e-9]
            assert found[q == i].tolist() == want and scores[q == i] == pytest.approx(s[: len(want)], abs=2e-9)
    # a threshold from documents of the query's own language: a few postings of its rarer words are read
    df = np.diff(shard.start)
    asked = [np.r_[np.flatnonzero(df < 40)[i : i + 5], np.argsort(-df)[:6]] for i in range(20)]
    starts, places, weights = 11 * np.arange(21), np.concatenate(asked), np.tile(np.r_[np.full(5, 6.0), np.full(6, 0.3)], 20)
    plain = [shard.top(p, weights[:11], 10, 20.0) for p in asked]
    shard.read = 0
    q, found, scores = shard.best(starts, places, weights, 10, np.full(20, 20.0))
    assert [found[q == i].tolist() for i in range(20)] == [d.tolist() for d, _ in plain] and len(found)
    assert shard.read <= df[places].sum() / 4
