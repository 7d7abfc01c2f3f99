"""Every numbered query over whole tables against brute force in plain Python, or an exact round trip."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from barloom.llm import fingerprints, lm, mixing, packing, search, sharding, simhash, toxicity, warc
from barloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') AS text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def fingerprint(text, n=4):
    ws = words(text)
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i : i + n]), 42) for i in range(max(1, len(ws) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, distance):
    """Least reachable id of each row, by all pairs."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_op1(spark, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op1_simhash_near_dedup")}
    fps = {i: fingerprint(t) for i, t, _ in docs}
    near = components(list(fps), fps, 4)
    assert got == {i: (f"{fps[i]:016x}", near[i]) for i in fps}


@pytest.mark.parametrize("m", [5, 6, 8, 10])
def test_pigeonhole_blocks_lose_no_pair(spark, m):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(1, 7), replace=False)) for b in base]
    fps = sorted({*map(int, base), *flips})
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, m).collect()
    assert len(found) == len(want) and {(r["a"], r["b"]) for r in found} == want


@pytest.mark.parametrize("m", [5, 7, 10])
def test_components_of_a_large_group_of_near_copies(spark, m):
    rng = np.random.default_rng(m)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 80, dtype=np.int64)}
    base = [0x0123456789ABCDEF, 0x0123456789ABCDEF ^ 0xFF]
    fps |= {base[k % 2] ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 5), replace=False)) for k in range(300)}
    want = components(sorted(fps), {f: f for f in fps}, 4)
    found = {r["fp"]: r["root"] for r in simhash.components(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, m).collect()}
    assert {f: found.get(f, f) for f in fps} == want


def test_op2(spark):
    pages = duckdb.sql(f"SELECT page_id, coalesce(html, '') FROM '{SF}/pages.parquet'").fetchall()
    first = {}
    for i, h in sorted(pages):
        first.setdefault(h, i)
    want = {i: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, h in pages}
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(spark, "op2_warc_archive")}
    assert got == want


def test_warc_files_are_the_same_in_every_run_and_roll(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 7} é" * (i % 7 * 40)) for i in range(90)] + [(None, None, None), (3, "http://h/3", "x")], "page_id long, url string, html string")
    made = []
    for run in ("a", "b"):
        warc.write(pages.repartition(3 if run == "a" else 1), f"file://{tmp_path}/{run}", per_shard=30, roll_bytes=4000, min_payload=50)
        made.append({f.name: f.read_bytes() for f in (tmp_path / run / "data").iterdir() if not f.name.startswith(".")})
    assert made[0] == made[1] and len(made[0]) > 4
    back = warc.read(spark, f"file://{tmp_path}/a", payloads=True).collect()
    assert len(back) == 92 and sum(r["page_id"] == 3 for r in back) == 2
    for r in back:
        if r["record_type"] == "revisit":
            assert r["payload_bytes"] >= 50 and r["refers_to"] == r["page_id"] % 7
        elif r["url"] and r["payload"] != b"x":
            assert r["payload"].decode() == f"<p>{r['page_id'] % 7} é" * (r["page_id"] % 7 * 40)
    (tmp_path / "a" / "data" / sorted(made[0])[0]).write_bytes(b"spoiled")
    with pytest.raises(Exception, match="differs"):
        warc.read(spark, f"file://{tmp_path}/a").collect()


@pytest.mark.parametrize("ids", [[*range(400), 1 << 62], [*range(400), -(1 << 63), (1 << 63) - 1], [7] * 300 + list(range(100)), [None] * 300 + list(range(100))])
def test_no_range_of_pages_grows_with_a_far_or_repeated_id(spark, ids):
    pages = spark.createDataFrame([(i, f"{k * 2654435761 % (1 << 32):08x}") for k, i in enumerate(ids)], "page_id long, digest string")
    from pyspark.sql import functions as F

    got = pages.withColumn("r", warc.range_of(pages, "page_id", F.col("digest"), 50)).collect()
    sizes = Counter(r["r"] for r in got)
    assert max(sizes.values()) <= 90 and len(sizes) >= 7
    spread = defaultdict(list)
    for r in got:
        spread[r["r"]].append(math.inf if r["page_id"] is None else r["page_id"])
    order = [spread[r] for r in sorted(spread)]
    assert all(max(a) <= min(b) for a, b in zip(order, order[1:]))


def test_archive_is_read_by_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}") for i in [*range(200), 1 << 61]], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/a", per_shard=20)
    assert warc.read(spark, f"file://{tmp_path}/a").rdd.getNumPartitions() >= 2


def test_op3(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op3_maxent_lm")}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in docs}
    c = Counter(w for i, t, _ in docs if not held[i] for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    assert got.keys() == held.keys()
    for i, t, _ in docs:
        ws = [*words(t), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_scores_of_a_tiny_corpus_are_below_zero(spark):
    texts = ["a b c a b", "b c d", "a a b"] * 3
    train = [(i, t) for i, t in zip([i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 10], texts)]
    held = next(i for i in range(40, 99) if zlib.crc32(str(i).encode()) % 10 == 0)
    known = ["a", "b", "c", "d"]
    tries = [(i, "a b") for i in [held]] + [(held + 1000 * k, f"a b {w}") for k, w in enumerate(known, 1)]
    scored = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(train + [x for x in tries if x[0] % 1000 == held], "doc_id long, text string")).collect()}
    assert all(s < 0 for s in scored.values())


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op4_rendezvous_sharding")}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        r = got[i]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "key")
        assert r["grown_shard"] in (r["shard"], 24)
    slots = defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_rendezvous_placement_by_hand(spark, docs):
    import struct

    def scores(i, shards):
        head = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        hashes = [xxhash.xxh64_intdigest(struct.pack("<i", s), head) for s in range(shards)]
        return [-1 / math.log(((h >> 11) + 0.5) / (1 << 53)) for h in hashes]

    for r in rows(spark, "op4_rendezvous_sharding"):
        own, grown = scores(r["doc_id"], 24), scores(r["doc_id"], 25)
        assert r["shard"] == own.index(max(own)) and r["grown_shard"] == grown.index(max(grown))


def test_rendezvous_follows_weights_and_moves_little(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000)
    n = {r["s"]: r["count"] for r in keys.groupBy(sharding.place(F.col("id"), [1.0, 2.0, 5.0]).alias("s")).count().collect()}
    assert [round(n[i] / 20_000, 2) for i in range(3)] == pytest.approx([0.125, 0.25, 0.625], abs=0.015)
    moved = keys.select(sharding.place(F.col("id"), [1.0] * 10).alias("a"), sharding.place(F.col("id"), [1.0] * 11).alias("b")).where("a != b")
    assert {r["b"] for r in moved.select("b").distinct().collect()} == {10}
    assert moved.count() / 20_000 == pytest.approx(1 / 11, abs=0.01)


def test_op5(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, "op5_mixture_packing")
    of, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for i, t, _ in docs:
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(of[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    tokens = sum(r["length"] for r in got)
    assert len(seqs) * 2048 - tokens < 2048 * (1 + tokens / packing.PART_TOKENS)


@pytest.mark.parametrize("text", ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "a<|endoftext", "", "  \n\t ", "naïve — 日本語 \U0001f600\u200d \u0000 x'll 12345", "<|EndOfText|> don't stop"])
def test_ids_are_those_of_the_tokenizers_file(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(text).tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1]


def test_packing_holds_target_proportions_in_every_window(spark):
    rows_ = [(i, "a" if i % 3 else "b", "word " * (5 + i * 37 % 300)) for i in range(3000)]
    out = packing.pack(spark.createDataFrame(rows_, "doc_id long, source string, text string")).toPandas()
    share = out[out["source_key"] == "s:b"]["length"].sum() / out["length"].sum()
    by = out.pivot_table(index="sequence_id", columns="source_key", values="length", aggfunc="sum", fill_value=0)
    full = by[by.sum(axis=1) == 2048]
    assert (full["s:b"] / 2048 - share).abs().quantile(0.95) < 0.26 and (full["s:b"].rolling(8).mean() / 2048 - share).abs().max() < 0.1


def bm25(docs, query, k=10):
    tf = {i: Counter(words(t)) for i, t, _ in docs}
    mean, n = sum(sum(c.values()) for c in tf.values()) / len(tf), len(tf)
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log1p((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    found = []
    for i, c in tf.items():
        norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
        s = sum(idf[w] * c[w] * 2.2 / (c[w] + norm) for w in query if w in c)
        if s > 0:
            found.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(found)[:k]]


@pytest.mark.parametrize("shard", [8192, 16])
def test_op6(spark, docs, shard):
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    asked = frame.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    got = defaultdict(list)
    for r in search.search(frame, asked, shard=shard, query_block=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for i, t, _ in docs:
        if i % 50 == 0 and words(t):
            want = bm25(docs, Counter(words(t)))
            assert [d for d, _ in got[i]] == [d for d, _ in want]
            assert [s for _, s in got[i]] == pytest.approx([s for _, s in want], abs=1e-8)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_op7(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op7_secret_scan")}
    for i, t, _ in docs:
        base, r = base_spans(t), got[i]
        kinds = Counter(k for k, *_ in base)
        shown = [f"{k}:{s}:{e}" for k, s, e in base]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(shown) <= set(spans) and len(spans) == len(set(spans))
        at = [int(x.split(":")[1]) for x in spans]
        assert at == sorted(at)


def test_linked_parts_are_those_of_all_pairs(spark):
    from barloom.llm import secrets

    rng = np.random.default_rng(5)
    bits = ["https://host.example/a/b", "user=someone", "password=hunter2hunter2", "AKIA" + "A1B2" * 4, "0123456789abcdef" * 2, "aB3" * 12, "x.amazonaws.com"]
    texts = ["", None] + ["".join(str(rng.choice(bits)) + " " + "~ " * int(rng.integers(0, 260)) for _ in range(rng.integers(1, 9))) for _ in range(80)]
    got = {r["doc_id"]: [(p["kind"], p["start"], p["end"]) for p in r["parts"]] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    role = [secrets.ROLE[k] for k in secrets.KINDS]
    linked = 0
    for i, text in enumerate(texts):
        base = secrets.base_parts(text or "")
        weak = secrets.weak_parts(text or "", base)
        met = [w for w in weak if any(role[w[0]] != role[p[0]] and "secret" in (role[w[0]], role[p[0]]) and max(w[1], p[1]) - min(w[2], p[2]) <= secrets.SCOPE for p in base + weak)]
        assert got[i] == sorted(base + met, key=lambda p: (p[1], p[0]))
        linked += len(met)
    assert 20 < linked < sum(len(secrets.weak_parts(t or "", secrets.base_parts(t or ""))) for t in texts)


def test_op8(spark, docs):
    got = rows(spark, "op8_cube_mixing")
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(rows(spark, "op8_cube_mixing"), key=lambda r: r["doc_id"])
    size = {i: len(words(t)) for i, t, _ in docs}
    assert {r["doc_id"]: r["size"] for r in got} == size
    by = defaultdict(int)
    for i, _, s in docs:
        by[s] += size[i]
    order = sorted(by, key=lambda s: (s is None, s))
    weight, capped = {s: k % 3 + 1 for k, s in enumerate(order)}, {}
    while True:
        left = sum(by.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in by if x not in capped) for s in by if s not in capped}
        over = {s: 3.0 * by[s] for s, x in share.items() if x > 3 * by[s]}
        if not over:
            break
        capped |= over
    target = share | capped
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == by[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in by:
        assert taken[s] == pytest.approx(target[s], abs=2)


def test_cube_flight_keeps_totals():
    rng = np.random.default_rng(1)
    pi, size = rng.random(500), rng.integers(0, 900, 500)
    out = mixing.flight(pi, size, np.random.default_rng(2))
    free = (out > 0) & (out < 1)
    assert free.sum() <= 2
    assert out.sum() == pytest.approx(pi.sum()) and out @ size == pytest.approx(pi @ size)
    many = np.mean([mixing.flight(pi[:40], size[:40], np.random.default_rng(k)) for k in range(1500)], axis=0)
    assert np.abs(many - pi[:40]).max() < 0.06


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    for v in np.unique(s):
        rank[s == v] = np.flatnonzero(s[order] == v).mean() + 1
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_op9_ranks_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    y = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    got = [r for r in QUERIES["op9_toxicity"](spark, sf).collect()]
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r["held_out"] and y.get(r["doc_id"]) is not None]
    assert auc(np.array([y[r["doc_id"]] for r in out]), np.array([r["score"] for r in out])) > 0.9


def test_viterbi_restores_obfuscated_words(spark):
    text = " ".join(["you stupid worthless idiot people", "the kind moron said a loser is garbage"] * 50)
    model = toxicity.trigram_model(toxicity.trigram_counts(spark.createDataFrame([(text,)], "text string")))
    for raw, word in (("1d10t", "idiot"), ("stuuuupid", "stupid"), ("m.o.r.o.n", "moron"), ("g@rb4ge", "garbage"), ("l0$er", "loser")):
        assert toxicity.readings(raw, model)[0] == word
    assert toxicity.RUN + "garbage" in toxicity.raw_tokens("what g a r b a g e this is")
    read = lambda text: {w for raw in toxicity.raw_tokens(text) for w in toxicity.restored(raw, model)}
    assert "you" in read("y o u")
    assert {"stupid", "worthless", "idiot", "people"} <= read(" ".join("you" "stupid" "worthless" "idiot" "people"))
    assert {"moron", "garbage"} <= read(" ".join("m0r0nsaidtheloseris" * 3 + "g@rb4ge"))
    assert "stupid" in read("st" + "u" * 90 + "pid") and "idiot" in read("!" * 60 + "diot")
    assert "moron" in read(".".join("moron" "said" "the" "kind" "loser" "is" "garbage" "and" "stupid" "people" "you" "idiot"))


def test_viterbi_is_the_best_of_all_readings(spark):
    from itertools import product

    text = " ".join(["you stupid worthless idiot people", "the kind moron said a loser is garbage"] * 5)
    model = toxicity.trigram_model(toxicity.trigram_counts(spark.createDataFrame([(text,)], "text string")))

    def cost(choice):
        a = b = 0
        p = sum(c for _, c in choice)
        for x in "".join(s for s, _ in choice):
            z = toxicity.LETTER.get(x, 1)
            p, a, b = p + model[a, b, z], b, z
        return p + (model[a, b, 0] if b else 0.0)

    for raw in ("1d10t", "m.0r.0n", "$tuuup1d", "g@rb4g3!", "|0$3r"):
        best = {}
        for choice in product(*toxicity.lattice(raw)):
            s = "".join(x for x, _ in choice)
            if s:
                best[s] = max(best.get(s, -math.inf), cost(choice))
        want = sorted(best, key=lambda s: -best[s])[:3]
        assert toxicity.readings(raw, model, 50)[:3] == want


def jaccard(a, b, n=5):
    def shingles(t):
        ws = re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ").lower().split(" ")
        return {" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws != [""] else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op10(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op10_bottom_k_fingerprints")}
    assert len(got) == len(docs)
    down, by_text = sorted(docs, reverse=True, key=lambda d: d[0]), {}
    for k, (i, t, _) in enumerate(down):
        following = down[(k + 1) % len(down)][1]
        third = len(t) // 3
        edit = t[: len(t) - third] + following[:third]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert (r["fingerprint"] == r["edited_fingerprint"]) >= (t == edit)
        assert r["near_edited"] == pytest.approx(jaccard(t, edit), abs=0.17)
        assert r["near_next"] == pytest.approx(jaccard(t, following), abs=0.17)


def test_sketches_merge_across_parts(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i * i % 997}" for i in range(900))
    parts = [text, " ".join(text.split()[:400]), "one two three four five six"]
    df = spark.createDataFrame([(1, p) for p in parts], "g int, text string").withColumn("w", fingerprints.words(F.col("text")))
    sk = df.select("g", fingerprints.sketch(F.col("w")).alias("sketch"))
    merged = fingerprints.merged_sketches(sk, ["g"]).first()["sketch"]
    by_hand = sorted({h for r in sk.collect() for h in r["sketch"]})[: fingerprints.K]
    assert merged == by_hand
    n = fingerprints.merged_sketches(sk, ["g"]).select(fingerprints.distinct_shingles(F.col("sketch"))).first()[0]
    exact = len({tuple(t.split()[i : i + 5]) for t in parts for i in range(len(t.split()) - 4)})
    assert n == pytest.approx(exact, rel=0.3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = sorted(c[0] for c in cur.description)
    have = [c[0] for c in cur.description]
    shown = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(shown(r[have.index(c)]) for c in names) for r in cur.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(tuple(shown(r[c]) for c in names) for r in df.collect()) == want


def test_lm_forward_pass_by_tables_equals_the_dense_product():
    rng = np.random.default_rng(0)
    n = 500
    cls, row = rng.integers(0, lm.CLASSES, n), rng.integers(0, lm.ROWS, n)
    places = np.concatenate([np.arange(3), np.arange(n - 3)])
    c, rows, slots = lm.contexts(cls, row, places)
    weights = rng.normal(size=(lm.FEATURES, lm.CLASSES)).astype(np.float32)
    z = lm.dense_features(c) @ weights[: lm.DENSE] + sum(weights[r] for r in rows)
    np.testing.assert_allclose(lm.logits(weights, lm.pair_tables(weights), c, rows), z, atol=1e-4)
    slot_weights = rng.normal(size=(lm.SLOT_FEATURES, lm.SLOTS)).astype(np.float32)
    np.testing.assert_allclose(lm.slot_logits(slot_weights, slots), sum(slot_weights[r] for r in slots), atol=1e-4)
    p = np.exp(z.astype(float))
    p /= p.sum(axis=1, keepdims=True)
    np.testing.assert_allclose(lm.log_shares(z.copy(), cls), np.log(p[np.arange(n), cls]), atol=1e-4)
    np.testing.assert_allclose(lm.softmax(z.copy()), p, atol=1e-5)


def small_words(texts, top):
    """Counts of a corpus, and what the model knows of its words, by plain Python."""
    c = Counter(w for t in texts for w in t.encode().split())
    names = [b"", *sorted(c, key=lambda w: (-c[w], w))[:top]]
    pairs, groups = np.zeros((lm.ENDINGS, lm.ENDINGS)), np.zeros((lm.ENDINGS * lm.REST, 2))
    for t in texts:
        e = [lm.ending(w) for w in t.encode().split()]
        for d in (1, 2, 3):
            for x, y in zip(e, e[d:]):
                pairs[y, x] += 1
    for w, k in c.items():
        groups[lm.ending(w) * lm.REST + lm.rest_slot(w)] += (k, 1)
    return c, lm.Words(names, np.array([len(texts), *(c[w] for w in names[1:])]), lm.cluster(pairs, lm.CLASSES - 1), groups)


def made_texts(seed=0, docs=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}{k}{c}" for a in "abc" for b in "xyz" for k in range(6) for c in ("ing", "ed", "s", "ly")]
    share = 1 / (1 + np.arange(len(vocabulary)))
    return [" ".join(rng.choice(vocabulary, rng.integers(1, 60), p=share / share.sum())) for _ in range(docs)]


def test_lm_probabilities_of_all_words_sum_to_one():
    texts = made_texts()
    c, words = small_words(texts, 150)
    assert len(c) > 160
    rng = np.random.default_rng(1)
    weights = words.start(sum(c.values()) + len(texts))
    for w, at in zip(weights, (1, lm.CLASSES), strict=True):  # all features but the biases get weights
        w[at:] += rng.normal(scale=0.5, size=w[at:].shape)
    ids = lm.Ids(words.top)
    for before in (texts[0].split()[:5], []):
        context = [ids[w.encode()] for w in before]
        total = 0.0
        for w in [b"", *c]:
            i = 0 if not w else ids[w]
            row = np.array([*context, i])
            p = lm.log_probabilities(weights, lm.pair_tables(weights[0]), words, row, np.arange(len(row)))[-1]
            known = math.log(c[w] + lm.SMOOTH) if i >= len(words.top) else 0.0
            total += math.exp(p + words.log_share[i] + known)
        for e in range(lm.ENDINGS):  # unknown words: one a class and shared slot
            if e == int(np.flatnonzero(words.classes == words.classes[e])[0]):
                for r in range(lm.REST):
                    i = len(words.top) + e * lm.REST + r
                    row = np.array([*context, i])
                    p = lm.log_probabilities(weights, lm.pair_tables(weights[0]), words, row, np.arange(len(row)))[-1]
                    total += math.exp(p + words.log_share[i] + math.log(lm.SMOOTH))
        assert total == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("top", [20, 10_000])
def test_lm_score_is_the_product_of_its_factors(spark, top):
    texts = made_texts(3)
    train = [(i, t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    c, words = small_words([t for _, t in train], top)
    n = sum(c.values()) + len(train)
    weights = words.start(n)
    tables, ids = lm.pair_tables(weights[0]), lm.Ids(words.top)
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 10 == 0][:9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, f"{t} unseenword") for i, t in zip(held, texts)]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0, top=top).collect()}
    for i, t in rows:
        ws = t.encode().split()
        x = np.array([*(ids[w] for w in ws), 0])
        p = lm.log_probabilities(weights, tables, words, x, np.arange(len(x))) + words.log_share[x]
        p += [math.log(c[w] + lm.SMOOTH) if k >= len(words.top) else 0.0 for w, k in zip([*ws, b""], x.tolist())]
        assert got[i] == pytest.approx(p.sum() / math.log(10), rel=1e-6)


def test_lm_training_gains_on_held_out_text(spark):
    # words in a fixed cycle: what comes next is sure, which only the slot factor can learn
    cycle = [f"q{k}aa" for k in range(11)]
    texts = [(i, " ".join(cycle[(i + j) % 11] for j in range(40))) for i in range(400)]
    got = lm.score(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").collect()
    gain = sum(r["score"] for r in got) - sum(r["base_score"] for r in got)
    assert gain / sum(r["n_tokens"] for r in got) > 0.4
