"""Token alignment, license scan and filter audit against brute force, odd inputs included."""

import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import align, audit, licenses, packing
from barloom.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["part", "block", "pair", "digest", "words", "first", "kept", "good", "toxic", "A", "E", "base", "found", "score", "n_words", "sizes", "count", "best"]
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(150_000))
ODD = [
    (1, "the same text, twice over", "en", "a", 3),
    (1, "the same text, twice over", "en", "a", 3),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "en", "b", 4),
    (None, "the same text, twice over", "en", "b", 5),
    (None, None, None, None, None),
    (5, "the same text, twice over", "en", None, 1),
    (6, LONG, "en", "a", len(LONG)),
    (-7, "MIT License mit-license; CC BY-SA 4.0 #", "de", "", 4),
    (8, "▁ stands for a blank, <|endoftext|> and <0x41> for themselves \x00 \U0001f600 é ｆ", "en", "c", 1),
    (9, "_" * 300_000, "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') AS text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def both_tokenizations(text):
    """(id, bytes) of each token, by the two libraries themselves."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def run(text):
        made = a.encode(" " + text, add_special_tokens=False)
        ids = b.encode(text)
        return (
            [(i, bytes(byte[c] for c in t)) for i, t in zip(made.ids, made.tokens)],
            [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids],
        )

    return run if text is None else run(text)


def brute_alignment(rows):
    tokens, found, docs_with = both_tokenizations(None), [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = tokens(text)
            raw = b" " + text.encode()
            if b"".join(t for _, t in a) == b"".join(t for _, t in b) == raw:
                ends = [set(np.cumsum([len(t) for _, t in x]).tolist()) for x in (a, b)]
                common = sorted(ends[0] & ends[1])
                groups = [([], []) for _ in common]
                for side, x in enumerate((a, b)):
                    at, g = 0, 0
                    for i, t in x:
                        groups[g][side].append(i)
                        at += len(t)
                        g += at == common[g]
        links = Counter()
        for a, b in groups:
            ca, cb = Counter(a), Counter(b)
            for x in ca:
                for y in cb:
                    links[x, y] += ca[x] * cb[y]
        docs_with.update(links.keys())
        found.append((doc_id, groups, links))
    most = defaultdict(int)
    for (a, _), n in docs_with.items():
        most[a] = max(most[a], n)
    shown = lambda groups: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return [
        (
            doc_id,
            sum(len(a) for a, _ in groups),
            sum(len(b) for _, b in groups),
            len(groups),
            sum(links.values()),
            sum(n for p, n in links.items() if docs_with[p] == most[p[0]]),
            sum(n * docs_with[p] for p, n in links.items()),
            hashlib.sha256(shown(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, groups, links in found
    ]


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def in_order(rows):
    return sorted(rows, key=str)


def test_alignment_of_the_whole_table(spark, docs):
    got = [tuple(r[c] for c in NAMES) for r in QUERIES["op11_token_alignment"](spark, SF).collect()]
    assert in_order(got) == in_order(brute_alignment([(i, t) for i, t, _ in docs]))


@pytest.mark.parametrize("block_bytes", [1, 40, 1 << 23])
def test_alignment_of_odd_texts(spark, odd, block_bytes):
    rows = odd.where("doc_id IS NULL OR doc_id != 6")
    got = [tuple(r[c] for c in NAMES) for r in align.align(rows, block_bytes=block_bytes).collect()]
    want = brute_alignment([(r[0], r[1]) for r in ODD if r[0] != 6])
    assert in_order(got) == in_order(want)
    assert [r[1] for r in want if r[0] in (2, 3, 8)] == [0, 0, 0] and max(r[4] for r in want) > 300_000
    assert align.align(odd.where("false")).collect() == []


def test_alignment_of_wide_groups(monkeypatch):
    """Groups are reduced before they are multiplied out, or not: the same links."""
    rng = random.Random(0)
    a, b = (np.array([rng.randrange(9) for _ in range(400)]) for _ in range(2))
    first = np.array([0, 3, 50, 51, 300])
    doc = np.array([0, 0, 1, 1, 4])
    want = Counter()
    for g, (lo, hi) in enumerate(zip(first, [*first[1:], 400])):
        want.update(((doc[g] * 9 + x) * 9 + y) for x in a[lo:hi] for y in b[lo:hi])
    for wide in (0, 64, 1 << 40):
        monkeypatch.setattr(align, "WIDE", wide)
        key, times = align.linked(a, b, first, first, doc, 9, 9)
        assert dict(zip(key.tolist(), times.tolist())) == want and (np.diff(key) > 0).all()


def test_tokenizer_takes_a_run_of_blanks_of_any_length():
    assert packing.plain_ids("a" + " " * 1_500_000 + "b").size > 1_000
    assert packing.token_ids(" " * 1_500_000 + "<|endoftext|>")[-2] == 50256


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_license_base_of_the_whole_table(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op12_license_scan"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        ws = words(text)
        places = [(k, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for k in range(len(ws)) if ws[k : k + len(p)] == p]
        labels = sorted({label for _, label in places})
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(ws), len(places), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        found = brute_detections(ws)
        assert r["labels"] == ",".join(sorted({*labels, *(f[0] for f in found)}))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(found or places)


def brute_detections(ws):
    """Every rule on the text without gates; each detection against all kept ones."""
    line = "".join(f" {w}" for w in ws) + " "
    kept = []
    for rule in licenses.rules():
        own = []
        for m in re.finditer(rf" (?:{rule.pattern})(?= )", line):
            start = line.count(" ", 0, m.start())
            own.append((rule.label, start, start + line.count(" ", m.start(), m.end())))
        kept += [f for f in own if not any(k[1] <= f[1] and f[2] <= k[2] for k in kept)]
    return kept


def test_license_rules():
    assert len(licenses.rules()) >= 400
    at = lambda text: {f.label for f in licenses.resolve(licenses.detect(licenses.words_line(text)))}
    assert at("Licensed under the GNU Lesser General Public License, version 2.1") == {"lgpl-2.1"}
    assert at("Redistribution and use in source and binary forms, with or without\nmodification, are permitted") == {"bsd"}
    assert at("under a 3-clause BSD license") == {"bsd-3-clause"}
    assert at("SPDX-License-Identifier: GPL-2.0-or-later\nSPDX-License-Identifier: MIT") == {"gpl-2.0", "mit"}
    assert at("Creative Commons Attribution-NonCommercial 4.0") == {"cc-by-nc-4.0"}
    assert at("mit freundlichen Lizenzen, apache helicopters, isc, by cc") == set()


@pytest.mark.parametrize("seed", range(6))
def test_license_gates_and_suppression_against_all_pairs(seed):
    rng = random.Random(seed)
    bits = [r.label.replace("-", " ") for r in licenses.rules()] + "gnu general public license version 3 the mit apache 2 0 license licensed under the terms of released cc by nc sa 4 0 creative commons attribution spdx license identifier bsd 3 clause lesser mozilla".split() * 12
    for _ in range(40):
        text = " ".join(rng.choice(bits) for _ in range(60))
        got = licenses.resolve(licenses.detect(licenses.words_line(text)))
        assert sorted((f.label, f.start, f.end) for f in got) == sorted(brute_detections(words(text)))


def test_license_scan_of_odd_texts(spark, odd):
    got = licenses.scan(odd).collect()
    assert len(got) == len(ODD) and licenses.scan(odd.where("false")).collect() == []
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["n_words"] == by[3]["n_words"] == by[4]["n_words"] == by[9]["n_words"] == 0 and by[2]["score"] == 0.0
    assert by[6]["n_words"] == 150_000
    assert [(p["label"], p["start"]) for p in by[-7]["base"]] == [("mit", 0), ("mit", 2), ("cc-by", 4)]
    # "license mit" and "license cc by sa" are short forms of their own
    assert [(p["label"], p["start"], p["end"]) for p in by[-7]["found"]] == [("mit", 0, 2), ("mit", 1, 3), ("mit", 2, 4), ("cc-by-sa-4.0", 3, 9)]


def test_license_scan_is_linear_in_long_texts():
    for text in ("mit license " * 30_000, "copyright " * 60_000, "licensed under the " * 40_000, "neither the name of " * 30_000, "a" * 1_000_000, "cc by nc " * 20_000):
        began = time.perf_counter()
        line = licenses.words_line(text)
        licenses.base_places(line)
        licenses.resolve(licenses.detect(line))
        assert time.perf_counter() - began < 8


def brute_audit(rows, labels):
    """rows: (doc_id, text, source). Every order walked document by document."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))

    def fails(i, text):
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        return "".join(
            f
            for f, bad in (
                ("A", len(ws) < 50),
                ("B", 100 * len(set(ws)) < 65 * len(ws)),
                ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)),
                ("D", re.search("[#$%&*|]", text)),
                ("E", i is not None and text in least and least[text] < i),
            )
            if bad
        )

    failed = [(s or "", i, fails(i, t)) for i, t, s in rows]
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, _, _ in failed}:
            for step, f in enumerate(order):
                before = set(order[:step])
                here = [(i, x) for p, i, x in failed if p == part]
                removed = [i for i, x in here if f in x and not before & set(x)]
                out[part, order, step + 1] = [
                    sum(not (before | {f}) & set(x) for _, x in here),
                    len(removed),
                    sum(f in x and bool(before & set(x)) for _, x in here),
                    sum(x == f for _, x in here),
                    sum(i in good for i in removed),
                    sum(i in toxic for i in removed),
                ]
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


AUDITED = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in AUDITED) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_of_the_whole_table(spark, docs):
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    assert audited(QUERIES["op13_filter_audit"](spark, SF)) == brute_audit(docs, labels)


def test_audit_matches_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    cur = con.execute(ORACLES["op13_filter_audit"])
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, cur.fetchall())) == sorted(tuple(r) for r in QUERIES["op13_filter_audit"](spark, SF).select(*names).collect())


def test_audit_of_odd_texts(spark, odd, monkeypatch):
    rows = [(1, 1, 0), (1, 1, 1), (5, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1), (4, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    want = brute_audit([(r[0], r[1], r[3]) for r in ODD], rows)
    assert audited(audit.audit(odd, labels)) == want
    monkeypatch.setattr(audit, "PARTS", 1)
    assert audited(audit.audit(odd.repartition(3), labels)) == want
    assert audit.audit(odd.where("false"), labels).collect() == []
    assert {v[4:6] for v in audited(audit.audit(odd, labels.where("false"))).values()} == {(0, 0)}


def test_bitmap_of_many_parts():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    part, flags = rng.integers(0, 70, 5_000), {c: rng.random(5_000) < 0.3 for c in ("A", "B", "good", "toxic")}
    index = audit.Index(pa.array([f"p{p}" for p in part]), flags)
    counts = dict(zip(index.parts, audit.prefix_counts(index, "AB").tolist()))
    for p in range(70):
        own = part == p
        for s in range(4):
            left = own & ~(flags["A"] & bool(s & 1)) & ~(flags["B"] & bool(s & 2))
            assert counts[f"p{p}"][s] == [left.sum(), (left & flags["good"]).sum(), (left & flags["toxic"]).sum()]
