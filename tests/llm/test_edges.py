"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import fingerprints, lm, mixing, packing, search, secrets, sharding, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = ["score", "size", "key", "bucket", "sha", "parts", "base", "fp", "group", "node", "n", "word", "tie", "pi", "y", "block", "part", "skey", "guest"]
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(150_000))
KEY = "AKIA" + "ABCDEFGH12345678"
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 3),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 3),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "en", "b", 4),
    (None, "a text without an id in it at all", "en", "b", 5),
    (None, None, None, None, None),
    (5, "ONE Two three four five six seven eight nine ten eleven twelve", "en", None, 1),
    (6, LONG, "en", "a", len(LONG)),
    (-7, "word", "de", "", 4),
    (8, f"{KEY} then secret = abcdef123456 at https://host.example/x \U0001f600 é", "en", "c", 1),
    (9, "<|endoftext|> is a token", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (8, 0, 1), (8, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def operators(labels):
    pages = lambda d: d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "key", "parts")
    asked = lambda d: d.where("doc_id % 2 = 0 OR doc_id IS NULL").select(F.col("doc_id").alias("query_id"), "text", "score")
    return {
        "simhash": (lambda d: simhash.near_duplicates(d), 12),
        "warc": (lambda d: warc.archived(pages(d)), 12),
        "lm": (lambda d: lm.score(d), 12),
        "sharding": (lambda d: sharding.shard_documents(d), 12),
        "packing": (lambda d: packing.pack(d).select("doc_id", "start"), None),
        "search": (lambda d: search.search(d, asked(d)), None),
        "secrets": (lambda d: secrets.scan(d), 12),
        "mixing": (lambda d: mixing.mix(d), 12),
        "toxicity": (lambda d: toxicity.toxicity(d, labels.where("toxic IS NOT NULL OR doc_id = 2")), 12),
        "fingerprints": (lambda d: fingerprints.fingerprint_documents(d), 12),
    }


@pytest.mark.parametrize("name", ["simhash", "warc", "lm", "sharding", "packing", "search", "secrets", "mixing", "toxicity", "fingerprints"])
def test_operators(odd, labels, name):
    run, n = operators(labels)[name]
    got = run(odd).collect()
    assert len(got) == n if n else got
    assert run(odd.where("false")).collect() == []


def test_defined_results(odd, labels):
    sim = simhash.near_duplicates(odd).collect()
    assert {r["component_id"] for r in sim if r["fp"] == 0} == {2}
    assert {r["component_id"] for r in sim if r["doc_id"] in (1, 5)} == {1}
    scored = lm.score(odd).collect()
    assert {r["n_tokens"] for r in scored if r["doc_id"] in (2, 3, 4)} == {1}
    assert [r["n_tokens"] for r in scored if r["doc_id"] == 6] == [150_001]
    found = {r["doc_id"]: r for r in secrets.scan(odd).where("doc_id IS NOT NULL").collect()}
    assert [p["kind"] for p in found[8]["parts"]] == [1, 0, 3] and found[6]["parts"] == []
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(odd).where("doc_id IS NOT NULL").collect()}
    assert tokens[2] == tokens[3] == 1 and tokens[9] == 5
    mixed = mixing.mix(odd).collect()
    assert {r["taken"] for r in mixed if r["size"] == 0} == {0}
    near = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(odd).where("doc_id IS NOT NULL").collect()}
    assert near[3]["near_next"] == 1.0 and near[3]["fingerprint"] == near[2]["fingerprint"]


def test_weak_parts_count_only_in_company(spark):
    texts = ["see https://host.example/path for more", "https://host.example/path with password=hunter2hunter2", "https://host.example/path " + "x " * 300 + "password=hunter2hunter2", f"user=admin only, {KEY}"]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[secrets.KINDS[p["kind"]] for p in r["parts"]] for r in got] == [[], ["endpoint", "assign"], ["assign"], ["access"]]


def test_mixing_landing_problem_is_small(spark):
    rows = [(i, "abc"[i % 7 % 3], "w " * (i * 31 % 97)) for i in range(9000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert got.where("copies != floor(copies)").groupBy("source").count().agg(F.max("count")).first()[0] in (None, 1, 2)
    off = got.groupBy("source").agg(F.abs(F.sum("taken") - F.first("target")).alias("off")).agg(F.max("off")).first()[0]
    assert off <= 2


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, odd, k, tmp_path_factory):
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, 1, 0), (8, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, odd, str(sf))
    if k < 4:
        assert out.columns == odd.columns
    assert out.count() > 0
    assert stage(spark, odd.where("false"), str(sf)).count() == 0
