"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import mixing, packing, secrets, simhash, toxicity
from barloom.llm.common import saved, table, text_of

#: The least likeness of near copies.
LIKENESS = 0.8


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the stage changed it."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic at the operator's threshold go. Null and empty texts have no toxic words and stay
    as the labels have it; repeated rows fare alike; an empty table gives no rows."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, scorer, docs.columns, out="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word shingles at a likeness of 0.8, the document with the least id
    stays, null ids last; of repeated rows one stays."""
    return simhash.first_of_near_copies(docs, LIKENESS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is replaced by a mark; all documents, nulls and repeated rows stay."""
    return _sized(secrets.redacted(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Where it takes a part, the first words of that
    share, joined by single spaces, are the text. Texts without words cost nothing and weigh nothing: they are
    taken as the draw has it; a null source is a source of its own; repeated rows are documents of their own;
    an empty table gives no rows."""
    # rows are numbered in a table, so that no two share a key
    key = "_key"
    while any(c.startswith(key) for c in docs.columns):
        key = "_" + key
    numbered = saved(docs.withColumn(key, F.monotonically_increasing_id()), "mix-numbered")
    taken = mixing.mix(numbered, keep=[key]).where("copies > 0").select(key, F.col("copies").alias(f"{key}_copies"))
    copies = F.col(f"{key}_copies")
    # dealt out by key at any size: the numbers of all documents are too many to be sent to every executor
    rows = numbered.join(taken.hint("merge"), key).withColumn(f"{key}_copy", F.explode(F.sequence(F.lit(1), F.ceil(copies).cast("int"))))
    share = copies - F.col(f"{key}_copy") + 1
    words = F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")
    part = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.round(share * mixing.word_count(text_of())).cast("int"))), " ")
    cut = rows.withColumn("text", F.when(share < 1 - 1e-9, part).otherwise(F.col("text")))
    return _sized(cut.select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens. A null or empty text is its end id alone;
    repeated rows are packed each; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Model scores, sampling and tokenizers are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
