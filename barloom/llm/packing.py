"""Mixture-controlled packing of tokenized documents into sequences by deficit round-robin.

Texts are read once: each document's ids (and its end id) are cut where only the document
decides, into pieces of PIECE tokens and then the powers of two of the rest, and a piece's
checksum is taken there. From then on only piece headers move.

A source's pieces queue in hash order. Partition b of P takes the same span [b/P, (b+1)/P) of
every queue, so it holds the sources in their target proportions; what the cut between two
pieces left over or short is the deficit that the partition starts with. In a partition,
every round credits each source with its share of a sequence, and a source is served while
its deficit covers the next piece. Where the next piece is larger than what a sequence has
left, smaller pieces fill the gap and are charged to their sources: since pieces are powers
of two, sequences are full but for the last of a partition.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import saved

LENGTH = 2048
PIECE = 256
END = 1
PART_TOKENS = 1 << 20
LOCAL_BITS = 24


@lru_cache(maxsize=4)
def encoder(vocabulary: str | None = None):
    """Byte-level BPE of a tokenizers file by tiktoken, which gives the same ids sooner: its ranks are the
    merged vocabulary, and the file's added tokens, which its texts are cut at first, are its special tokens.

    vocabulary: path of a tokenizers file of this kind; by default the installed byte_bpe_50k.json."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"]):
        raise ValueError("added tokens with rules of their own are not supported")
    # the file spells bytes as printable characters: those that print stand for themselves, the rest follow from 256
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=8)
def slow_encoder(vocabulary: str | None, plain: bool):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = plain
    return made


def _ids(text: str, vocabulary: str | None, plain: bool) -> np.ndarray:
    try:
        return encoder(vocabulary).encode_to_numpy(text, allowed_special=set() if plain else "all", disallowed_special=())
    except ValueError:  # its pattern gives up on runs of more than about a million blanks
        return np.array(slow_encoder(vocabulary, plain).encode(text, add_special_tokens=False).ids, np.uint32)


def plain_ids(text: str, vocabulary: str | None = None) -> np.ndarray:
    """The text's ids; strings of added tokens are plain text."""
    return _ids(text, vocabulary, True)


def token_ids(text: str | None, vocabulary: str | None = None) -> np.ndarray:
    """The text's ids and the end id. The string of an added token in a text is that token, as tokenizers has it."""
    ids = _ids(text, vocabulary, False) if text else np.zeros(0, np.uint32)
    return np.append(ids, np.uint32(END)).astype("<u4")


def cuts(n: int, piece: int = PIECE) -> list[int]:
    """Lengths of a document's pieces: full ones, then the powers of two of the rest, largest first."""
    rest = n % piece
    return [piece] * (n // piece) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pieces(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, source key, tie, start, length, ids_crc32, doc_tokens."""
    slim = docs.select("doc_id", F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("null")).alias("skey"), F.xxhash64("doc_id", "text").alias("tie"), "text")
    schema = slim.select("doc_id", "skey", "tie", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = token_ids(text, vocabulary)
                data, at = memoryview(ids.view(np.uint8)), 0
                for n in cuts(len(ids)):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                    at += n
                total += [len(ids)] * (len(row) - len(total))
            at_row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at_row) for c in ("doc_id", "skey", "tie")] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)], names=schema.names)

    return slim.mapInArrow(run, schema)


def queued(cut: DataFrame, buckets: int) -> DataFrame:
    """Pieces plus x (tokens of the source before the piece), source_tokens and all_tokens; no source is ordered in one task."""
    bucketed = cut.withColumn("bucket", F.pmod(F.col("tie"), F.lit(buckets)))
    sums = bucketed.groupBy("skey", "bucket").agg(F.sum("length").alias("bucket_tokens"))
    earlier, whole = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("skey")
    starts = sums.select("skey", "bucket", F.coalesce(F.sum("bucket_tokens").over(earlier), F.lit(0)).alias("x0"), F.sum("bucket_tokens").over(whole).alias("source_tokens"))
    within = Window.partitionBy("skey", "bucket").orderBy("tie", "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    ran = bucketed.withColumn("x1", F.coalesce(F.sum("length").over(within), F.lit(0)))
    return ran.join(starts, ["skey", "bucket"]).withColumn("x", F.col("x0") + F.col("x1")).drop("x0", "x1", "bucket")


def round_robin(pdf: pd.DataFrame, part: int, parts: int, all_tokens: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Local sequence number and offset of each row. Rows: skey, x, length, source_tokens, ordered by (skey, x)."""
    sizes = pdf["length"].tolist()
    seq, off = [0] * len(sizes), [0] * len(sizes)
    # a queue for each source and piece size, in order; the head of a source is its least index
    queues: list[dict[int, deque[int]]] = []
    deficit: list[float] = []
    share: list[float] = []
    keys = pdf["skey"].to_numpy()
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() + [len(keys)]
    for a, b in zip(edges, edges[1:]):
        by_size: dict[int, deque[int]] = {}
        for i in range(a, b):
            by_size.setdefault(sizes[i], deque()).append(i)
        queues.append(by_size)
        tokens = int(pdf["source_tokens"].iat[a])
        share.append(tokens / all_tokens)
        deficit.append(tokens * (part / parts) - int(pdf["x"].iat[a]))
    now, room = 0, length

    def put(s: int, n: int) -> None:
        nonlocal now, room
        i = queues[s][n].popleft()
        if not queues[s][n]:
            del queues[s][n]
        seq[i], off[i] = now, length - room
        deficit[s] -= n
        room -= n
        if not room:
            now, room = now + 1, length

    def fill() -> bool:
        """The largest piece that fits in what the sequence has left, of the source with the largest deficit; False if none."""
        fits = max((n for q in queues for n in q if n <= room), default=0)
        if fits:
            put(max((s for s, q in enumerate(queues) if fits in q), key=lambda s: deficit[s]), fits)
        return bool(fits)

    live = list(range(len(queues)))
    while live:
        for s in live:
            deficit[s] += share[s] * length
            while queues[s]:
                n = min(queues[s], key=lambda k: queues[s][k][0])  # the size of the queue's head
                if deficit[s] < n:
                    break
                if n <= room:
                    put(s, n)
                elif not fill():  # nothing left is small enough: pad
                    now, room = now + 1, length
        live = [s for s in live if queues[s]]
    return np.array(seq, np.int64), np.array(off, np.int64)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_key for every piece.

    A null or empty text is the end id alone; a null source is a source of its own; repeated rows
    are packed as often as they occur; an empty table gives no rows; other columns are ignored.
    Padding: less than one sequence for every PART_TOKENS tokens."""
    cut = saved(pieces(docs, vocabulary), "pack-pieces")
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    parts = max(1, round(tokens / PART_TOKENS))
    # the share of a queue before a piece's middle decides its partition
    middle = (F.col("x") + F.col("length") / 2) / F.col("source_tokens")
    # a bucket of a queue holds about a partition's tokens at most, whatever the size of the input
    dealt = queued(cut, 64 + 2 * parts).withColumn("part", F.least(F.floor(middle * parts), F.lit(parts - 1)).cast("long"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "skey"]
    schema = dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "skey").schema

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("skey", "ascending"), ("x", "ascending")])
        part = int(key[0].as_py())
        pdf = table.select(["skey", "x", "length", "source_tokens"]).to_pandas()
        seq, off = round_robin(pdf, part, parts, tokens, length)
        return table.select(names[:5]).append_column("sequence_id", pa.array((part << LOCAL_BITS) + seq)).append_column("offset", pa.array(off)).append_column("skey", table["skey"])

    return dealt.groupBy("part").applyInArrow(run, schema).withColumnRenamed("skey", "source_key")
