"""Cross-tokenizer alignment of two tokenizations of every text, and the corpus counts of linked ids.

Token spans are byte ranges, so both tokenizations of a text cover the same bytes without gaps. The
B tokens' ends and starts, in order, are a static interval index: two bisections of each A token's
range give the first and the last B token that it overlaps. Where the last B token of one A token
ends before the first of the next begins, no B token spans the gap between them, and the gap is a
group boundary. All A-B occurrence pairs inside a group are links.

Texts are read once, in blocks of about BLOCK bytes of text: a block is one row with the results
of its documents, its distinct id pairs with the number of its documents that link them, and each
document's pairs as indices into these. Only (block, pair) rows are exchanged to count pairs over
the corpus and to bring the counts back; documents are never spread out into pair rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import saved
from barloom.llm.packing import encoder, plain_ids

BLOCK = 4 << 20
#: Groups with more occurrence pairs than this are reduced to distinct ids before they are multiplied out.
WIDE = 64
SPACE = "▁"


class Tokenizers:
    """Byte-level A (a tokenizers file) and piece-wise B (a sentencepiece model) with each id's bytes."""

    def __init__(self, a_file: str | None = None, b_file: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.a_file = a_file
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file or public_tokenizers.path("piece_bpe_32k.model"))
        a, n_b = encoder(a_file), self.b.get_piece_size()
        self.a_bytes = [b""] * a.n_vocab
        for token in a.token_byte_values():
            self.a_bytes[a.encode_single_token(token)] = token
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i in range(n_b) for p in [self.b.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # a token's decimal id with what follows it: within its side of a group, at the side's end
        shown = [b"%d%s" % (i, mark) for n, ends in ((len(self.a_bytes), b",|"), (n_b, b",;")) for mark in (ends[:1], ends[1:]) for i in range(n)]
        self.shown = np.empty(len(shown), object)
        self.shown[:] = shown

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """A's and B's ids of space+text; none if the text is empty or the bytes of either side differ from it."""
        if text:
            raw = b" " + text.encode()
            a, b = plain_ids(" " + text, self.a_file), self.b.encode(text)
            if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b)):
                return a.astype(np.int64), np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def tokenizers(a_file: str | None = None, b_file: str | None = None) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def groups(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A token and first B token of every group, by stabbing queries. Both cover the same bytes; no token is empty."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    low = np.searchsorted(b_end, a_end - a_size, "right")  # the first B token that ends after the A token's start
    high = np.searchsorted(b_end - b_size, a_end, "left")  # the B tokens before this one start before its end
    first_a = np.flatnonzero(np.r_[np.ones(min(1, len(low)), bool), low[1:] >= high[:-1]])
    return first_a, low[first_a]


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def linked(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, doc: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (doc * n_a + a id) * n_b + b id of all links, distinct and in order, and how often each occurs."""
    size_a, size_b = np.diff(np.append(first_a, len(a))), np.diff(np.append(first_b, len(b)))
    wide = size_a * size_b > WIDE
    plain = np.flatnonzero(~wide)
    pairs = (size_a * size_b)[plain]
    group, rank = np.repeat(plain, pairs), _ranks(pairs)
    keys = [(doc[group] * n_a + a[first_a[group] + rank // size_b[group]]) * n_b + b[first_b[group] + rank % size_b[group]]]
    times = [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(wide).tolist():
        ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        keys.append((((doc[g] * n_a + ids_a) * n_b)[:, None] + ids_b).ravel())
        times.append((times_a[:, None] * times_b).ravel())
    key, many = np.concatenate(keys), np.concatenate(times)
    if not len(key):
        return key, many
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(many[order], start)


def digests(models: Tokenizers, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups as text; empty for documents without tokens. end_a, end_b: the documents' ends."""
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[np.append(first_a[1:], len(a))[: len(first_a)] - 1] = True
    last_b[np.append(first_b[1:], len(b))[: len(first_b)] - 1] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    shown = np.empty(len(a) + len(b), np.int64)
    ends_a = np.append(first_a[1:], len(a))
    n_a, n_b = len(models.a_bytes), len(models.b_bytes)
    shown[np.arange(len(a)) + first_b[group_a]] = a + n_a * last_a
    shown[np.arange(len(b)) + ends_a[group_b]] = 2 * n_a + b + n_b * last_b
    written = models.shown[shown].tolist()
    out, at = [], 0
    for end in (end_a + end_b).tolist():
        out.append(hashlib.sha256(b"".join(written[at:end])[:-1]).hexdigest() if end > at else "")
        at = end
    return out


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _block(models: Tokenizers, texts: list[str | None]) -> dict:
    both = [models.ids(t) for t in texts]
    count_a, count_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in both]) for k in (0, 1))
    end_a, end_b = np.cumsum(count_a), np.cumsum(count_b)
    first_a, first_b = groups(models.a_size[a], models.b_size[b])
    doc = np.searchsorted(end_a, first_a, "right")
    size = np.diff(np.append(first_a, len(a))) * np.diff(np.append(first_b, len(b)))
    sums = np.append(0, np.cumsum(size))
    upto = np.searchsorted(doc, np.arange(len(texts) + 1))
    n_a, n_b = len(models.a_bytes), len(models.b_bytes)
    key, times = linked(a, b, first_a, first_b, doc, n_a, n_b)
    pair, index, docs_with = np.unique(key % (n_a * n_b), return_inverse=True, return_counts=True)
    return {
        "n_a": count_a,
        "n_b": count_b,
        "n_groups": np.diff(upto),
        "n_links": np.diff(sums[upto]),
        "groups_sha256": digests(models, a, b, first_a, first_b, end_a, end_b),
        "pair": pair,
        "docs_with": docs_with,
        # of each document in turn: how many distinct pairs, which (as steps), how often
        "sizes": _packed(np.bincount(key // (n_a * n_b), minlength=len(texts)).astype(np.int32)),
        "steps": _packed(np.diff(index, prepend=0).astype(np.int32)),
        "times": _packed(times),
    }


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """One row a block of documents: block, doc_id and results as arrays, pairs and packed pair lists."""
    slim = docs.select("doc_id", "text")
    long = lambda *names: [F.array(F.lit(0).cast("long")).alias(n) for n in names]
    schema = slim.select(F.lit(0).cast("long").alias("block"), F.array("doc_id").alias("doc_id"), *long(*COUNTS), F.array(F.lit("")).alias("groups_sha256"), *long("pair", "docs_with"), *[F.lit(b"").alias(n) for n in ("sizes", "steps", "times")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = tokenizers(a_file, b_file)
        block = TaskContext.get().partitionId() << 32
        texts: list[str | None] = []
        ids: list[pa.Array] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal held, block
            found = _block(models, texts)
            found |= {"block": block, "doc_id": pa.concat_arrays(ids)}
            row = [pa.array([found[f.name]]) if not isinstance(found[f.name], (pa.Array, np.ndarray)) else pa.ListArray.from_arrays(pa.array([0, len(found[f.name])], pa.int32()), pa.array(found[f.name])) for f in schema]
            texts.clear()
            ids.clear()
            held, block = 0, block + 1
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                texts.append(text)
                held += len(text) if text else 1
                if held >= block_bytes:
                    ids.append(batch.column("doc_id").slice(start, i + 1 - start))
                    start = i + 1
                    yield out()
            if start < batch.num_rows:
                ids.append(batch.column("doc_id").slice(start))
        if texts:
            yield out()

    return slim.mapInArrow(run, schema)


def pair_counts(dealt: DataFrame, b_ids: int) -> DataFrame:
    """pair (a id * b_ids + b id), count (documents that link it), best (1 if no pair of the A id has more)."""
    each = dealt.select(F.explode(F.arrays_zip("pair", "docs_with")).alias("x"))
    counts = saved(each.groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.docs_with").alias("count")), "align-counts")
    a_id = F.floor(F.col("pair") / b_ids)
    # one row for each id of A that occurs: its vocabulary bounds the table, whatever the corpus
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("most"))
    return counts.withColumn("a_id", a_id).join(F.broadcast(most), "a_id").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    Null and empty texts, and texts whose tokens' bytes differ from space+text on either side, have no
    tokens: zeros and an empty digest. A very long text is a block of its own; a group's memory is that of
    its distinct id pairs. Repeated rows are documents of their own, in the counts too; ties for the highest
    count are all best; null ids are kept; an empty table gives no rows; other columns are ignored."""
    import public_tokenizers
    import sentencepiece

    b_ids = sentencepiece.SentencePieceProcessor(model_file=b_file or public_tokenizers.path("piece_bpe_32k.model")).get_piece_size()
    dealt = saved(blocks(docs, a_file, b_file, block_bytes), "align-blocks")
    asked = dealt.select(F.col("block").alias("of_block"), F.explode("pair").alias("pair")).join(pair_counts(dealt, b_ids), "pair").select("of_block", "pair", "count", "best")
    held = dealt.drop("pair", "docs_with")
    schema = dealt.select(F.col("doc_id")[0].alias("doc_id"), *[F.lit(0).cast("long").alias(c) for c in (*COUNTS, "n_best", "count_sum")], F.lit("").alias("groups_sha256")).schema

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")  # the order in which the block numbers them
        row = {c: left.column(c).combine_chunks() for c in left.column_names}
        size, step, times = (_unpacked(row[c][0].as_py(), kind) for c, kind in (("sizes", np.int32), ("steps", np.int32), ("times", np.int64)))
        index, end = np.cumsum(step), np.append(0, np.cumsum(size))
        total = lambda c: np.diff(np.append(0, np.cumsum(right.column(c).to_numpy()[index] * times))[end])
        made = {"n_best": pa.array(total("best")), "count_sum": pa.array(total("count"))}
        return pa.table({f.name: made.get(f.name, row[f.name].flatten() if f.name in row else None) for f in schema})

    return held.groupBy("block").cogroup(asked.groupBy("of_block")).applyInArrow(fill, schema)
