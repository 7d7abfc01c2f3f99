"""Exact BM25 top-k over sharded inverted indexes with block-max WAND pruning.

Index. Each scan task turns runs of SHARD documents into one inverted index: terms (64-bit
hashes of words), their documents and frequencies. Indexes are rows of a table in the shared
folder; every document is in one of them. Documents with few words in common, as those of
different languages, go to different indexes, which bounds then leave out for a query at once.

Statistics. Document count, average length and document frequencies come from all shards, so
scores of different shards compare.

Search. Queries go out in blocks bounded by their number and that of their terms. In a shard, a
query's terms have upper bounds w * (largest impact); if their sum stays under the query's
threshold, the shard is done. Postings of the terms with the largest bounds are added up first;
the k-th best of these sums, or the best score known so far, is the threshold. More terms follow
until the bounds of all others stay under it and the candidates are few: postings of those others
are never read. A document is a candidate if its sum and the block maxima of the terms left out
reach the threshold, and only candidates are scored, from their own lists of terms. Where bounds
leave out few postings, as with the words of a whole text, queries are added up together: for a shard
of another language, a query's rarer terms down to those that may add a third of its threshold; else all, where the
impacts of words in many documents are a matrix of short floats that meets all their weights at
once; what comes near enough to the threshold for their rounding is scored anew. Shards go in
waves, each four times the last, so all but the first waves prune against a nearly final threshold
and return few rows.
Merging the shards' lists by score, then doc_id, is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import saved, words_of

K1, B = 1.2, 0.75
SHARD, BLOCK = 8192, 64
#: Terms that are added up before there is a threshold of the shard's own.
FIRST = 24
QUERY_BLOCK, BLOCK_TERMS = 1 << 14, 1 << 21
#: Queries that meet the matrix together, rarer postings that are added up together, and the most words of the matrix.
TOGETHER, POSTINGS, DENSE = 128, 1 << 16, 2048
#: All postings of a query for one that must be read (and a thousand more), from which on it is answered by itself: `top`
#: takes longer for each.
ALONE = 128
#: Documents of a shard for one that has a word of the matrix.
DENSITY = 32
#: The share of a threshold that the terms of a query which are not read may add, where the others have few postings.
LEFT_OUT = 0.35
#: Terms of queries whose bounds are looked at together.
CHUNK_TERMS = 1 << 17
#: Shards of documents that are parted by words, the fewest documents to be parted and of a part, the words by which it
#: is done, and the likeness (cosine) of two parts' words from which on they stay one.
PARTED, LEAST_PARTED, LEAST_PART, PART_WORDS, ONE_PART = 4, 4096, 512, 256, 0.5
FIRST_WAVE = 12.0
DIGITS = 9
INDEX = "shard long, n int, words long, doc_ids binary, null_ids binary, lengths binary, terms array<bigint>, df array<int>, docs binary, tf binary"


def term_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of two bytes each where they fit, else four: `unpacked` tells by the length."""
    return numbers.astype("<u2" if not len(numbers) or numbers.max() < 1 << 16 else "<i4").tobytes()


def unpacked(numbers: bytes, n: int) -> np.ndarray:
    return np.frombuffer(numbers, "<u2" if len(numbers) == 2 * n else "<i4")


def parts_of(terms: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers of documents (terms: the distinct ones of each), parted so that parts have few words in common: halves along
    the direction in which the documents' frequent words differ most, as long as the halves' words differ."""
    n = len(terms)
    if n < LEAST_PARTED:
        return [np.arange(n)]
    found, count = np.unique(np.concatenate(terms[:: -(-n // 4096)]), return_counts=True)
    often = np.sort(found[np.argsort(-count, kind="stable")[:PART_WORDS]])
    if not len(often):
        return [np.arange(n)]
    has = np.zeros((n, len(often)), np.float32)
    for i in range(0, n, 1024):
        t = np.concatenate(terms[i : i + 1024])
        at = np.minimum(np.searchsorted(often, t), len(often) - 1)
        hit = often[at] == t
        has[np.repeat(np.arange(i, min(n, i + 1024)), [len(x) for x in terms[i : i + 1024]])[hit], at[hit]] = 1
    has /= np.maximum(1, np.sqrt(has.sum(axis=1, keepdims=True)))
    todo, done = [np.arange(n)], []
    while todo:
        part = todo.pop()
        rows = has[part]
        mean = rows.mean(axis=0)
        v = np.cos(np.arange(len(often), dtype=np.float32))  # any start, the same each time
        for _ in range(20 if len(part) >= 2 * LEAST_PART else 0):
            v = (rows @ v - mean @ v) @ rows
            v /= max(float(np.sqrt(v @ v)), 1e-9)
        side = rows @ v > mean @ v
        a, b = rows[side].sum(axis=0), rows[~side].sum(axis=0)
        apart = min(side.sum(), (~side).sum()) >= LEAST_PART and a @ b < ONE_PART * np.sqrt((a @ a) * (b @ b))
        (todo if apart else done).extend([part[side], part[~side]] if apart else [part])
    return done


def build(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row a shard; docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, hashes = 0, {}
        ids: list = []
        terms, freqs, lengths = [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for part in parts_of(terms):
                for own in np.array_split(part, -(-len(part) // shard)):
                    yield index(own.tolist())
                    made += 1
            for x in (ids, terms, freqs, lengths):
                x.clear()

        def index(own: list[int]) -> pa.RecordBatch:
            t, f = np.concatenate([terms[i] for i in own]), np.concatenate([freqs[i] for i in own])
            d = np.repeat(np.arange(len(own), dtype=np.int32), [len(terms[i]) for i in own])
            order = np.argsort(t, kind="stable")
            distinct, first = np.unique(t[order], return_index=True)
            df = np.diff(np.r_[first, len(t)])
            n_words, named = np.array([lengths[i] for i in own], "<i4"), [ids[i] for i in own]
            row = [(TaskContext.get().partitionId() << 24) + made, len(own), int(n_words.sum()), np.array([i or 0 for i in named], "<i8").tobytes(), np.array([i is None for i in named], np.uint8).tobytes(), n_words.tobytes(), None, None, packed(d[order]), packed(f[order])]
            arrays = [pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.null(), pa.null(), pa.binary(), pa.binary()), strict=True)]
            at = pa.array([0, len(distinct)], pa.int32())
            arrays[6], arrays[7] = pa.ListArray.from_arrays(at, pa.array(distinct, pa.int64())), pa.ListArray.from_arrays(at, pa.array(df, pa.int32()))
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "n", "words", "doc_ids", "null_ids", "lengths", "terms", "df", "docs", "tf"])

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ws = words_of(text.as_py())
                count = Counter(ws)
                if len(hashes) > 400_000:
                    hashes.clear()
                for w in count:
                    if w not in hashes:
                        hashes[w] = term_of(w)
                ids.append(i)
                lengths.append(len(ws))
                terms.append(np.fromiter((hashes[w] for w in count), np.int64, len(count)))
                freqs.append(np.fromiter(count.values(), np.int32, len(count)))
                if len(ids) == PARTED * shard:
                    yield from close()
        if ids:
            yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def idf(df: Column, rows: int) -> Column:
    return F.log1p((F.lit(float(rows)) - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, index: DataFrame, rows: int) -> DataFrame:
    """query (hash of id and text), query_id, term, weight (idf): all distinct words of each whole text that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term = [], []
            for i, text in enumerate(batch.column("text")):
                found = [term_of(w) for w in set(words_of(text.as_py()))]
                row += [i] * len(found)
                term += found
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("query", "query_id")), pa.array(term, pa.int64())], names=["query", "query_id", "term"])

    split = queries.mapInArrow(run, "query long, query_id long, term long")
    df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    # not by Spark's sizes, which take the words of a text for one row
    return split.join(df.hint("merge"), "term").select("query", "query_id", "term", idf(F.col("df"), rows).alias("weight"))


class Shard:
    """One inverted index with impacts and block maxima; `read` counts the postings that were looked at."""

    def __init__(self, row: dict, mean_length: float, block: int = BLOCK) -> None:
        self.ids, self.null, self.block = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["null_ids"], np.uint8), block
        lengths = np.frombuffer(row["lengths"], "<i4")
        self.terms, df = np.asarray(row["terms"]), np.asarray(row["df"])
        self.start = np.r_[0, np.cumsum(df, dtype=np.int64)]
        self.docs, tf = unpacked(row["docs"], self.start[-1]), unpacked(row["tf"], self.start[-1]).astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / mean_length))[self.docs])
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if len(df) else np.zeros(0)
        self.n_blocks = -(-len(self.ids) // block)
        self.read = 0

    @cached_property
    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks and their largest impacts, term by term, and where each term's begin."""
        blocks = self.docs // self.block
        edge = np.ones(len(blocks), bool)
        edge[1:] = blocks[1:] != blocks[:-1]
        edge[self.start[:-1]] = True
        cut = np.flatnonzero(edge)
        return blocks[cut], np.maximum.reduceat(self.impact, cut) if len(cut) else np.zeros(0), np.searchsorted(cut, self.start)

    @cached_property
    def doc_start(self) -> np.ndarray:
        return np.r_[0, np.cumsum(np.bincount(self.docs, minlength=len(self.ids)))]

    @cached_property
    def by_doc(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each posting's term and impact, document by document, and weights of the query at hand."""
        order = np.argsort(self.docs, kind="stable")
        return np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.start))[order], self.impact[order], np.zeros(len(self.terms))

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Each term's row in the matrix, -1 if it has none, and the matrix: impacts of the terms that many documents have."""
        df = np.diff(self.start)
        often = np.argsort(-df, kind="stable")[:DENSE]
        often = often[df[often] * DENSITY > len(self.ids)]
        at = np.full(len(df), -1, np.int32)
        at[often] = np.arange(len(often))
        matrix = np.zeros((len(often), len(self.ids)), np.float32)
        for i, t in enumerate(often.tolist()):
            p = slice(self.start[t], self.start[t + 1])
            matrix[i, self.docs[p]] = self.impact[p]
        return at, matrix

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where each term is in this index, -1 if it isn't."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1)

    def summed(self, t: np.ndarray, w: np.ndarray, sums: np.ndarray) -> None:
        """Add the terms' postings to the documents' sums."""
        posts = [slice(a, b) for a, b in zip(self.start[t].tolist(), self.start[t + 1].tolist())]
        docs = np.concatenate([self.docs[p] for p in posts])
        self.read += len(docs)
        sums += np.bincount(docs, np.concatenate([self.impact[p] * x for p, x in zip(posts, w.tolist())]), len(sums))

    def exact(self, docs: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The whole scores of documents, from their own lists of terms."""
        term_of, impact, weight = self.by_doc
        weight[t] = w
        n = self.doc_start[docs + 1] - self.doc_start[docs]
        start = np.r_[0, np.cumsum(n)]
        posts = np.repeat(self.doc_start[docs] - start[:-1], n) + np.arange(start[-1])
        self.read += len(posts)
        out = np.add.reduceat(weight[term_of[posts]] * impact[posts], start[:-1])
        weight[t] = 0.0
        return np.round(out, DIGITS)

    def top(self, t: np.ndarray, w: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents (local numbers) and scores of the k best with a score of at least `least`.
        t: places of the query's terms, as `places` gives them; w: their weights."""
        none = np.zeros(0, np.int64), np.zeros(0)
        t, w = t[t >= 0], w[t >= 0]
        bound = w * self.most[t]
        slack = 10.0**-DIGITS  # rounding of scores never prunes
        if not len(t) or bound.sum() + slack < least:
            return none
        order = np.argsort(-bound, kind="stable")
        t, w = t[order], w[order]
        rest = bound.sum() - np.cumsum(bound[order])  # what the terms after each can still add
        left = np.r_[0, np.cumsum(self.start[t + 1] - self.start[t])]
        left = left[-1] - left  # postings of the terms from each on
        sums, n, more = np.zeros(len(self.ids)), 0, min(FIRST, len(t))
        while True:
            self.summed(t[n:more], w[n:more], sums)
            n = more
            if np.count_nonzero(sums) >= k:
                least = max(least, float(np.partition(sums, -k)[-k]) - slack)
            # essential terms: the others' bounds together stay under the threshold
            essential = min(len(t), int(np.searchsorted(-rest, slack - least, side="right")) + 1 if least > 0 else len(t))
            if essential > n:
                more = min(essential, 2 * n)
                continue
            found = np.flatnonzero((sums > 0) & (sums + rest[n - 1] + slack >= least))
            if n == len(t) or not len(found):
                break
            # block maxima of the terms left out, summed by block
            block_of, block_max, block_start = self.blocks
            ranges = [slice(a, b) for a, b in zip(block_start[t[n:]].tolist(), block_start[t[n:] + 1].tolist())]
            by_block = np.bincount(np.concatenate([block_of[r] for r in ranges]), np.concatenate([block_max[r] * x for r, x in zip(ranges, w[n:].tolist())]), self.n_blocks)
            found = found[sums[found] + by_block[found // self.block] + slack >= least]
            # candidates' own lists, unless more terms cost less
            if (self.doc_start[found + 1] - self.doc_start[found]).sum() <= left[n]:
                break
            more = min(len(t), 2 * n)
        if not len(found):
            return none
        scores = np.round(sums[found], DIGITS) if n == len(t) else self.exact(found, t, w)
        keep = (scores > 0) & (scores >= least - slack)
        hits, scores = found[keep], scores[keep]
        best = np.lexsort((self.ids[hits], self.null[hits], -scores))[:k]  # ties go by doc_id
        return hits[best], scores[best]

    def prunes(self, q: np.ndarray, t: np.ndarray, w: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each query: whether its terms' bounds reach its threshold at all; whether those of the terms that must be read
        leave out most of its postings; what the terms that need not be read add at most, below a share of the
        threshold, or -1 where the others have too many postings. For each term, whether it is one of those others.
        q: the query of each term, in order; its terms of large weights first."""
        bound, n = w * self.most[t], self.start[t + 1] - self.start[t]
        whole, postings = np.bincount(q, bound, len(least)), np.bincount(q, n, len(least))
        before = np.cumsum(bound) - bound
        rest = whole[q] - (before - np.r_[0, np.cumsum(whole)][q])  # what a term and those after it can still add
        slack = 10.0**-DIGITS
        must = np.bincount(q, n * (rest + slack * 2 >= least[q]), len(least))
        read = rest + slack * 2 >= LEFT_OUT * least[q]
        few = (least > 0) & (np.bincount(q, n * read, len(least)) <= len(self.ids))
        return whole + slack * 2 >= least, (least > 0) & (ALONE * (must + 1024) < postings), np.where(few, np.bincount(q, bound * ~read, len(least)), -1), read

    def best(self, starts: np.ndarray, places: np.ndarray, weights: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (by number), document and score of what `top` finds for each of many queries; starts: where the terms of
        each begin in places and weights, and their end."""
        q = np.repeat(np.arange(len(least)), np.diff(starts))[places >= 0]
        t, w = places[places >= 0], weights[places >= 0]
        if not len(t):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        reach, alone, rest, read = self.prunes(q, t, w, least)
        out = []
        for i in np.flatnonzero(reach & alone).tolist():
            docs, scores = self.top(places[starts[i] : starts[i + 1]], weights[starts[i] : starts[i + 1]], k, float(least[i]))
            out.append((np.full(len(docs), i), docs, scores))
        for few in (True, False):
            keep = (reach & ~alone & ((rest >= 0) == few))[q]
            own, of, weight, added = q[keep], t[keep], w[keep], read[keep]
            ids, first = np.unique(own, return_index=True)
            first = np.r_[first, len(own)]
            for low in range(0, len(ids), TOGETHER):
                some, part = ids[low : low + TOGETHER], slice(first[low], first[min(low + TOGETHER, len(ids))])
                row, docs, scores = self.together(np.searchsorted(some, own[part]), of[part], weight[part], k, least[some], added[part] if few else None, rest[some])
                out.append((some[row], docs, scores))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def together(self, row: np.ndarray, t: np.ndarray, w: np.ndarray, k: int, least: np.ndarray, added: np.ndarray | None, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`best` of some queries, of which all postings are added up; or only those of the terms that are `added`, where
        the others add `rest` at most."""
        size, slack, near, dense = len(self.ids), 10.0**-DIGITS, 1.0, None
        if added is None:
            at, matrix = self.dense
            place = at[t]
            often, added = place >= 0, place < 0
            of = np.zeros((len(least), len(matrix)), np.float32)
            of[row[often], place[often]] = w[often]
            dense = of @ matrix
            self.read += int((self.start[t[often] + 1] - self.start[t[often]]).sum())
            # short floats are off by this part of a sum at most, as nothing is taken off
            near, rest = 1 - (len(matrix) + 8) * 2.0**-23, np.zeros(len(least))
        r, x, start = row[added], w[added], self.start[t[added]]
        n = self.start[t[added] + 1] - start
        self.read += int(n.sum())
        floor = least * near - rest - 2 * slack
        of_row = np.searchsorted(r, np.arange(len(least) + 1))
        upto, low, met = np.r_[0, np.cumsum(n)][of_row], 0, []
        while low < len(least):
            # queries of at most POSTINGS postings to be gathered, one at least
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + POSTINGS, side="right")) - 1)
            c = slice(of_row[low], of_row[high])
            m = n[c]
            posts = np.repeat(start[c] - np.cumsum(m) + m, m) + np.arange(upto[high] - upto[low])
            sums = np.bincount(np.repeat((r[c] - low) * size, m) + self.docs[posts], np.repeat(x[c], m) * self.impact[posts], (high - low) * size).astype(float, copy=False).reshape(-1, size)
            if dense is not None:
                sums += dense[low:high]
            found = sums >= np.maximum(floor[low:high], 1e-300)[:, None]
            for i in np.flatnonzero(np.count_nonzero(found, axis=1) > k).tolist():
                found[i] &= sums[i] >= np.partition(sums[i], -k)[-k] * near * near - rest[low + i] - 2 * slack
            met.append(np.flatnonzero(found) + low * size)
            low = high
        i, docs = np.divmod(np.concatenate(met), size)
        upto, ends = np.searchsorted(i, np.arange(len(least) + 1)), np.searchsorted(row, np.arange(len(least) + 1))
        scores = np.zeros(len(docs))
        for j in np.flatnonzero(np.diff(upto)).tolist():
            own, of_terms = slice(upto[j], upto[j + 1]), slice(ends[j], ends[j + 1])
            scores[own] = self.exact(docs[own], t[of_terms], w[of_terms])
        keep = (scores > 0) & (scores >= least[i] - slack)
        i, docs, scores = i[keep], docs[keep], scores[keep]
        order = np.lexsort((self.ids[docs], self.null[docs], -scores, i))  # ties go by doc_id
        i, docs, scores = i[order], docs[order], scores[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[keep], docs[keep], scores[keep]


def search(docs: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, query_block: int = QUERY_BLOCK, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """query_id, rank, doc_id, score: for each query row (query_id, text) the k best documents by BM25.

    A query is all distinct words of its whole text. Scores are rounded to DIGITS places; ties go to the
    lesser doc_id, nulls last. Queries without words, and null texts, have no results; documents without
    words are never found; repeated query rows are answered once, repeated documents found each;
    an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    index = saved(build(docs, shard), "search-index")
    shards, rows, words = index.agg(F.count("*"), F.sum("n"), F.sum("words")).first()
    mean_length = max(1.0, (words or 0) / max(1, rows or 1))
    asked = queries.select(F.xxhash64("query_id", "text").alias("query"), F.col("query_id").cast("long").alias("query_id"), "text").where("text IS NOT NULL").dropDuplicates(["query"])
    wanted = query_terms(asked, index, rows or 0)
    sizes = wanted.groupBy("query").agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n"))
    wanted = saved(wanted, "search-queries")
    n_queries, n_terms = sizes.first()
    blocks = max(-(-n_queries // query_block), -(-(n_terms or 0) // block_terms)) or 1
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64(F.lit(11), "query"), F.lit(blocks)))
    found = None
    for part in range(blocks):
        block = _answered(spark, index, wanted.where(F.col("part") == part), shards, mean_length, k)
        found = block if found is None else found.unionByName(block)
    return found


def _answered(spark, index: DataFrame, wanted: DataFrame, shards: int, mean_length: float, k: int) -> DataFrame:
    # a block's terms: about block_terms rows of three numbers
    rows = wanted.select("query", "term", "weight").orderBy("query", F.desc("weight"), "term").toArrow()
    q, t, w = (rows[c].to_numpy() for c in ("query", "term", "weight"))
    del rows
    ids, starts = np.unique(q, return_index=True)
    n_queries, thresholds = len(ids), np.zeros(len(ids))
    terms, at = np.unique(t, return_inverse=True)
    weights = np.zeros(len(terms))
    weights[at] = w  # a term's weight is that of all queries
    starts = np.r_[starts, len(q)]
    cuts = np.unique(np.r_[np.searchsorted(starts, np.arange(0, len(q), CHUNK_TERMS)), n_queries])
    shared = spark.sparkContext.broadcast((ids, starts, cuts, terms, at.astype(np.int32), weights))
    del q, t, w, terms, at
    order = F.pmod(F.xxhash64(F.lit(5), "shard"), F.lit(1 << 30))
    hits, low, size = None, 0, FIRST_WAVE
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    parts = ["doc_ids", "null_ids", "lengths", "terms", "df", "docs", "tf"]
    while low < 1 << 30:
        high = min(1 << 30, int((1 << 30) * size / max(1, shards)) or 1)
        least = spark.sparkContext.broadcast(thresholds.copy())

        def run(batches: Iterator[pa.RecordBatch], least=least) -> Iterator[pa.RecordBatch]:
            ids, starts, cuts, terms, at, weights = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in parts if c not in ("terms", "df")}
                    row |= {c: batch.column(c)[i].values.to_numpy() for c in ("terms", "df")}
                    s = Shard(row, mean_length)
                    place = s.places(terms)
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        own = at[starts[a] : starts[b]]
                        q, docs, scores = s.best(starts[a : b + 1] - starts[a], place[own], weights[own], k, least.value[a:b])
                        if len(q):
                            yield pa.RecordBatch.from_arrays([pa.array(ids[a + q], pa.int64()), pa.array(s.ids[docs], pa.int64(), mask=s.null[docs].astype(bool)), pa.array(scores, pa.float64())], names=["query", "doc_id", "score"])
                    del s, row

        wave = index.where((order >= low) & (order < high)).select(*parts).mapInArrow(run, "query long, doc_id long, score double")
        hits = wave if hits is None else hits.unionByName(wave)
        hits = saved(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "search-hits")
        least.destroy()  # the wave's rows are in a table
        low, size = high, size * 4
        if low < 1 << 30 and n_queries:
            at = hits.groupBy("query").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).select("query", "s").toArrow()  # one row a query of the block
            thresholds[np.searchsorted(ids, at["query"].to_numpy())] = at["s"].to_numpy()
    shared.destroy()
    named = wanted.select("query", "query_id").distinct()
    return hits.withColumn("rank", F.row_number().over(best)).join(named, "query").select("query_id", "rank", "doc_id", "score")
