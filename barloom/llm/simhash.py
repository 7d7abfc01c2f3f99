"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming check, components.

With m blocks, two fingerprints that differ in at most d < m bits agree on at least m - d
whole blocks, so joining on every choice of m - d blocks finds each such pair: the search is
exact for every m. A larger m costs more keys per fingerprint and makes each key longer;
`blocks_for` takes the smallest m whose keys are many times the fingerprints, so that hardly any
bucket holds an unrelated fingerprint at any size of the corpus.

Equal fingerprints are one vertex, so copies are never expanded into pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import saved, words_of
from barloom.llm.components import across, bucket_components, connected_components, least_and_last, merged, mixed_keys, shuffled, with_main
from barloom.sources.shared import only

BITS = 64
#: Bits by which keys are longer than fingerprints are many. Strangers that meet in a bucket are fewer by as many powers
#: of two; with none, their number grows with the square of the corpus until the next m.
SPARE = 5


def shingle_hashes(text: str | None, words_per_shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of all the words where there are fewer; none without words."""
    return word_shingles(words_of(text), words_per_shingle, seed)


def word_shingles(words: list[bytes], words_per_shingle: int, seed: int = 42) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(words_per_shingle, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, least bit first."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 255 * 256):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[i : i + 255 * 256].view(np.uint8), bitorder="little").reshape(-1, BITS)
        for j in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            counts += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return counts


def fingerprint(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles' XXH64, repeats included; a bit is 1 if over half have it.

    No words (null, empty, white space): 0. Fewer words than a shingle: one shingle of all."""
    hashes = shingle_hashes(text, words_per_shingle, seed)
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, words_per_shingle: int = 4, text: str = "text", out: str = "fp") -> DataFrame:
    """docs without its text, plus the fingerprint as a (signed) long."""
    kept = [c for c in docs.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words_per_shingle) for t in batch.column(text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fps)], names=[*kept, out])

    schema = docs.select(*kept, F.lit(0).cast("long").alias(out)).schema
    return docs.select(*kept, text).mapInArrow(run, schema)


def blocks_for(fingerprints: int, distance: int) -> int:
    """The smallest m whose keys (of m - distance blocks) number at least about 2^SPARE times the fingerprints."""
    for m in range(distance + 1, 2 * distance + 2):
        if (BITS // m) * (m - distance) >= np.log2(max(fingerprints, 2)) + SPARE:
            return m
    return 2 * distance + 2


def block_masks(m: int) -> list[int]:
    """m masks of neighbouring bits that cover all 64."""
    edges = [round(i * BITS / m) for i in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(fps: DataFrame, distance: int = 4, m: int | None = None) -> DataFrame:
    """(fp, root) of distinct fingerprints (column fp) under links of at most `distance` bits."""
    m = m or blocks_for(fps.count(), distance)
    masks = block_masks(m)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("node").bitwiseAND(F.lit(_signed(sum(masks[b] for b in c))))) for i, c in enumerate(combinations(range(m), m - distance))])
    # the fingerprint is the node; its copy is what pairs are checked on
    vertices = fps.select(F.col("fp").alias("node"), F.col("fp").alias("bits"))
    close = lambda x, y: F.bit_count(x[0].bitwiseXOR(y[0])) <= distance
    return bucket_components(vertices, lambda v: v.select("*", F.explode(keys).alias("key")), ["bits"], close).select(F.col("node").alias("fp"), F.col("comp").alias("root"))


def links(fps: DataFrame, distance: int = 4, m: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) at most `distance` bits apart, once each.

    For tables without large groups; `components` groups without listing pairs."""
    m = m or blocks_for(fps.count(), distance)
    share, masks = m - distance, block_masks(m)
    choices = list(combinations(range(m), share))
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[i] for i in c)))) for c in choices])
    keyed = fps.select("fp", F.posexplode(keys).alias("choice", "block"))
    a, b = keyed.select(F.col("fp").alias("a"), "choice", "block"), keyed.select(F.col("fp").alias("b"), "choice", "block")
    x = F.col("a").bitwiseXOR(F.col("b"))
    # a pair that agrees on more blocks meets under several choices; the one of its first agreeing blocks counts
    agree = [x.bitwiseAND(F.lit(_signed(k))) == 0 for k in masks]
    first: Column = F.lit(None)
    for k in reversed(range(len(choices))):
        first = F.when(_all(agree, choices[k]), F.lit(k)).otherwise(first)
    return a.join(shuffled(b), ["choice", "block"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= distance) & (F.col("choice") == first)).select("a", "b")


def _all(agree: list[Column], choice: tuple[int, ...]) -> Column:
    out = agree[choice[0]]
    for i in choice[1:]:
        out = out & agree[i]
    return out


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links, itself included.

    Null texts have fingerprint 0 like empty ones; a null doc_id keeps its row and is never a
    component's id unless all ids there are null; repeated rows stay repeated; an empty table
    gives no rows; further columns of docs are ignored."""
    hashed = saved(with_fingerprints(docs.select("doc_id", "text"), words_per_shingle), "simhash-fp")
    return grouped(hashed, distance)


def grouped(hashed: DataFrame, distance: int = 4) -> DataFrame:
    """hashed (doc_id, fp, ...) plus component_id."""
    vertices = saved(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-vertices")
    rooted = vertices.join(shuffled(components(vertices.select("fp"), distance)), "fp").select("fp", "first_id", "root")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(shuffled(least), "root").select("fp", "component_id")
    return hashed.join(shuffled(named), "fp")


# --- near copies at a likeness of shingle sets ---------------------------------------------------

#: Bits of the wider fingerprint, how many documents of an anchor aren't dealt further, and the share of
#: alike pairs that the anchors may miss.
WIDE, SMALL, MISS = 256, 16, 1e-5
#: Keys of more rows than this are searched by what their members have beside a common text.
DENSE = 128
#: Members of a large component whose shingles stand for what it has in common.
HUBS = 8
#: Members of a large component that what lies outside it is first compared with.
PIVOTS = 64
#: Node lists up to this size (2 MB of numbers) are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 1 << 18
#: Odd constants of a 64-bit mixer (public domain splitmix64).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64((k + 1) * MIX[0] & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[2])
        return z ^ (z >> np.uint64(31))


def wide_words(hashes: np.ndarray, bits: int = WIDE) -> list[int]:
    """SimHash of `bits` bits over distinct hashes, as signed longs."""
    packed = [np.packbits(bit_counts(mixed(hashes, k)) * 2 > len(hashes), bitorder="little").view(np.int64)[0] for k in range(bits // BITS)]
    return [int(x) for x in packed]


def anchors_for(likeness: float, miss: float = MISS) -> int:
    """How many anchors two sets of this likeness share none of with probability `miss` at most."""
    return max(1, int(np.ceil(np.log(miss) / np.log(1 - likeness))))


def widest(likeness: float, bits: int = WIDE, deviations: float = 4.0) -> tuple[int, int]:
    """The most differing bits of a pair of this likeness, at so many deviations above the mean share
    arccos(2s / (1 + s)) / pi; and the same for sets of under 16 shingles, whose ties raise it."""
    p = float(np.arccos(2 * likeness / (1 + likeness)) / np.pi)
    limit = lambda q: int(np.ceil(bits * q + deviations * (bits * q * (1 - q)) ** 0.5))
    return limit(p), limit(1.3 * p)


def texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of texts (node, text) that are wanted, as a table."""
    wanted = saved(nodes.distinct(), "near-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    return saved(texts.join(F.broadcast(wanted) if few else wanted, "node"), "near-texts")


def alike(pairs: DataFrame, texts: DataFrame, likeness: float, words_per_shingle: int) -> DataFrame:
    """The rows of pairs (a, b, ...) whose shingle sets have a Jaccard likeness of at least `likeness`, exactly.

    texts: node, text. Only texts of the pairs are moved. A node in many pairs is a hot key of the join on b
    alone, whose rows carry no text yet; skew joins split them."""
    pairs = saved(pairs, "alike-pairs")
    texts = texts_of(pairs.select("a").union(pairs.select("b")).toDF("node"), texts)
    extra = [c for c in pairs.columns if c not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def hashes(node: int, text: str | None) -> np.ndarray:
            nonlocal size
            if node not in held:
                if size > 1 << 21:
                    held.clear()
                    size = 0
                held[node] = np.unique(shingle_hashes(text, words_per_shingle))
                size += len(held[node])
            return held[node]

        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "_x", "_y"))
            keep = []
            for i in range(batch.num_rows):
                p, q = hashes(a[i].as_py(), x[i].as_py()), hashes(b[i].as_py(), y[i].as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= likeness * (len(p) + len(q) - both))
            yield batch.select(["a", "b", *extra]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("_y")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_x")), "a").select("a", "b", *extra, "_x", "_y")
    return both.mapInArrow(run, pairs.select("a", "b", *extra).schema)


def common_texts(groups: DataFrame, texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """main, p: the shingles of up to HUBS members of each main component, as one array."""
    hubs = groups.where("comp = main").groupBy("main", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("_h")).agg(F.min("node").alias("node"))
    lists = hubs.join(texts, "node").groupBy("main").agg(F.collect_list("text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.concatenate([shingle_hashes(t, words_per_shingle) for t in x.as_py()])).view(np.int64) for x in batch.column("texts")]
            at = pa.array(np.r_[0, np.cumsum([len(x) for x in sets])], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("main"), pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], names=["main", "p"])

    return lists.mapInArrow(run, lists.select("main", F.lit(None).cast("array<bigint>").alias("p")).schema)


def beside_main(groups: DataFrame, texts: DataFrame, payload: list[str], likeness: float, words_per_shingle: int) -> DataFrame:
    """groups (main, node, comp, payload with n first) plus what its nodes have in common with main, and beside it.

    P is the shingles of a few of main's members, which together have nearly all that the group has in common; what
    is made of these columns is exact for any P. inside: how many of the node's shingles are in P; bits: which, as a
    bitmap over P; beside: its first shingles outside P, so many that two nodes with a likeness of s that share none
    of them have all their common shingles in P (prefix filter with the shingles outside P first)."""
    known = texts_of(groups.select("node"), texts)
    common = saved(common_texts(groups, known, words_per_shingle), "near-common")
    whole = groups.join(known, "node").join(common, "main")
    kept = ["main", "node", "comp", *payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda arrays: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in arrays])], pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))
        for batch in batches:
            inside, beside, maps = [], [], []
            for text, p in zip(batch.column("text"), batch.column("p"), strict=True):
                h, p = np.unique(shingle_hashes(text.as_py(), words_per_shingle)), np.sort(p.values.to_numpy().view(np.uint64))
                both = np.isin(p, h, assume_unique=True)
                other = np.setdiff1d(h, p, assume_unique=True)
                inside.append(len(h) - len(other))
                beside.append(other[: len(h) - int(np.ceil(likeness * len(h) - 1e-9)) + 1].view(np.int64))
                maps.append(np.packbits(np.pad(both, (0, -len(p) % 64)), bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(inside, pa.int64()), lists(beside), lists(maps)], names=[*kept, "inside", "beside", "bits"])

    form = groups.select(*kept, F.lit(0).cast("long").alias("inside"), *[F.lit(None).cast("array<bigint>").alias(x) for x in ("beside", "bits")]).schema
    return saved(whole.select(*kept, "text", "p").mapInArrow(run, form), "near-beside")


def in_common(rows: DataFrame, partners: DataFrame, payload: list[str], likeness: float) -> DataFrame:
    """Pairs (a, b, comp_a, comp_b, payload of both) of rows and partners (both as `beside_main` gives them) of one main and
    different components whose common shingles in P are alone enough for the likeness: linked for sure.

    A pair with a likeness of s has s / (1 + s) * (|A| + |B|) common shingles or more. The join is on size buckets, a
    power of 1 / s wide, each row meeting its own and the neighbours."""
    n = F.col(payload[0])
    bucket = F.floor(F.log(1 / likeness, n.cast("double")) + 1e-9)
    able = F.col("inside") + 1e-9 >= n * likeness  # else too few for any partner
    side = lambda x: [F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"), F.col("inside").alias(f"inside_{x}"), F.col("bits").alias(f"bits_{x}"), *[F.col(y).alias(f"{y}_{x}") for y in payload]]
    a = rows.where(able).select(F.col("main").alias("of"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("of_bucket"), *side("a"))
    b = partners.where(able).select("main", bucket.alias("bucket"), *side("b"))
    needed = (F.col(f"{payload[0]}_a") + F.col(f"{payload[0]}_b")) * (likeness / (1 + likeness)) - 1e-9
    shared = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda total, x: total + x)
    once = (F.col("comp_b") == F.col("main")) | (F.col("a") < F.col("b"))
    meets = (F.col("of") == F.col("main")) & (F.col("of_bucket") == F.col("bucket")) & (F.col("comp_a") != F.col("comp_b")) & once
    met = a.join(shuffled(b), meets & (F.least("inside_a", "inside_b") >= needed) & (shared >= needed))
    return met.drop("of", "of_bucket", "main", "bucket", "inside_a", "inside_b", "bits_a", "bits_b")


def to_pivots(rows: DataFrame, payload: list[str], likeness: float) -> DataFrame:
    """Links (comp_a, comp_b) of rows outside their main component with up to PIVOTS of its members: nearly all that
    belongs to a large group joins it here, for a few comparisons a row."""
    members = rows.where("comp = main")
    chosen = members.groupBy("main", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PIVOTS)).alias("_h")).agg(F.min("node").alias("node")).drop("_h")
    pivots = members.join(chosen, ["main", "node"]).select(*rows.columns)
    return in_common(rows.where("comp != main"), pivots, payload, likeness).select("comp_a", "comp_b").distinct()


def renamed(df: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    """df with the components in columns replaced by their roots (node, root)."""
    for c in columns:
        new = roots.select(F.col("node").alias(c), F.col("root").alias("_root"))
        df = df.join(new, c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
    return df


def searched(keys: DataFrame, named: DataFrame, dense: DataFrame, payload: list[str]) -> DataFrame:
    """keys (key, node) plus the component of each node by now, its payload and, as groups, the dense groups it is of
    (null: none), whose pairs are all searched by what they have beside their text. What is known of a node is put
    together once a node; its keys are joined with that alone."""
    groups = dense.groupBy("node").agg(F.collect_set("main").alias("groups"))
    known = named.select("node", "comp", *payload).join(shuffled(groups), "node", "left")
    return keys.select("key", "node").join(shuffled(known), "node")


def finer(rows: DataFrame, words: list[str], anchors: int) -> DataFrame:
    """Deal large keys further by blocks of the fingerprint: a key of n rows gets blocks of t = log2(n / 8) bits,
    so that a block holds about eight strangers, and so many blocks that a pair whose bits agree at
    0.85 shares one under some anchor but for about one in a thousand. Keys of up to SMALL rows stay.

    rows: key, place (which anchor), size, words. The blocks are runs of bits at places of their own."""
    t = F.when(F.col("size") <= SMALL, F.lit(0)).otherwise(F.ceil(F.log2(F.col("size") / 8.0))).cast("int")
    sized = rows.withColumn("t", F.least(t, F.lit(48))).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.lit(10.0 / anchors) * F.pow(F.lit(1 / 0.85), F.col("t"))).cast("int")))
    block = (
        f"transform(sequence(0, blocks - 1), i -> xxhash64(key, i, shiftrightunsigned(element_at(array({', '.join(words)}), cast((i + place) % {len(words)} + 1 as int)), "
        "cast(pmod(i * 23 + place * 37, 65 - t) as int)) & (shiftleft(1L, t) - 1)))"
    )
    return sized.select(F.explode(F.expr(block)).alias("fine"), *[c for c in rows.columns if c not in ("place", "size")]).drop("key").withColumnRenamed("fine", "key")


def first_of_near_copies(docs: DataFrame, likeness: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """The rows of docs (doc_id, text, ...) but for near copies: of each component of documents whose sets of
    word shingles have a Jaccard likeness of at least `likeness`, the row with the least doc_id stays.

    Pigeonhole blocks can't hold such pairs: at 0.8 they differ in 15 % of the bits, 39 of 256, so blocks
    that must agree would have a few bits each. Two-level blocks take their place. A document's anchors are
    its least shingles under several hashes, equal for a pair with a probability of its likeness; an anchor
    of many documents is dealt further by blocks of the SimHash (see `finer`), and what is still dense, which is
    a large group of near copies, is searched by what its members have beside the group's text (see
    `beside_main`). Close pairs by Hamming distance are then checked on their whole shingle sets, so that no pair under `likeness` is linked; one at it or
    above is missed with a probability of about 1e-5 (8 anchors), or 1e-3 where all its anchors are shared by
    very many unlinked documents.

    Texts with equal words are one vertex. Null texts, and texts without words, are copies of each other.
    Null ids count as greater than others; of equal ids in a component, and of repeated rows, one row stays;
    an empty table gives no rows; other columns are kept as they are."""
    p = "_nd"
    while any(c.startswith(p) for c in docs.columns):
        p = "_" + p
    with only(docs.sparkSession) as keep:
        marked, gone = near_copies(docs, p, likeness, words_per_shingle)
        keep(marked)
        keep(gone)
    few = gone.count() <= BROADCAST_ROWS
    return marked.join(F.broadcast(gone) if few else gone, F.col(f"{p}_row") == F.col("row"), "left_anti").select(*docs.columns)


def near_copies(docs: DataFrame, p: str, likeness: float, words_per_shingle: int) -> tuple[DataFrame, DataFrame]:
    """docs with a number (p_row) and the columns that are searched by, and the numbers (row) of near copies that go, as tables."""
    n_anchors, n_words = anchors_for(likeness), WIDE // BITS
    bits, anchors = [f"{p}_w{i}" for i in range(n_words)], [f"{p}_a{i}" for i in range(n_anchors)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, numbers = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                h = np.unique(word_shingles(words, words_per_shingle))
                digests.append(hashlib.md5(b" ".join(words)).digest())
                sizes.append(len(h))
                numbers.append([*wide_words(h), *(int(mixed(h, n_words + k).min().view(np.int64)) for k in range(n_anchors))] if len(h) else [0] * (n_words + n_anchors))
            longs = np.array(numbers, np.int64).reshape(-1, n_words + n_anchors)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(x) for x in longs.T.copy())], names=[*batch.schema.names, f"{p}_digest", f"{p}_n", *bits, *anchors])

    numbered = docs.withColumn(f"{p}_row", F.monotonically_increasing_id())
    schema = numbered.select("*", F.lit(b"").alias(f"{p}_digest"), *[F.lit(0).cast("long").alias(c) for c in (f"{p}_n", *bits, *anchors)]).schema
    marked = saved(numbered.mapInArrow(run, schema), "near-marked")

    # a vertex is a sequence of words, numbered by its first row
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(f"{p}_row").alias("row"))).alias("best")
    same = lambda c, name: F.first(c).alias(name)
    payload = ["n", *[f"w{i}" for i in range(n_words)]]
    vertices = marked.groupBy(f"{p}_digest").agg(F.min(f"{p}_row").alias("node"), best, same(f"{p}_n", "n"), *[same(c, f"w{i}") for i, c in enumerate(bits)], *[same(c, f"a{i}") for i, c in enumerate(anchors)])
    vertices = saved(vertices.drop(f"{p}_digest"), "near-vertices")
    texts = marked.select(F.col(f"{p}_row").alias("node"), "text")

    limit, small_limit = widest(likeness)
    differing = lambda x, y: sum((F.bit_count(u.bitwiseXOR(v)) for u, v in zip(x[1:], y[1:], strict=True)), F.lit(0))

    def close(x: list[Column], y: list[Column]) -> Column:
        less, more = F.least(x[0], y[0]), F.greatest(x[0], y[0])
        return (less >= more * F.lit(likeness)) & (differing(x, y) <= F.when(less < 16, small_limit).otherwise(limit))

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.where("n > 0").select("*", F.posexplode(F.array(*[f"a{i}" for i in range(n_anchors)])).alias("place", "key"))

    # each vertex and the nearest of its keys' ends, which differ from key to key: a large group is nearly one
    # component after this
    met = least_and_last(keyed(vertices).select("key", "node", *payload), payload, close, seed=0)
    nearest = F.min(F.struct(differing([F.col(c) for c in payload], [F.col("end")[c] for c in payload]).alias("d"), F.col("end.node").alias("end"))).alias("nearest")
    star = met.groupBy("node").agg(nearest).select(F.greatest("node", "nearest.end").alias("a"), F.least("node", "nearest.end").alias("b")).distinct()
    roots = connected_components(alike(star, texts, likeness, words_per_shingle))
    named = saved(vertices.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "near-named")

    # what still lies apart: the nearest pair of two components first, then all pairs of those still apart
    every = keyed(named).select("key", "place", "node", "comp", *payload)
    met = with_main(finer(every.join(shuffled(mixed_keys(every)), "key"), payload[1:], n_anchors).select("key", "node", "comp"), DENSE)
    # dense keys go by the component that is the largest of all, so that a group has one name in all its keys
    crowded = met.where(F.col("size") > DENSE).drop("main")
    weights = named.groupBy("comp").agg(F.count("*").alias("weight"))
    largest = crowded.select("key", "comp").distinct().join(weights, "comp").groupBy("key").agg(F.max(F.struct("weight", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"))
    dense = crowded.join(largest, "key").select("main", "node").distinct().join(named.select("node", "comp", *payload), "node")
    dense = saved(dense.select("main", "node", "comp", *payload), "near-dense")
    beside = beside_main(dense, texts, payload, likeness, words_per_shingle)
    # what is of a large group joins it first; only what is left is compared with all of it
    roots = saved(connected_components(to_pivots(beside, payload, likeness).toDF("a", "b")), "near-roots")
    named = saved(renamed(named, roots, "comp"), "near-renamed")
    beside = saved(renamed(beside, roots, "comp", "main"), "near-beside-renamed")
    sparse = with_main(searched(met.where(F.col("size") <= DENSE), named, dense, payload))
    by_token = beside.withColumn("key", F.explode("beside")).withColumn("key", F.xxhash64("main", "key")).drop("beside", "inside", "bits")
    in_p = in_common(beside.where("comp != main"), beside, payload, likeness)
    pairs = across(sparse, payload, close, "groups")
    for more in (across(by_token, payload, close), in_p):
        pairs = pairs.unionByName(more.select(*pairs.columns))
    d = differing([F.col(f"{c}_a") for c in payload], [F.col(f"{c}_b") for c in payload])
    swap = F.col("comp_a") < F.col("comp_b")
    turned = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("comp_a", "comp_b"), ("comp_b", "comp_a"))]
    pairs = saved(pairs.select(*turned, d.alias("d")).distinct(), "near-pairs")
    first = pairs.groupBy("comp_a", "comp_b").agg(F.min(F.struct("d", "a", "b")).alias("m")).select("m.a", "m.b", "comp_a", "comp_b")
    linked = saved(alike(first, texts, likeness, words_per_shingle), "near-first")
    now = saved(merged(named.select("comp").distinct().withColumn("node", F.col("comp")), linked), "near-now")
    apart = pairs.join(first.select("a", "b"), ["a", "b"], "left_anti")
    for x in "ab":
        apart = apart.join(now.select(F.col("node").alias(f"comp_{x}"), F.col("comp").alias(f"now_{x}")), f"comp_{x}")
    more = alike(apart.where("now_a != now_b").select("a", "b", "comp_a", "comp_b"), texts, likeness, words_per_shingle)
    groups = merged(named.select("node", "comp", "best"), linked.unionByName(more))

    # the rows that go, few as a rule
    stays = groups.groupBy("comp").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    return marked, saved(marked.select(F.col(f"{p}_row").alias("row")).join(stays, "row", "left_anti"), "near-gone")
