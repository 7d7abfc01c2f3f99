"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(slot | class, context) * P(word | slot).

Classes are clusters of word endings: counts of neighbouring ending pairs over the whole training
text, a bounded table, are embedded by singular vectors and clustered. The text's end has a class
of its own. The most frequent words of a class have a slot each; its other words, and one unknown
word, share REST slots by hash. Both P(class | context) and P(slot | class, context) are softmaxes
over hashed n-gram and skip features of the words before. P(word | slot) is 1 for a word with its
own slot, else its smoothed share of the slot's count, free of context. All factors sum to one.

Texts are split twice: once for the counts, and once into word ids, which are kept in a table. The
ending pairs, all training rounds and the scores are taken from those ids.

Weights are trained by rounds of distributed gradient updates: each task runs minibatch AdaGrad
over its documents from the shared weights, and the tasks' changes are averaged by tokens. Every
training document is in one round. Word counts cover all training text and are never gathered in
one place: tasks get the TOP most frequent words, and what a text has beyond these is joined to
the counts by word. Weight tables are of fixed size: what grows with the corpus are the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import crc32_of_id, saved, words_of

ENDINGS = 512
CLASSES, SLOTS, REST = 16, 16, 4
TOP = 200_000
ROWS, OWN_ROWS = 8192, 4096
BIGRAMS = 16384
NEAR = 4
FAR = 4
SMOOTH = 0.1
BATCH = 16384
BLOCKS = 64
CACHE = 400_000
#: The weight of a slot that no word has: no probability to speak of.
NONE = -30.0

# rows of the class weights: bias, classes at distances 1..NEAR, classes further back (shared); then
# hashed features: the pair of the last classes, words at distances 1 and 2 (a skip), the word pair
_AT = np.cumsum([0, 1, NEAR * CLASSES, CLASSES, CLASSES**2, ROWS, ROWS, BIGRAMS]).tolist()
DENSE, FEATURES = _AT[3], _AT[-1]
# rows of the slot weights: class, class with the pair of the last classes, class with the words at distances 1 and 2
_SAT = np.cumsum([0, CLASSES, CLASSES**3, BIGRAMS, BIGRAMS]).tolist()
SLOT_FEATURES = _SAT[-1]


def ending(word: bytes) -> int:
    """The bucket of a word's last two bytes."""
    return xxhash.xxh32_intdigest(word[-2:]) % ENDINGS


def rest_slot(word: bytes) -> int:
    """Which of a class's shared slots a word without its own is in."""
    return xxhash.xxh32_intdigest(word, 11) % REST


class Ids(dict):
    """Ids of words: 0 is the end; the top words' ranks; others by ending and rest slot, as they come up."""

    def __init__(self, top: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(top))
        self.known = len(top)

    def __missing__(self, word: bytes) -> int:
        self[word] = out = self.known + ending(word) * REST + rest_slot(word)
        return out


def is_training():
    return F.pmod(crc32_of_id(), F.lit(10)) != 0


def counts(docs: DataFrame) -> DataFrame:
    """Over all of docs: word, group (ending and rest slot), n. The end is the empty word, of group -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ends = Counter(), 0

        def flush() -> pa.RecordBatch:
            keys = list(words)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array([ending(w) * REST + rest_slot(w) for w in keys], pa.int32()), pa.array(list(words.values()), pa.int64())], names=["word", "group", "n"])
            words.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                words.update(words_of(text.as_py()))
                ends += 1
                if len(words) > CACHE:
                    yield flush()
        if words:
            yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([-1], pa.int32()), pa.array([ends], pa.int64())], names=["word", "group", "n"])

    raw = docs.select("text").mapInArrow(run, "word string, group int, n long")
    return raw.groupBy("word", "group").agg(F.sum("n").alias("n"))


def coded(docs: DataFrame, top: list[bytes]) -> DataFrame:
    """docs' texts as ids. One row a text: key, doc_id, train, ids (int32, the end last), rest (words beyond the
    top ones and how often they occur); and one row a task with its counts of neighbouring endings at
    distances 1 to 3 in training texts (pairs: place and count, 8 bytes each)."""
    shared = docs.sparkSession.sparkContext.broadcast(top)
    form = "key long, doc_id {}, train boolean, ids binary, rest array<struct<word: string, m: long>>, pairs binary"
    rows = docs.select("doc_id", is_training().alias("train"), "text")
    rest_type = pa.list_(pa.struct([("word", pa.string()), ("m", pa.int64())]))
    names = ["key", "doc_id", "train", "ids", "rest", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, endings = Ids(shared.value), endings_of(shared.value)
        known, key = table.known, TaskContext.get().partitionId() << 40
        pairs, id_type = np.zeros(ENDINGS**2, np.int64), None
        for batch in batches:
            id_type, out, rests, met, held = batch.column("doc_id").type, [], [], [], 0
            for text, train in zip(batch.column("text"), batch.column("train").to_pylist(), strict=True):
                ws = words_of(text.as_py())
                ids = np.zeros(len(ws) + 1, np.int32)
                ids[:-1] = np.fromiter(map(table.__getitem__, ws), np.int32, len(ws))
                out.append(ids.tobytes())
                rests.append([{"word": w.decode("utf-8", "surrogatepass"), "m": m} for w, m in Counter([ws[i] for i in np.flatnonzero(ids >= known).tolist()]).items()])
                if train:
                    e = endings[np.minimum(ids[:-1], known)]
                    high = ids[:-1] >= known
                    e[high] = (ids[:-1][high] - known) // REST
                    met += [e[d:] * ENDINGS + e[:-d] for d in (1, 2, 3)]
                    held += len(e)
                if held > 1 << 18:
                    pairs += np.bincount(np.concatenate(met), minlength=ENDINGS**2)
                    met, held = [], 0
                if len(table) > known + CACHE:
                    table = Ids(shared.value)
            if met:
                pairs += np.bincount(np.concatenate(met), minlength=ENDINGS**2)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(key, key + n), pa.int64()), batch.column("doc_id"), batch.column("train"), pa.array(out, pa.binary()), pa.array(rests, rest_type), pa.nulls(n, pa.binary())], names=names)
            key += n
        at = np.flatnonzero(pairs)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, id_type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), pa.nulls(1, rest_type), pa.array([np.stack([at, pairs[at]]).astype("<i8").tobytes()], pa.binary())], names=names)

    return rows.mapInArrow(run, form.format(docs.schema["doc_id"].dataType.simpleString()))


def endings_of(top: list[bytes]) -> np.ndarray:
    """Endings of the top words, by id; one place more for the others."""
    return np.array([ending(w) for w in top] + [0], np.int64)


def ending_pairs(texts: DataFrame) -> np.ndarray:
    """Counts of neighbouring endings, summed from the tasks' own: at most ENDINGS**2 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("pairs"):
                at, n = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["pair", "n"])

    seen = texts.where("pairs IS NOT NULL").select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ENDINGS**2)
    out[seen["pair"].to_numpy()] = seen["n"].to_numpy()
    return out.reshape(ENDINGS, ENDINGS)


def cluster(pairs: np.ndarray, classes: int, dims: int = 24, rounds: int = 40, seed: int = 0) -> np.ndarray:
    """A class from 1 to `classes` for every ending: k-means on singular vectors of the scaled pair counts."""
    right, left = pairs.sum(axis=1), pairs.sum(axis=0)
    if not pairs.any():
        return 1 + np.arange(len(pairs)) % classes
    scaled = pairs / np.sqrt(np.maximum(right, 1))[:, None] / np.sqrt(np.maximum(left, 1))
    u, s, _ = np.linalg.svd(scaled)
    x = u[:, 1 : dims + 1] * s[1 : dims + 1] / np.sqrt(np.maximum(right, 1) / right.sum())[:, None]
    rng, seen = np.random.default_rng(seed), np.flatnonzero(right > 0)
    centres = x[rng.choice(seen, classes, replace=len(seen) < classes, p=right[seen] / right[seen].sum())]
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(classes):
            w = right * (near == k)
            if w.sum() > 0:
                centres[k] = w @ x / w.sum()
    return 1 + near


@dataclass
class Words:
    """What a task knows of words: bounded by TOP and by fixed table sizes. Arrays are by word id."""

    top: list[bytes]  # the end first, then by frequency
    counts: np.ndarray  # of the top words
    classes: np.ndarray  # of endings
    groups: np.ndarray  # (tokens, distinct words) by ending and rest slot, without the end
    cls: np.ndarray = field(init=False)
    row: np.ndarray = field(init=False)
    slot: np.ndarray = field(init=False)
    log_share: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        known = len(self.top)
        of_end = np.array([ending(w) for w in self.top], np.int64)
        cls, rest = self.classes[of_end].astype(np.int64), np.array([rest_slot(w) for w in self.top], np.int64)
        cls[0] = 0
        row = np.array([i if i < OWN_ROWS else OWN_ROWS + xxhash.xxh32_intdigest(w, 7) % (ROWS - OWN_ROWS) for i, w in enumerate(self.top)], np.int32)
        # the first words of each class have slots of their own
        slot, seen = SLOTS - REST + rest, np.zeros(CLASSES, np.int64)
        for k in range(CLASSES):
            first = np.flatnonzero(cls == k)[: SLOTS - REST]
            slot[first], seen[k] = np.arange(len(first)), len(first)
        self.slots_used = seen
        # tokens and distinct words of shared slots
        share = np.zeros((CLASSES, REST, 2))
        np.add.at(share, (np.repeat(self.classes, REST), np.tile(np.arange(REST), ENDINGS)), self.groups)
        own = np.flatnonzero(slot < SLOTS - REST)
        own = own[own > 0]
        np.subtract.at(share, (cls[own], rest[own]), np.stack([self.counts[own], np.ones(len(own))], axis=1))
        self.share = share
        per_slot = np.log(share[:, :, 0] + SMOOTH * (share[:, :, 1] + 1))
        # ids past the top words stand for (ending, rest slot); their count is not known here
        e = np.arange(ENDINGS * REST)
        self.cls = np.r_[cls, self.classes[e // REST]].astype(np.int32)
        self.slot = np.r_[slot, SLOTS - REST + e % REST].astype(np.int32)
        self.row = np.r_[row, OWN_ROWS + e % (ROWS - OWN_ROWS)].astype(np.int32)
        log_c = np.log(self.counts + SMOOTH)
        self.log_share = np.where(self.slot < SLOTS - REST, 0.0, -per_slot[self.cls, np.maximum(self.slot - (SLOTS - REST), 0)])
        self.log_share[:known] += np.where(slot < SLOTS - REST, 0.0, log_c)

    def start(self, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights that give classes and slots by their counts alone."""
        class_n = np.zeros(CLASSES)
        slot_n = np.zeros((CLASSES, SLOTS))
        own = np.flatnonzero(self.slot[: len(self.top)] < SLOTS - REST)
        np.add.at(slot_n, (self.cls[own], self.slot[own]), self.counts[own])
        slot_n[:, SLOTS - REST :] += self.share[:, :, 0]
        class_n[:] = slot_n.sum(axis=1)
        w1, w2 = np.zeros((FEATURES, CLASSES), np.float32), np.zeros((SLOT_FEATURES, SLOTS), np.float32)
        w1[0] = np.log((class_n + SMOOTH) / (tokens + SMOOTH * CLASSES))
        w1[0, np.setdiff1d(np.arange(1, CLASSES), self.classes)] = NONE  # a class that no ending is in has no words
        w2[:CLASSES] = np.log((slot_n + SMOOTH) / (class_n[:, None] + SMOOTH * SLOTS))
        empty = np.arange(SLOTS)[None] >= self.slots_used[:, None]
        empty[:, SLOTS - REST :] = False
        empty[0, 1:] = True  # the end is its class's only word
        w2[:CLASSES][empty] = NONE
        return w1, w2


def contexts(cls: np.ndarray, row: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each token, the classes at the distances before it, the rows of its hashed class features and those of its
    slot features. starts: each token's place in its text; before the first word stands the end's class and the last row."""

    def back(x: np.ndarray, k: int, edge: int) -> np.ndarray:
        out = np.full(len(x), edge, np.int64)
        out[k:] = x[: max(0, len(x) - k)]
        out[starts < k] = edge
        return out

    c = [back(cls, k, 0) for k in range(1, NEAR + FAR + 1)]
    w = [back(row, k, ROWS - 1) for k in (1, 2)]
    pair = c[0] * CLASSES + c[1]
    rows = np.stack([_AT[3] + pair, _AT[4] + w[0], _AT[5] + w[1], _AT[6] + (w[0] * 92821 + w[1] * 68917) % BIGRAMS])
    slots = np.stack([cls, _SAT[1] + cls * CLASSES**2 + pair, _SAT[2] + (w[0] * 40503 + cls * 30011) % BIGRAMS, _SAT[3] + (w[1] * 48611 + cls * 36497) % BIGRAMS])
    return c, rows, slots


def dense_features(c: list[np.ndarray]) -> np.ndarray:
    """Bias and classes before, as counts."""
    dense, at = np.zeros((len(c[0]), DENSE), np.float32), np.arange(len(c[0]))
    dense[:, 0] = 1
    for k in range(NEAR):
        dense[at, _AT[1] + k * CLASSES + c[k]] = 1
    for k in range(NEAR, NEAR + FAR):
        dense[at, _AT[2] + c[k]] += 1
    return dense


def pair_tables(weights: np.ndarray) -> list[np.ndarray]:
    """For the classes at distances (1, 2), (3, 4), ...: the summed weights of every pair of classes,
    the first with the bias and the pair's own feature."""
    of = [weights[a : a + CLASSES] for a in [*range(_AT[1], _AT[2], CLASSES), *[_AT[2]] * FAR]]
    out = [(x[:, None] + y[None]).reshape(-1, CLASSES) for x, y in zip(of[::2], of[1::2], strict=True)]
    out[0] += weights[0] + weights[_AT[3] : _AT[4]]
    return out


def logits(weights: np.ndarray, tables: list[np.ndarray], c: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Of classes."""
    out = tables[0].take(c[0] * CLASSES + c[1], axis=0)
    for k, t in enumerate(tables[1:], 1):
        out += t.take(c[2 * k] * CLASSES + c[2 * k + 1], axis=0)
    for r in rows[1:]:  # the first is in the first table
        out += weights.take(r, axis=0)
    return out


def slot_logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        out += weights.take(r, axis=0)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def log_shares(z: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The log of column of[i]'s share in row i under a softmax."""
    z -= z.max(axis=1, keepdims=True)
    picked = z[np.arange(len(of)), of]
    return picked - np.log(np.exp(z, out=z).sum(axis=1))


def token_blocks(texts: Iterator[bytes], batch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, places) of whole texts, about `batch` tokens at a time; a longer text comes alone."""
    ids, places, size = [], [], 0
    for text in texts:
        i = np.frombuffer(text, "<i4")
        ids.append(i)
        places.append(np.arange(len(i)))
        size += len(i)
        if size >= batch:
            yield np.concatenate(ids), np.concatenate(places)
            ids, places, size = [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(places)


def spans(ids: np.ndarray, places: np.ndarray, words: Words, step: int = BATCH) -> Iterator[tuple]:
    """(first token, classes, slots, features) for runs of `step` tokens, with the context from before each run."""
    cls, row, slot = words.cls[ids], words.row[ids], words.slot[ids]
    far = NEAR + FAR
    for a in range(0, len(ids), step):
        lo = max(0, a - far)
        c, rows, slots = contexts(cls[lo : a + step], row[lo : a + step], places[lo : a + step])
        yield a, cls[a : a + step], slot[a : a + step], ([x[a - lo :] for x in c], rows[:, a - lo :], slots[:, a - lo :])


def log_probabilities(weights: tuple[np.ndarray, np.ndarray], tables: list[np.ndarray], words: Words, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Natural logs of the class and slot factors of every token."""
    out = np.empty(len(ids))
    for a, cls, slot, (c, rows, slots) in spans(ids, places, words):
        out[a : a + len(cls)] = log_shares(logits(weights[0], tables, c, rows), cls) + log_shares(slot_logits(weights[1], slots), slot)
    return out


class Adagrad:
    """A weight table under minibatch updates."""

    def __init__(self, weights: np.ndarray, rate: float) -> None:
        self.w, self.seen, self.rate = weights.copy(), np.full(weights.shape, 1e-2, np.float32), rate

    def step(self, at, g: np.ndarray) -> None:
        take = (lambda x: x[at].copy()) if isinstance(at, slice) else (lambda x: x.take(at, axis=0))
        s = take(self.seen)
        s += g * g
        self.seen[at] = s
        g /= np.sqrt(s, out=s)
        g *= self.rate
        w = take(self.w)
        w -= g
        self.w[at] = w

    def rows(self, r: np.ndarray, g: np.ndarray) -> None:
        """Gradients g of the rows r, equal rows added up; fewer than 65,536 rows, so that the sort is by counting."""
        order = np.argsort(r.astype(np.uint16), kind="stable")
        sorted_ = r[order]
        first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        # as complex numbers, so that two columns are added at a time
        self.step(sorted_[first], np.add.reduceat(g.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32))


def updated(weights: tuple[np.ndarray, np.ndarray], texts: Iterator[bytes], words: Words, rate: float = 0.4) -> tuple[np.ndarray, int]:
    """Minibatch AdaGrad over the texts' ids; the change of both weight tables, flat, and tokens seen."""
    classes, slots_, total = Adagrad(weights[0], rate), Adagrad(weights[1], rate), 0
    for ids, places in token_blocks(texts, BATCH):
        for _, cls, slot, (c, rows, slots) in spans(ids, places, words):
            at, scale = np.arange(len(cls)), len(cls) ** 0.5
            g = softmax(logits(classes.w, pair_tables(classes.w), c, rows))
            g[at, cls] -= 1
            g /= scale
            classes.step(slice(0, DENSE), dense_features(c).T @ g)
            for r in rows:
                classes.rows(r, g)
            g = softmax(slot_logits(slots_.w, slots))
            g[at, slot] -= 1
            g /= scale
            for r in slots:
                slots_.rows(r, g)
            total += len(cls)
    return np.concatenate([(classes.w - weights[0]).ravel(), (slots_.w - weights[1]).ravel()]), total


def trained(texts: DataFrame, known, weights: tuple[np.ndarray, np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounds of gradient updates over texts (doc_id, ids), each over its share of the documents by id."""
    spark = texts.sparkSession
    share = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(rounds))
    flat, cut = np.concatenate([w.ravel() for w in weights]).astype(np.float32), weights[0].size
    shape = lambda x: (x[:cut].reshape(-1, CLASSES), x[cut:].reshape(-1, SLOTS))
    for r in range(rounds):
        at = spark.sparkContext.broadcast(flat)

        def local(batches: Iterator[pa.RecordBatch], at=at) -> Iterator[pa.RecordBatch]:
            change, n = updated(shape(at.value), (t.as_py() for b in batches for t in b.column("ids")), known.value)
            if n:
                parts = np.array_split(change.astype(np.float16), BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([n] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "n", "change"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            tokens: Counter = Counter()
            for b in batches:
                for block, n, change in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    total[block] = total.get(block, 0) + n * np.frombuffer(change, np.float16).astype(np.float64)
                    tokens[block] += n
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([tokens[k] for k in keys], pa.int64()), pa.array([(total[k] / tokens[k]).astype(np.float32).tobytes() for k in keys], pa.binary())], names=["block", "n", "change"])

        # a number of partitions of their own, so that small blocks aren't merged into one task
        form = "block int, n long, change binary"
        met = texts.where(share == r).select("ids").mapInArrow(local, form).repartition(BLOCKS, "block").mapInArrow(summed, form).toArrow()
        if met.num_rows:
            met = met.sort_by("block")
            flat = flat + np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in met["change"]])
        at.unpersist()
    return shape(flat)


def score(docs: DataFrame, rounds: int = 3, top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null and blank texts are the end alone; null ids count by their empty text; repeated rows
    are scored each; very long texts are read in runs; without training text every score is that
    of an untrained model; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    vocabulary = saved(counts(docs.where(is_training())), "lm-counts")

    groups = np.zeros((ENDINGS * REST, 2))  # tokens and distinct words
    ends = 0
    for g, tokens, distinct in zip(*(c.to_pylist() for c in vocabulary.groupBy("group").agg(F.sum("n"), F.count("*")).toArrow().columns), strict=True):
        if g < 0:
            ends = tokens
        else:
            groups[g] = tokens, distinct
    n, v = int(groups[:, 0].sum()) + ends, int(groups[:, 1].sum()) + (ends > 0)
    most = vocabulary.where("group >= 0").orderBy(F.desc("n"), "word").limit(top).select("word", "n").toArrow()
    names, top_counts = [b"", *(w.encode() for w in most["word"].to_pylist())], np.r_[ends, most["n"].to_numpy()]
    del most
    texts = saved(coded(docs, names), "lm-texts")
    words = Words(names, top_counts, cluster(ending_pairs(texts), CLASSES - 1), groups)
    known = spark.sparkContext.broadcast(words)
    weights = trained(texts.where("train"), known, words.start(n), rounds)

    per_token = np.log10(n + SMOOTH * (v + 1))
    logs, end_known = np.log10(top_counts + SMOOTH), ends > 0
    fitted = spark.sparkContext.broadcast((weights, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (weights, logs) = known.value, fitted.value
        tables, n_known = pair_tables(weights[0]), len(words.top)
        for batch in batches:
            at, column = 0, batch.column("ids")
            seen, base, total, size = (np.zeros(batch.num_rows) for _ in range(4))
            while at < batch.num_rows:
                ids, held, first = [], 0, at
                while at < batch.num_rows and held < 1 << 18:
                    ids.append(np.frombuffer(column[at].as_py(), "<i4"))
                    held += len(ids[-1])
                    at += 1
                which = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
                flat, places = np.concatenate(ids), np.concatenate([np.arange(len(i)) for i in ids])
                p = (log_probabilities(weights, tables, words, flat, places) + words.log_share[flat]) / np.log(10)
                top = flat < n_known
                add = lambda x, which=which, ids=ids: np.bincount(which, x, len(ids))
                total[first:at], size[first:at] = add(p), add(np.ones(len(flat)))
                base[first:at] = add(np.where(top, logs[np.where(top, flat, 0)], 0.0))
                seen[first:at] = add((top & ((flat != 0) | end_known)).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(seen), pa.array(base), pa.array(total)], names=["key", "doc_id", "m", "seen", "base", "score"])

    whole = texts.where("key IS NOT NULL")
    zero = [F.lit(0).cast("long").alias("m"), *[F.lit(0.0).alias(c) for c in ("seen", "base", "score")]]
    scored = whole.select("key", "doc_id", "ids").mapInArrow(run, whole.select("key", "doc_id", *zero).schema)
    # words beyond the top ones: their count c, or 0, which the score lacks too
    rest = whole.select("key", F.explode("rest").alias("x")).select("key", "x.*").join(vocabulary.where("group >= 0").select("word", "n"), "word", "left")
    c = F.coalesce("n", F.lit(0))
    rest = rest.groupBy("key").agg(F.sum(F.when(c > 0, F.col("m")).otherwise(0)).cast("double").alias("r_seen"), F.sum(F.col("m") * F.log10(c + SMOOTH)).alias("r_base"))
    summed = scored.join(rest, "key", "left").na.fill(0.0, ["r_seen", "r_base"])
    return summed.select(
        "doc_id",
        (~is_training()).alias("held_out"),
        F.col("m").alias("n_tokens"),
        (F.col("seen") + F.col("r_seen")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("r_base") - F.col("m") * float(per_token)).alias("base_score"),
        (F.col("score") + F.col("r_base")).alias("score"),
    )
