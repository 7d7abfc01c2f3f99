"""Toxicity by noisy-channel deobfuscation: restore words, then score the restored text.

Channel. A word may have been written with look-alike symbols (1d10t), stretched letters
(looooser), marks between letters (m.o.r.o.n) or spaces (t r a s h). Such a word becomes a
lattice: each symbol offers the letters it may stand for, or nothing; a run of three or more
equal letters or symbols offers one or two of them. Viterbi search under a character trigram
model of the corpus, counted over all texts, keeps the likeliest readings. A run of spaced-out
symbols may hold several words, so there the lattice offers a word edge after every letter.
Long words and runs are read in overlapping windows, however long they are. A word without
such signs has one reading, itself.

Score. Restored words are looked up by their prefixes, suffixes and themselves in a table of
log-odds (lower confidence bounds, so rare features count little), learned from labelled
documents; a logistic regression on a document's largest values, fitted on values that come
from the other half of the sample, gives the probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import crc32_of_id, saved

#: What a symbol may stand for; every mark may also stand for nothing.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: The model's letters: 0 is a word's edge, 1 any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")
A = len(LETTERS) + 2
CODE = np.zeros(1 << 16, np.int64)
CODE[[i for i in range(1 << 16) if chr(i).isalpha()]] = 1
CODE[[ord(c) for c in LETTERS]] = np.arange(2, A)
LETTER = {c: i + 2 for i, c in enumerate(LETTERS)}

NOISY = re.compile(r"(.)\1\1|[^\W\d_][\W_]+[^\W\d_]|[\d@$!|+(€£¡]")
TRIPLE = re.compile(r"(.)\1\1")
#: Marks around a word, and what is put after words as ornament.
AROUND = ".,;:?\"'()[]{}<>&%#*~^`_-"
ORNAMENT = re.compile(r"(?:(?<!!)!+|(?<!@)@{3,}|(?<!\$)\${3,}|(?<!\|)\|{3,}|(?<!\+)\+{3,})$")
SPACED = re.compile(r"(?<!\S)[\w@$!](?:[ .\-_*][\w@$!]){2,}(?!\S)")
#: What marks a token as put together from spaced-out symbols.
RUN = " "
PLAIN = re.compile(r"[^\W\d_]+")
SUBSTITUTE, DROP, SHORTEN, KEEP_MARK, EDGE = -1.0, -0.5, -0.2, -6.0, -0.5
READINGS = 6
#: Places of a window, and how many of them the next one has too: words of up to so many places are whole in one.
WINDOW, OVERLAP = 40, 16

POSITIVES, NEGATIVES = 2_000, 6_000
LEAST_DOCS, LEAST_VALUE = 3, 1.5
THRESHOLD = 0.7
CACHE = 300_000


# --- character model -------------------------------------------------------------------------


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts; one number a trigram and task is exchanged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(A**3, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
                    x = CODE[np.minimum(code, 0xFFFF)]
                    a, b, c = x[:-2], x[1:-1], x[2:]
                    # before a word's first letter stand two edges; runs of other characters count once
                    at = (np.where(b == 0, 0, a) * A + b) * A + c
                    total += np.bincount(at[(b != 0) | (c != 0)], minlength=A**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"trigram": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toArrow()  # at most A**3
    out = np.zeros(A**3)
    out[rows["trigram"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(A, A, A)


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with bigrams and letters."""
    bi, uni = counts.sum(axis=0), counts.sum(axis=(0, 1))
    p1 = (uni + 0.1) / (uni.sum() + 0.1 * A)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    return np.log((counts + 10 * p2) / (counts.sum(axis=2, keepdims=True) + 10))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Readings of each place of a lower-cased word, with their channel log-costs."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(word):
        j = i
        while j < len(word) and word[j] == word[i]:
            j += 1
        c, n = word[i], j - i
        if c.isalpha():
            out.append([(c, 0.0), (c + c, SHORTEN)] if n >= 3 else [(c * n, 0.0)])
        else:
            letters, drop = LOOK_ALIKES.get(c, ""), DROP if not c.isdigit() else KEEP_MARK
            one = [(x, SUBSTITUTE) for x in letters]
            if n >= 3:  # a stretched letter
                out.append(one + [(x + x, SUBSTITUTE + SHORTEN) for x in letters] + [("", drop)])
            else:
                out += [[*one, ("", drop)]] * n
        i = j
    return out


def decoded(places: list[list[tuple[str, float]]], model: np.ndarray, most: int, edges: bool) -> list[str]:
    """The `most` likeliest letter strings of a lattice, best first: Viterbi over (last two letters), each
    state with its best strings. With edges a word may end after any place; words are parted by spaces."""
    states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for place in places:
        grown: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), kept in states.items():
            for string, cost in place:
                p, x, y = cost, a, b
                for c in string:
                    z = LETTER.get(c, 1)
                    p += model[x, y, z]
                    x, y = y, z
                grown.setdefault((x, y), []).extend((s + p, t + string) for s, t in kept)
                if edges and string and y:
                    p += model[x, y, 0] + EDGE
                    grown.setdefault((0, 0), []).extend((s + p, t + string + " ") for s, t in kept)
        states = {k: sorted(v, reverse=True)[:most] for k, v in grown.items()}
    ends = sorted(((s + (model[a, b, 0] if b else 0.0), t.strip()) for (a, b), kept in states.items() for s, t in kept), reverse=True)
    return list(dict.fromkeys(t for _, t in ends if t))[:most]


def readings(word: str, model: np.ndarray, most: int = READINGS, run: bool = False) -> list[str]:
    """The likeliest words behind a raw one. A run of spaced-out symbols, or a word of more places than a
    window, may hold several: it is read with word edges, window by window; a word that a window's
    border may have cut is left to the next window."""
    places = lattice(word)
    if len(places) <= WINDOW and not run:
        return decoded(places, model, most, False)
    out: dict[str, None] = {}
    for at in range(0, max(1, len(places) - OVERLAP), WINDOW - OVERLAP):
        last = at + WINDOW >= len(places)
        for text in decoded(places[at : at + WINDOW], model, most, True):
            words = text.split()
            out |= dict.fromkeys(words[(1 if at else 0) : len(words) if last else -1] or (words if len(words) == 1 else []))
    return list(out)


def restored(word: str, model: np.ndarray) -> list[str]:
    """Plain parts of a raw lower-cased token, and its readings where it shows signs of noise."""
    run = word.startswith(RUN)
    core = word.strip(AROUND + RUN)
    if run:
        return [core, *readings(core, model, run=True)]
    if core.isalpha() and not TRIPLE.search(core):
        return [core]
    out = PLAIN.findall(core)
    plain = ORNAMENT.sub("", core)
    if len(out) == 1 and plain == out[0] and not TRIPLE.search(plain):
        return out
    if len(core) > 2 and NOISY.search(core):
        out += readings(plain if len(plain) > 2 else core, model)
        if plain != core:
            out += readings(core, model)
    return out


def raw_tokens(text: str | None) -> set[str]:
    """Distinct white-space tokens, lower-cased, and runs of spaced-out symbols put together after a RUN mark."""
    if not text:
        return set()
    text = text.lower()
    out = set(text.split())
    for m in SPACED.finditer(text):
        out.add(RUN + re.sub(r"[ .\-_*]", "", m[0]))
    return out


# --- score -----------------------------------------------------------------------------------


def features(word: str) -> list[str]:
    """The word, its prefixes of 3 to 6 letters and its suffixes of 4 to 6."""
    n = len(word)
    return ["=" + word] + ["<" + word[:k] for k in range(3, min(n, 7))] + [">" + word[-k:] for k in range(4, min(n, 7))]


def log_odds(p: np.ndarray, n: np.ndarray, docs_p: float, docs_n: float) -> np.ndarray:
    """Lower confidence bound of the log-odds ratio of a feature's document frequencies."""
    lo = np.log((p + 0.5) / (docs_p + 1)) - np.log((n + 0.5) / (docs_n + 1))
    return lo - 1.64 * np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))


def shape(values: list[float]) -> list[float]:
    """What the regression sees of a document's token values."""
    top = sorted(values, reverse=True)[:8] + [0.0] * 8
    return [top[0], top[1], top[2], sum(top[:8]) / 8, math.log1p(sum(v > 3 for v in values))]


@dataclass(frozen=True)
class Scorer:
    model: np.ndarray
    table: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        # a word whose first three and last four letters begin and end no feature needs no look-up of these
        object.__setattr__(self, "heads", {f[1:4] for f in self.table if f[0] == "<"})
        object.__setattr__(self, "tails", {f[-4:] for f in self.table if f[0] == ">"})

    def word(self, word: str) -> float:
        get, best = self.table.get, self.table.get("=" + word, 0.0)
        n = min(len(word), 7)
        if word[:3] in self.heads:
            best = max([best, *(get("<" + word[:k], 0.0) for k in range(3, n))])
        if word[-4:] in self.tails:
            best = max([best, *(get(">" + word[-k:], 0.0) for k in range(4, n))])
        return best

    def token(self, raw: str) -> float:
        return max((self.word(w) for w in restored(raw, self.model)), default=0.0)

    def probability(self, shapes: np.ndarray) -> np.ndarray:
        z = (shapes - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def regression(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last weight is the intercept."""
    x1 = np.c_[x, np.ones(len(x))]
    ridge = np.diag([l2] * x.shape[1] + [1e-6])
    b = np.zeros(x1.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -40, 40)))
        step = np.linalg.solve(x1.T @ (x1 * (w * p * (1 - p))[:, None]) + ridge, x1.T @ (w * (y - p)) - ridge @ b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return b


def training_rows(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of labelled documents that may be learned from, in hash order of their ids
    (doc_id, text, y, half), and how many labelled ids each class has in all."""
    may = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    may = may.where(F.pmod(crc32_of_id(), F.lit(3)) != 1).withColumn("h", F.xxhash64("doc_id"))
    totals = {r["y"]: r["count"] for r in may.groupBy("y").count().collect()}
    picked = [may.where(F.col("y") == y).orderBy("h", "doc_id").limit(n) for y, n in ((1, positives), (0, negatives))]
    sample = picked[0].union(picked[1]).withColumn("half", F.pmod(F.shiftright("h", 7), F.lit(2)).cast("int")).drop("h")
    # at most positives + negatives rows of three numbers
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), totals


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Scorer:
    """Learn from labelled rows whose crc32(doc_id as text) mod 3 is not 1: `positives` toxic and
    `negatives` other ones at most, the bounds of the sample. The character model counts all texts
    and no label. Without labelled documents of both classes, every score is the share of toxic labels (0.5 without any)."""
    model = trigram_model(trigram_counts(docs))
    rows, totals = training_rows(docs, labels, positives, negatives)
    nothing = (np.zeros(5), np.ones(5))
    share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    constant = Scorer(model, {}, *nothing, np.r_[np.zeros(5), math.log(share / (1 - share))])
    if not totals.get(0) or not totals.get(1):
        return constant

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [" ".join(sorted({w for raw in raw_tokens(t) for w in restored(raw, model)})) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "half": pdf["half"], "words": found})

    sample = saved(rows.mapInPandas(words, "doc_id long, y int, half int, words string"), "toxic-sample")

    def of_toxic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for ws in pdf["words"]:
                n.update({f for w in ws.split() for f in features(w)})
        if n:
            yield pd.DataFrame({"f": list(n), "n": list(n.values())})

    seen = sample.where("y = 1").select("words").mapInPandas(of_toxic, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    known = {f: i for i, f in enumerate(seen.select("f").orderBy("f").toArrow()["f"].to_pylist())}  # bounded by the sample of toxic rows

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for ws, y, half in zip(pdf["words"], pdf["y"], pdf["half"], strict=True):
                n.update((f, y, half) for f in {known[f] for w in ws.split() for f in features(w) if f in known})
        if n:
            yield pd.DataFrame([(f, int(y), int(h), c) for (f, y, h), c in n.items()], columns=["f", "y", "half", "n"])

    counts = np.zeros((len(known), 2, 2))
    met = sample.mapInPandas(counted, "f long, y int, half int, n long").groupBy("f", "y", "half").agg(F.sum("n").alias("n")).toArrow()
    counts[tuple(met[c].to_numpy() for c in ("f", "y", "half"))] = met["n"].to_numpy()
    size = np.zeros((2, 2))
    for r in sample.groupBy("y", "half").count().collect():
        size[r["y"], r["half"]] = r["count"]

    names = list(known)

    def table(halves: list[int]) -> dict[str, float]:
        c, d = counts[:, :, halves].sum(axis=2), size[:, halves].sum(axis=1)
        v = log_odds(c[:, 1], c[:, 0], d[1], d[0])
        return {names[i]: float(v[i]) for i in np.flatnonzero((v > LEAST_VALUE) & (c[:, 1] >= 2))}

    other = [Scorer(model, table([1]), *nothing, np.zeros(6)), Scorer(model, table([0]), *nothing, np.zeros(6))]

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [shape([v for w in ws.split() if (v := other[h].word(w))]) for ws, h in zip(pdf["words"], pdf["half"], strict=True)]
            yield pd.DataFrame({"y": pdf["y"], **{f"x{i}": [r[i] for r in x] for i in range(5)}})

    seen_rows = sample.mapInPandas(shapes, "y int, " + ", ".join(f"x{i} double" for i in range(5))).toArrow()  # at most the sample
    x, y = np.stack([seen_rows[f"x{i}"].to_numpy() for i in range(5)], axis=1), seen_rows["y"].to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return constant
    order = np.lexsort((*x.T, y))  # the sum's order is then the same in every run
    x, y = x[order], y[order]
    w = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    return Scorer(model, table([0, 1]), mean, scale, regression((x - mean) / scale, y, w / w.mean()))


def score(docs: DataFrame, scorer: Scorer, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """docs' columns named in keep (doc_id alone by default) plus the score, whole texts read in batches."""
    kept = keep or ["doc_id"]
    # the tables are bounded by the letters and by the training sample
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, cache = shared.value, {}
        for batch in batches:
            rows = []
            for text in batch.column("_text"):
                values = []
                for raw in raw_tokens(text.as_py()):
                    v = cache.get(raw)
                    if v is None:
                        if len(cache) >= CACHE:
                            cache.clear()
                        v = cache[raw] = s.token(raw)
                    if v:
                        values.append(v)
                rows.append(shape(values))
            p = s.probability(np.array(rows, float).reshape(-1, 5))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p)], names=[*kept, out])

    schema = docs.select(*kept, F.lit(0.0).alias(out)).schema
    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts get the score of a document without known words; repeated rows stay;
    null ids count as not held out by their empty text; labels of unknown ids, null labels and
    further columns are ignored; an empty table gives no rows."""
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (F.pmod(crc32_of_id(), F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
