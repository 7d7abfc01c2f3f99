"""Document fingerprints: bottom-k sketches of shingle hashes, in Spark SQL functions alone.

A sketch is the sorted array of the k least distinct XXH64 values (as signed longs) of a
text's word shingles. Sketches merge by union and re-cut, and the k least of a union of two
estimate resemblance, containment and distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import row_bucket, text_of

K = 128
WORDS = 5
LEAST, SPAN = -(2.0**63), 2.0**64


WHITE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Lower-cased words between runs of ASCII white space; one empty word for a blank text.

    Make this a column of its own before taking sketches: expressions inside lambdas are evaluated per element."""
    return F.split(F.btrim(F.lower(text), F.lit(WHITE)), "[\\x20\\x09-\\x0D]+")


def sketch(words: Column, k: int = K, words_per_shingle: int = WORDS) -> Column:
    """The k least distinct hashes of the shingles; of all the words where there are fewer; empty without words."""
    many = F.size(words) >= words_per_shingle
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - words_per_shingle), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, words_per_shingle), " ")))
    whole = F.array_join(words, " ")
    return F.when(many, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).when(whole == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(whole)))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the k least of the union that both have. Two empty sketches are alike."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the hash range."""
    place = (F.element_at(a, -1).cast("double") - F.lit(LEAST)) / F.lit(SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def merged_sketches(sketches: DataFrame, group: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch a group: only hashes that are among the k least of some part are exchanged, already distinct."""
    hashes = sketches.select(*group, F.explode(column).alias("_h")).distinct()
    w = Window.partitionBy(*group).orderBy("_h")
    return hashes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*group).agg(F.sort_array(F.collect_list("_h")).alias(column))


def shown(a: Column) -> Column:
    """A sketch as one string: base64 of its hashes as big-endian 8-byte words."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def with_guests(docs: DataFrame, per_bucket: int = 256) -> DataFrame:
    """docs (doc_id, ...) dealt to ranges of doc_id, with columns bucket and guest: a window over bucket,
    ordered by guest and descending doc_id, sees every row's successor. A range's last row is followed by
    the first row of the next lower range (the lowest by the first row of all), sent there too as a guest.

    Only range edges, at most 65,536 numbers, reach the driver; the table of first rows has one row a range."""
    ids = docs.select("doc_id")
    rows = ids.count()
    n = row_bucket(rows, per_bucket)
    edges: list[int] = []
    if n > 1:
        edges = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], min(100 * n, 1_000_000))).first()[0] or []))
    bucket = _range(F.col("doc_id"), edges)
    heads = ids.groupBy(bucket.alias("range")).agg(F.max("doc_id").alias("head"))
    down = Window.orderBy("range")  # over one row a range
    to = F.coalesce(F.lead("range").over(down), F.min("range").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    goes = heads.select("head", to.alias("to"))
    dealt = docs.withColumn("bucket", bucket)
    guests = dealt.join(F.broadcast(goes), F.col("doc_id").eqNullSafe(F.col("head"))).withColumn("bucket", F.col("to")).drop("head", "to")
    return dealt.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))


def _range(x: Column, edges: list[int]) -> Column:
    """How many edges are below x, counted first among every w-th edge, then among the w after it; -1 for null."""
    if not edges:
        return F.when(x.isNull(), -1).otherwise(0)
    w = max(1, int(len(edges) ** 0.5))
    numbers = lambda e: F.split(F.lit(",".join(map(str, e))), ",").cast("array<bigint>")
    coarse = F.size(F.filter(numbers(edges[w - 1 :: w]), lambda e: e < x)) * w
    fine = F.size(F.filter(F.slice(numbers(edges), coarse + 1, w), lambda e: e < x))
    return F.when(x.isNull(), -1).otherwise(coarse + fine)


def edited(text: Column, n_chars: Column, following: Column) -> Column:
    """The text with its last third replaced by as many first code points of the following text, or all it has."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars - third), F.substring(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, k: int = K, words_per_shingle: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    containment and distinct-count estimates.

    A null text is empty; blank texts have the empty sketch, alike with each other only; null ids
    come last and repeated ids are ordered by the hash of their text; a single row is its own
    successor; an empty table gives no rows; other columns are ignored. Texts are shuffled once."""
    slim = docs.select("doc_id", text_of().alias("text"))
    dealt = with_guests(slim).withColumn("tie", F.xxhash64("text"))
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie")
    met = dealt.withColumn("following", F.lead("text").over(w)).withColumn("n_chars", F.char_length("text"))
    met = met.withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.coalesce("following", F.lit(""))))
    order = ["bucket", "guest", "doc_id", "tie", "n_chars"]
    split = met.select(*order, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), words(F.col("text")).alias("w"), words(F.col("edited")).alias("we"))
    both = split.select(*order, "edited_sha256", sketch(F.col("w"), k, words_per_shingle).alias("a"), sketch(F.col("we"), k, words_per_shingle).alias("e"))
    both = both.withColumn("b", F.lead("a").over(w)).where("guest = 0")
    a, e, b = F.col("a"), F.col("e"), F.col("b")
    return both.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        shown(a).alias("fingerprint"),
        shown(e).alias("edited_fingerprint"),
        resemblance(a, e, k).alias("near_edited"),
        resemblance(a, b, k).alias("near_next"),
        containment(a, e, k).alias("contained_in_edited"),
        distinct_shingles(a, k).alias("distinct_shingles"),
    )
