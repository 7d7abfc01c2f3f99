r"""Secret scans: patterns on whole texts, then linking of multipart credentials.

Every text is scanned for strong parts (assigned secrets, access identifiers, long hex) and
for weak ones: endpoints, user names, and bare strings of 32 and more base64 characters. A weak
part alone is noise; it is reported only where a part that completes it stands in the same
scope: the same document, with a gap of at most `SCOPE` code points from the end of one to
the start of the other, however long they are. An interval join finds those pairs: a weak
part overlaps none that it can meet, so the gap lies between a start and an end; weak parts
are dealt to the bins (of SCOPE code points) of both, all parts to the bins of both and their
neighbours, and the exact gap is checked.

    identifier (access, user)  +  secret (assign, hex, bare)  +  endpoint (any two roles)

The join runs over distinct texts (by SHA-256), so copies are linked once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import saved, text_of

#: Fixed by the contract. re.ASCII keeps "either case" to A-Z.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Runs shorter than 24 can only fail, and a longer run is one match either way.
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
#: Weak parts, reported only in company.
URL = re.compile(r"\b(?:https?|s3|gs|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}", re.ASCII)
#: Host names are whole chains of labels, found before it is asked whether they are of the cloud's domain: linear in any text.
HOST, CLOUD = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*", re.ASCII), ".amazonaws.com"
EDGE, LABEL = re.compile(r"\b", re.ASCII), re.compile(r"\b[a-z0-9-]", re.ASCII)
USER = re.compile(r"""\b(?:user(?:name)?|login|client_id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
KINDS = ["assign", "access", "hex", "endpoint", "user", "bare"]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "endpoint": "endpoint", "user": "identifier", "bare": "secret"}
STRONG = 3
SCOPE = 400
PARTS = "array<struct<kind:int,start:int,end:int>>"


def endpoints(text: str) -> Iterator[tuple[int, int]]:
    """Spans of URLs and of cloud host names, leftmost first, that don't overlap."""
    found = [m.span() for m in URL.finditer(text)]
    if CLOUD in text:
        for m in HOST.finditer(text):
            start, end = m.span()
            at = text.rfind(CLOUD, start + 1, end)
            while at > start and not EDGE.match(text, at + len(CLOUD)):  # the domain's last letter ends a word
                at = text.rfind(CLOUD, start + 1, at + len(CLOUD) - 1)
            first = LABEL.search(text, start, at) if at > start else None
            if first:
                found.append((first.start(), at + len(CLOUD)))
    last = 0
    for start, end in sorted(found):
        if start >= last:
            yield start, end
            last = end


def base_parts(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the contract's three kinds, by start, then kind; code points, end exclusive."""
    found = [(0, *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, *m.span()) for m in HEX_LONG.finditer(text)]
    return sorted(found, key=lambda p: (p[1], p[0]))


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that overlap no strong part and no weak one of an earlier kind."""
    taken = bytearray()
    out = []
    spans = lambda pattern: (m.span() for m in pattern.finditer(text))
    for kind, own in ((3, endpoints(text)), (4, spans(USER)), (5, spans(BARE))):
        for s, e in own:
            if not taken:
                taken = bytearray(len(text))
                for _, a, b in base:
                    taken[a:b] = b"\1" * (b - a)
            if not any(taken[s:e]):
                out.append((kind, s, e))
                taken[s:e] = b"\1" * (e - s)
    return sorted(out, key=lambda p: (p[1], p[0]))


def shown(parts: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in parts)


def scanned(docs: DataFrame) -> DataFrame:
    """docs without text, plus base and weak parts and the SHA-256 of each text that has weak parts."""
    kept = [c for c in docs.columns if c not in ("text", "sha", "base", "weak")]

    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, weak = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base.append(base_parts(text))
                weak.append(weak_parts(text, base[-1]))
            as_rows = lambda parts: pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in p] for p in parts], kind)
            sha = pa.array([s if w else None for s, w in zip(batch.column("sha").to_pylist(), weak, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sha, as_rows(base), as_rows(weak)], names=[*kept, "sha", "base", "weak"])

    schema = docs.select(*kept, F.lit("").alias("sha"), F.lit(None).cast(PARTS).alias("base"), F.lit(None).cast(PARTS).alias("weak")).schema
    for field in schema:
        field.nullable = True
    return docs.select(*kept, "text", F.sha2(text_of().cast("binary"), 256).alias("sha")).mapInArrow(run, schema)


def linked(scans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """sha -> the weak parts (array) that have a complementary part in scope. One row per distinct text.

    Texts without weak parts (sha is NULL), null and empty texts among them, have no row; parts that touch or
    lie at the same place count once; no scans give no rows."""
    texts = scans.where("sha IS NOT NULL").groupBy("sha").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    part = texts.select("sha", F.explode(F.concat("base", "weak")).alias("p")).select("sha", "p.*")
    part = part.withColumn("role", F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1))
    bins = lambda *steps: F.explode(F.array_distinct(F.array(*[F.floor(F.col(c) / scope).cast("int") + k for c in ("start", "end") for k in steps]))).alias("bin")
    weak = part.where(F.col("kind") >= STRONG).select("*", bins(0))
    near = part.select("sha", F.col("role").alias("role2"), F.col("start").alias("start2"), F.col("end").alias("end2"), bins(-1, 0, 1))
    gap = F.greatest("start", "start2") - F.least("end", "end2")
    met = weak.join(near, ["sha", "bin"]).where((F.col("role") != F.col("role2")) & (gap <= scope))
    # an endpoint or a user name needs a secret; a bare string needs either of them
    met = met.where((F.col("role2") == "secret") | (F.col("role") == "secret"))
    return met.groupBy("sha").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs without text, plus base (array of parts) and parts (base and linked, by start, then kind).

    A null text is empty and has no parts; a long text is scanned whole; equal texts get equal
    parts; repeated rows stay; an empty table gives no rows; columns named sha, base, weak,
    found or parts are replaced, other columns pass through."""
    docs = docs.drop("sha", "base", "weak", "found", "parts")
    scans = saved(scanned(docs), "secret-parts")
    alone = scans.where("sha IS NULL").withColumn("found", F.array().cast(PARTS))
    company = scans.where("sha IS NOT NULL").join(linked(scans, scope), "sha", "left")
    both = alone.unionByName(company)
    parts = F.concat("base", F.coalesce("found", F.array().cast(PARTS)))
    ordered = F.transform(F.array_sort(F.transform(parts, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    return both.withColumn("parts", ordered).drop("sha", "weak", "found")


def as_text(parts: str):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ",")


def redacted(docs: DataFrame, scope: int = SCOPE, mark: str = "[secret]") -> DataFrame:
    """docs with every reported span replaced by the mark; texts without one, nulls and empty texts are unchanged.

    Overlapping spans get one mark; repeated rows stay; an empty table gives no rows; other columns, whatever
    their names, are kept as they are."""
    columns = docs.columns
    own = [f"_{i}" for i in range(len(columns))]  # no name of docs meets one of the scan's
    spans = scan(docs.toDF(*own).withColumn("text", F.col(own[columns.index("text")])).withColumn("_text", F.col("text")), scope)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, parts in zip(batch.column("_text").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                if text is not None and parts:
                    pieces, at = [], 0
                    for p in parts:
                        if p["end"] > at:
                            pieces += [text[at : max(at, p["start"])], mark if p["start"] >= at else ""]
                            at = p["end"]
                    text = "".join([*pieces, text[at:]])
                out.append(text)
            columns_ = [pa.array(out, batch.column("_text").type) if c == "text" else batch.column(o) for c, o in zip(columns, own, strict=True)]
            yield pa.RecordBatch.from_arrays(columns_, names=columns)

    return spans.mapInArrow(run, docs.schema)
