"""Deterministic sharded WARC writer and its reader.

Pages are dealt to ranges of page_id whose edges come from exact counts, refined where ids lie
close together; an id with very many pages is split by digest. Ranges are sorted and
written a range at a time, streaming: each record is its own gzip member with regenerated
headers and digests and no clock or random number in it, and a file is closed once its
compressed size passes `roll_bytes`. A file is written under a temporary name and renamed;
the manifest, a table that Spark commits, names the files that count. A task that runs again
writes the same bytes to the same names, so a lost executor leaves nothing wrong behind.

Equal payloads: the page with the least page_id is the response and the others revisit it.
Which pages these are is found on ids and digests alone; the outcome travels to the writer as
a row that sorts just before its page, so the payloads are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.shared import scratch

WARC_DATE = datetime(2020, 1, 1, tzinfo=timezone.utc)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
BINS = 1 << 16
FILES_PER_TASK = 4


def cell_of(starts: np.ndarray, ends: np.ndarray, widths: np.ndarray):
    """The first value of the cell that a value is in, NULL outside all spans."""

    @F.pandas_udf("long")
    def cell(v: pd.Series) -> pd.Series:
        known = v.notna().to_numpy()
        x = v.fillna(0).to_numpy(np.int64)
        k = np.maximum(np.searchsorted(starts, x, side="right") - 1, 0)
        known &= (x >= starts[k]) & (x <= ends[k])
        past = (x.view(np.uint64) - starts[k].view(np.uint64)) // widths[k] * widths[k]  # modulo 2^64, so spans may pass 2^63
        return pd.Series((starts[k].view(np.uint64) + past).view(np.int64), dtype="Int64").where(pd.Series(known))

    return cell


def cells(values: DataFrame, column: str, most: int, bins: int = BINS) -> list[tuple[int, int]]:
    """(first value, rows) of cells that cover a long column's values in order: a cell has `most` rows at most,
    or is one value. Spans with more rows are cut again, all at once, so an outlier costs one more pass; at
    most `bins` counts reach the driver in a pass."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    todo, done = [] if lo is None else [(lo, hi)], []
    while todo:
        per = max(2, bins // len(todo))
        starts, ends = (np.array(x, np.int64) for x in zip(*sorted(todo), strict=True))
        widths = np.array([(b - a) // per + 1 for a, b in sorted(todo)], np.uint64)
        found = values.select(cell_of(starts, ends, widths)(F.col(column).cast("long")).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("cell IS NOT NULL").toArrow()
        todo = []
        for a, n in zip(found["cell"].to_pylist(), found["n"].to_pylist(), strict=True):
            k = int(np.searchsorted(starts, a, side="right")) - 1
            if n > most and widths[k] > 1:
                todo.append((a, min(int(ends[k]), a + int(widths[k]) - 1)))
            else:
                done.append((a, n))
    return sorted(done)


def range_of(df: DataFrame, column: str, digest: Column, per_range: int) -> Column:
    """The range number of a row by (column, digest), nulls last: about per_range rows each. A value with more
    rows than that is split by its digest (hexadecimal); rows equal in both stay together."""
    nulls = df.where(F.col(column).isNull()).count()
    edges, parts, run = [], [], 0
    for first, n in cells(df, column, per_range):
        if run and run + n > per_range:
            run = 0
        if not run:
            edges.append(first)
            parts.append(1)
        run += n
        parts[-1] = max(parts[-1], -(-n // per_range))
        if n >= per_range:
            run = 0
    parts.append(max(1, -(-nulls // per_range)))
    at, parts_, base = np.array(edges, np.int64), np.array(parts, np.int64), np.r_[0, np.cumsum(parts)]

    @F.pandas_udf("int")
    def number(v: pd.Series, head: pd.Series) -> pd.Series:
        r = np.maximum(np.searchsorted(at, v.fillna(0).to_numpy(np.int64), side="right") - 1, 0)
        r = np.where(v.isna(), len(at), r)
        return pd.Series((base[r] + ((head.fillna(0).to_numpy(np.int64) * parts_[r]) >> 32)).astype(np.int32))

    return number(F.col(column), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def record(kind: str, block: bytes, **headers: object) -> bytes:
    """One record as one gzip member; headers without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None), f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = {"WARC_Record_ID": _id(page_id, url, digest), "WARC_Date": date, "WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}", "X_Page_Id": page_id, "X_Null_Url": None if url is not None else 1, "X_Payload_Length": len(payload), "Content_Type": "application/http;msgtype=response"}
    if revisit:
        return record("revisit", http, **common, WARC_Profile=REVISIT_PROFILE, X_Refers_To_Page_Id=refers_to)
    return record("response", http + payload, **common)


def _archive(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        shard, rolled, parts, ids, size, count, seen, role = None, 0, [], [], 0, 0, None, None

        def close() -> list[dict]:
            nonlocal parts, ids, size, count, rolled
            if not parts:
                return []
            name, data = f"shard-{shard:06d}-{rolled:05d}.warc.gz", b"".join(parts)
            tmp = f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(tmp, compression=None) as f:
                f.write(data)
            fs.move(tmp, f"{root}/{name}")
            row = {"shard": shard, "file": name, "records": count, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "first_id": min(ids, default=None), "last_id": max(ids, default=None)}
            parts, ids, size, count, rolled = [], [], 0, 0, rolled + 1
            return [row]

        fields = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    done += close()
                    shard, rolled, seen, role = r["shard"], 0, None, None
                key = (r["page_id"], r["digest"])
                if not r["is_page"]:
                    role = (key, r["refers_to"])
                    continue
                known = role is not None and role[0] == key
                revisit = known or seen == key
                refers = role[1] if known else r["page_id"] if revisit else None
                if not parts:
                    info = b"software: barloom\r\nformat: WARC File Format 1.1\r\n"
                    parts.append(record("warcinfo", info, WARC_Record_ID=_id("warcinfo", shard, rolled), WARC_Date=date, WARC_Filename=f"shard-{shard:06d}-{rolled:05d}.warc.gz", Content_Type="application/warc-fields"))
                    size = len(parts[0])
                data = page_record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), revisit, refers, date)
                parts.append(data)
                ids += [] if r["page_id"] is None else [r["page_id"]]
                size, count, seen = size + len(data), count + 1, key
                if size >= roll_bytes:
                    done += close()
            if done:
                yield pa.RecordBatch.from_pylist(done, fields)
        if done := close():
            yield pa.RecordBatch.from_pylist(done, fields)

    return run


def write(pages: DataFrame, folder: str, per_shard: int = 512, roll_bytes: int = 4 << 20, min_payload: int = 0, date: datetime = WARC_DATE) -> DataFrame:
    """Write pages (page_id, url, html) under folder/data; the manifest, read back from folder/manifest.

    A null html is an empty payload; payloads under min_payload bytes are never revisited; a null
    page_id sorts last, and is referred to only by other null ids; of repeated rows the first is the
    response and the rest revisit it; an empty table gives an empty manifest; other columns are ignored."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    ids = hashed.where(F.col("n") >= min_payload).groupBy("digest", "page_id").agg(F.lit(1))
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("pages")).where("pages > 1")
    again = ids.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")
    # repeated rows of a small payload are all responses: a digest of their own keeps them apart
    page_digest = F.when(F.col("n") >= min_payload, F.col("digest"))
    both = hashed.select("page_id", page_digest.alias("digest"), F.lit(True).alias("is_page"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    both = both.unionByName(again.withColumn("is_page", F.lit(False)), allowMissingColumns=True)
    shard = range_of(pages.select(F.col("page_id").cast("long").alias("page_id")), "page_id", F.col("digest"), per_shard)
    dealt = both.withColumn("shard", shard.cast("int")).repartition(F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "is_page", "url")
    dealt.mapInArrow(_archive(f"{folder}/data", roll_bytes, date.strftime("%Y-%m-%dT%H:%M:%SZ")), MANIFEST).write.mode("error").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, each unpacked."""
    view, at = memoryview(data), 0
    while at < len(data):
        d, out = zlib.decompressobj(31), []
        while at < len(data) and not d.eof:
            out.append(d.decompress(view[at : at + step]))
            at = min(at + step, len(data))
        if not d.eof:
            raise ValueError("a gzip member is cut off")
        at -= len(d.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    digest = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    if digest != headers["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {headers['WARC-Record-ID']} differs")
    return {"headers": headers, "block": block}


def _page(rec: dict, payloads: bool) -> dict:
    h = rec["headers"]
    number = lambda k: int(h[k]) if k in h else None
    out = {"page_id": number("X-Page-Id"), "url": None if "X-Null-Url" in h else h["WARC-Target-URI"], "payload_bytes": number("X-Payload-Length"), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": h["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload": None}
    if h["WARC-Type"] == "response":
        payload = rec["block"].partition(b"\r\n\r\n")[2]
        if (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (out["payload_bytes"], out["payload_digest"]):
            raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its headers")
        out["payload"] = payload if payloads else None
    return out


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The page records of the files in the manifest. Files, blocks and payloads are checked against their digests."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(f"{folder}/data")
        fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for f in batch.to_pylist():
                with fs.open_input_stream(f"{root}/{f['file']}", compression=None) as stream:
                    data = stream.read()
                if hashlib.sha256(data).hexdigest() != f["sha256"]:
                    raise ValueError(f"{f['file']} differs from the manifest")
                found = [_page(r, payloads) for r in map(parse, members(data)) if r["headers"]["WARC-Type"] in ("response", "revisit")]
                if len(found) != f["records"]:
                    raise ValueError(f"{f['file']} has {len(found)} records, the manifest {f['records']}")
                yield pa.RecordBatch.from_pylist(found, fields)

    # by number, or the small rows of the manifest would be merged into one task
    files = manifest.select("file", "records", "sha256")
    return files.repartition(max(1, -(-files.count() // FILES_PER_TASK)), "file").mapInArrow(run, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Write pages to an archive in the shared folder and read its records back."""
    folder = f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return read(pages.sparkSession, folder)
