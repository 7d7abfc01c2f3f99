"""What the corpus operators share: table access, shared scratch tables, text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.shared import written

#: A-Z to a-z on UTF-8 bytes; other letters keep their case.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at a table that outlives any executor. Tables go
    with the application, or sooner by `removed`."""
    return written(df, name)


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ of the text with A-Z lower-cased, as UTF-8 bytes.

    bytes.split() parts at exactly the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_AZ).split() if text else []


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def row_bucket(rows: int, per_bucket: int, most: int = 1 << 16) -> int:
    """How many buckets hold about per_bucket rows each."""
    return max(1, min(most, -(-rows // per_bucket)))
