"""Document fingerprints: canonical form, 128-bit xxhash, byte comparison inside equal buckets.

The canonical form is NFKC, case folding, NFKC again, and every run of white space as one blank with none at
the ends.  Documents are copies when their canonical forms are equal byte for byte.

Scale: a first pass shuffles only 16-byte digests and leaves a bitmap of the digests that occur twice, sixteen bits for each
of them but at most ``MOST_BITS`` (32 MB, so what is broadcast is bounded).  The second pass sends canonical text
into the shuffle only for documents whose digest is in the bitmap; every other one is known to be alone.  Beyond 16 million
repeated digests the bitmap fills and more lone texts are shuffled with the rest; the result stays the same.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.llm.base import arrow_map, staged, text_input

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def canonical(text: str) -> str:
    """NFKC, case folding, white space folding."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split())
    return " ".join(text.lower().split())


def _digests(texts: list[str | None]) -> tuple[list[bytes | None], list[bytes | None]]:
    """Canonical UTF-8 and digest of each text."""
    canon = [None if t is None else canonical(t).encode("utf-8", "surrogatepass") for t in texts]
    return canon, [None if c is None else xxhash.xxh3_128_digest(c) for c in canon]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the 16-byte digest of each document, null for a null text."""

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(_digests(b.column(1).to_pylist())[1], pa.binary())], ["doc_id", "digest"])

    return arrow_map(text_input(docs), digest, "doc_id bigint, digest binary")


def repeated_filter(docs: DataFrame, most_bits: int = MOST_BITS) -> bytes:
    """Bitmap with the slots of all digests that occur more than once; its size is a power of two."""

    def halves(b: pa.RecordBatch) -> pa.RecordBatch:
        d = [x for x in _digests(b.column(1).to_pylist())[1] if x is not None]
        return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(x[k : k + 8], "little", signed=True) for x in d], pa.int64()) for k in (0, 8)], ["low", "high"])

    twice = staged(arrow_map(text_input(docs), halves, "low bigint, high bigint").groupBy("low", "high").agg(F.count("*").alias("n")).where("n > 1").select("low"), "digests")
    bits = min(most_bits, max(min(LEAST_BITS, most_bits), 1 << (16 * twice.count() - 1).bit_length()))
    slot = F.col("low").bitwiseAND(F.lit(bits - 1)) + 1
    bitmaps = twice.select(slot.alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits"))
    out = bytearray(bits // 8)
    for row in bitmaps.collect():  # 8192 rows of 4 KiB at most
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.bits
    return bytes(out)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, first_doc_id, copies, keep), a row for each row of ``docs``.

    ``first_doc_id`` is the least doc_id among the copies, ``copies`` their number of rows, ``keep`` true on the one
    row that stays (ties: the least doc_id; of repeated rows one; null doc_ids last).

    Null text: no copy of anything (copies 1, first_doc_id its own, keep true).  Empty texts are copies of each
    other.  Null doc_id: an ordinary row, left out of ``first_doc_id`` unless all are null.  Empty table: no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(repeated_filter(docs))

    def second(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = shared.value
        last = 8 * len(bits) - 1
        canon, digest = _digests(b.column(1).to_pylist())
        lone = [None if d is None else not bits[(p := int.from_bytes(d[:8], "little") & last) >> 3] >> (p & 7) & 1 for d in digest]
        canon = [None if alone or alone is None else c for c, alone in zip(canon, lone)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(canon, pa.binary()), pa.array(lone, pa.bool_())], ["doc_id", "digest", "canon", "lone"])

    marked = arrow_map(text_input(docs), second, "doc_id bigint, digest binary, canon binary, lone boolean")
    group = Window.partitionBy("digest", "canon")
    shared_rows = marked.where("not lone").select(
        "doc_id",
        F.min("doc_id").over(group).alias("first_doc_id"),
        F.count("*").over(group).alias("copies"),
        (F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last())) == 1).alias("keep"),
    )
    alone = marked.where("lone is null or lone").select("doc_id", F.col("doc_id").alias("first_doc_id"), F.lit(1).cast("bigint").alias("copies"), F.lit(True).alias("keep"))
    return alone.unionByName(shared_rows)


ORACLE = r"""
WITH canon AS (
  SELECT doc_id, CASE WHEN text IS NOT NULL THEN trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g')) END AS c
  FROM documents)
SELECT doc_id,
       CASE WHEN c IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY c) END AS first_doc_id,
       CASE WHEN c IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY c) END AS copies,
       c IS NULL OR row_number() OVER (PARTITION BY c ORDER BY doc_id NULLS LAST) = 1 AS keep
FROM canon
"""
