"""Exact deduplication by progressive refinement, in DataFrame functions only.

Rows are grouped by text length, then by a hash of the text's first characters, and only rows
whose (length, prefix) pair is shared are hashed in full. What a row shares is known from a bitmap
of fixed size, so the rows' own scan decides: no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that the prefix hash reads.
PREFIX_CHARS = 128
#: Bits of the map of shared (length, prefix) pairs: 2^23 bits are 1 MiB, however large the input.
MAP_BITS = 1 << 23
#: Parts into which the rows of one text are dealt when they look up their group.
SALTS = 32


def _cell(length: Column, prefix: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(length, prefix), F.lit(bits)) + 1


def _shared_map(sketch: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the (length, prefix) pairs that more than one row has; at most bits / 8 bytes in all."""
    shared = sketch.groupBy("n_bytes", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    cell = _cell(F.col("n_bytes"), F.col("prefix"), bits)
    return shared.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bitmap"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, prefix_chars: int = PREFIX_CHARS, map_bits: int = MAP_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; a null text counts as empty. Of equal texts the row
    with the largest id stays. ``text_sha256`` is null for rows that length and prefix set apart,
    unless ``digest_all``. A null id ranks below all others; a group without any id has a null
    keep_id and stays. Rows that repeat the id that stays are all kept, since ids name rows. An
    empty table gives no rows; other columns of ``docs`` are not read, so their names don't matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"n_bytes": F.octet_length("text"), "prefix": F.xxhash64(F.substring("text", 1, prefix_chars))})
    shared = F.broadcast(_shared_map(rows.select("n_bytes", "prefix"), map_bits))

    cell = _cell(F.col("n_bytes"), F.col("prefix"), map_bits)
    bit = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.expr("substring(bitmap, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("bitmap IS NOT NULL") & (byte.bitwiseAND(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")) != 0), F.lit(False))
    sketched = rows.withColumns({"bucket": F.bitmap_bucket_number(cell), "bit": bit}).join(shared, "bucket", "left")
    digest = F.sha2("text", 256)
    refined = sketched.select("doc_id", "n_bytes", hit.alias("hit"), (digest if digest_all else F.when(hit, digest)).alias("text_sha256"))

    groups = refined.where("hit").groupBy("n_bytes", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = groups.select(F.col("text_sha256").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "keep_id", "group_size")
    spread = F.xxhash64("doc_id")
    # rows that are set apart get keys of their own, so that no task gets them all
    asked = refined.withColumns({"key": F.when(F.col("hit"), F.col("text_sha256")).otherwise(F.hex(spread)), "salt": F.pmod(spread, F.lit(SALTS)).cast("int")})
    found = asked.join(groups, ["key", "salt"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op10(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)
