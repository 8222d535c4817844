"""Bloom filters of content hashes as tables of bitmaps, sized by what they hold.

A filter of m bits is rows (bucket, bits) of BUCKET bits each, made by one aggregate and asked by a
join on the bucket, so it may be larger than any task. Its k places of a hash come from the hash's own
hex digits, by double hashing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.geometry import div

#: Fixed value: bits of one bitmap of bitmap_construct_agg().
BUCKET = 32768
#: Share of absent hashes that a filter takes for present, unless a caller says otherwise.
RATE = 0.01


def sized(n: int, rate: float = RATE) -> tuple[int, int]:
    """(bits, places) of a filter of n hashes that errs at ``rate``."""
    bits = max(8, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def expected_rate(n: int, bits: int, places: int) -> float:
    return (1 - math.exp(-places * n / bits)) ** places


def _places(hash_: Column, bits: int, places: int) -> Column:
    part = lambda at: F.conv(F.substring(hash_, at, 14), 16, 10).cast("long")
    return F.array(*[(part(1) + part(15) * i) % bits for i in range(places)])


def build(hashes: DataFrame, bits: int, places: int) -> DataFrame:
    """(bucket, bits) of the filter of ``hashes`` (hash); nulls are passed over."""
    set_ = hashes.where("hash IS NOT NULL").select(F.explode(_places(F.col("hash"), bits, places)).alias("at"))
    return set_.groupBy(div(F.col("at"), BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BUCKET).alias("bits"))


def ask(hashes: DataFrame, filter_: DataFrame, bits: int, places: int) -> DataFrame:
    """(hash, present) for the distinct ``hashes``: whether all places are set; false is certain."""
    asked = hashes.select("hash").distinct().select("hash", F.explode(_places(F.col("hash"), bits, places)).alias("at"))
    found = asked.withColumn("bucket", div(F.col("at"), BUCKET)).join(filter_, "bucket", "left")
    byte = F.conv(F.hex(F.expr(f"substring(bits, CAST((at % {BUCKET}) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(F.call_function("shiftright", byte, (F.col("at") % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return found.groupBy("hash").agg(F.bool_and(is_set).alias("present"))


def patch(wanted: DataFrame, held: DataFrame, rate: float = RATE) -> tuple[DataFrame, int, int]:
    """((hash, round) to send, bits, places): 'sent' are the wanted hashes that the filter of ``held`` hasn't, 'repair' those withheld though not held.

    The filter is what the holder sends; the repair is a second round in which it asks for what the
    filter took for present.
    """
    held = held.select("hash").distinct()
    bits, places = sized(held.count(), rate)
    said = ask(wanted, build(held, bits, places), bits, places)
    sent = said.where("NOT present").select("hash", F.lit("sent").alias("round"))
    repair = said.where("present").join(held, "hash", "left_anti").select("hash", F.lit("repair").alias("round"))
    return sent.unionByName(repair), bits, places
