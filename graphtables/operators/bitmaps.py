"""Id sets as bitmaps (K1, K2): union, intersection and sizes without moving ids.

A set is a table ``bucket BIGINT, bits BINARY``: of each 32,768 consecutive ids one bitmap of 4,096 bytes. Ids become bits where
they lie (a task sends one bitmap a bucket, however many rows or copies it has), and every operator afterwards works
on bitmaps: the shuffled rows are buckets, never ids. Made for dense ids; scattered ones (a bucket an id would cost
4 KB each) are numbered first (:func:`graphtables.operators.numbering.vertex_slots`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bits of a bitmap
BUCKET_BITS = 32_768


def id_bitmap(ids: DataFrame, column: str = "id") -> DataFrame:
    """The set of the not-null values of an integer column."""
    v = F.col(column).cast("long")
    return ids.where(v.isNotNull()).groupBy(F.bitmap_bucket_number(v).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits"))


def bitmap_union(*sets: DataFrame) -> DataFrame:
    """K1: the union of sets."""
    both = sets[0]
    for other in sets[1:]:
        both = both.unionByName(other)
    return both.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """K2: the ids of ``a`` that are members of ``b``; buckets that only one has drop out."""
    both = a.unionByName(b).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return both.where("n = 2").select("bucket", "bits").where(F.bitmap_count("bits") > 0)


def bitmap_size(set_: DataFrame) -> DataFrame:
    """The number of ids, as one row ``n BIGINT``."""
    return set_.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("n"))


def bitmap_ids(set_: DataFrame, column: str = "id") -> DataFrame:
    """The ids of a set, one row each; made from the bitmaps where they lie."""
    # a byte at a time, and of bytes with bits their bits
    byte = F.conv(F.hex(F.substring("bits", F.col("at") + 1, F.lit(1))), 16, 10).cast("int")
    at = set_.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(BUCKET_BITS // 8 - 1))).alias("at"))
    bits = at.select("bucket", "at", byte.alias("byte")).where("byte > 0").select(
        "bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    found = bits.where(F.expr("(byte >> bit) & 1") == 1)
    position = (F.col("at") * 8 + F.col("bit")).cast("long")
    above = (F.col("bucket") - 1) * BUCKET_BITS + position + 1       # buckets from 1 on hold positive ids
    below = F.col("bucket") * BUCKET_BITS - position                # the others the rest, downwards
    return found.select(F.when(F.col("bucket") > 0, above).otherwise(below).alias(column))
