"""Keyed-table operators (K1-K4): set union, membership, lookup with default, merge.

Table forms of what a hash set / hash map offers on one machine; every one is
a join or an aggregation with partial aggregation, so no key group is ever
collected into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtables.operators.skew import split_join

MERGES = ("sum", "max", "min", "bit_or", "last")


def id_union(a: DataFrame, b: DataFrame, column: str = "id") -> DataFrame:
    """K1: distinct union of two id sets."""
    return a.select(column).union(b.select(column)).distinct()


def id_membership(candidates: DataFrame, members: DataFrame, column: str = "id") -> DataFrame:
    """K2: rows of ``candidates`` whose id occurs in ``members`` (left semi join).

    ``members`` is de-duplicated first (partial aggregation before the shuffle),
    so a member repeated by a large share of the rows is one build row.
    """
    return candidates.join(members.select(column).distinct(), column, "left_semi")


def lookup(keys: DataFrame, table: DataFrame, key: str = "id", value: str = "value",
           default: object | None = None) -> DataFrame:
    """K3: value of each key, or ``default`` when absent (``None``: no default, null stays).

    ``table`` must have unique keys, else a key would fan out. A key repeated in
    ``keys`` by a large share of the rows is looked up by broadcast.
    """
    t = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    j = split_join(keys.select(key), t, [key], ["_k"], "left").select(key, F.col("_v").alias(value))
    v: Column = F.col(value)
    if default is not None:
        v = F.coalesce(v, F.lit(default).cast(table.schema[value].dataType))
    return j.select(key, v.alias(value))


def keyed_merge(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value",
                how: str = "sum", seq: str | None = None) -> DataFrame:
    """K4: insert keys that are absent, merge values of keys present in both.

    ``how``: ``sum``, ``max``, ``min``, ``bit_or`` (commutative, partial
    aggregation before the shuffle), or ``last`` = value with the highest
    ``seq`` (last-wins update; ``seq`` must be unique per key).
    Duplicate keys within one side are merged the same way.
    """
    if how not in MERGES:
        raise ValueError(f"how must be one of {MERGES}")
    cols = [key, value] + ([seq] if how == "last" else [])
    if how == "last" and seq is None:
        raise ValueError("how='last' needs a sequence column")
    both = old.select(*cols).unionByName(new.select(*cols))
    if how == "sum":
        agg = F.sum(value)
    elif how == "max":
        agg = F.max(value)
    elif how == "min":
        agg = F.min(value)
    elif how == "bit_or":
        agg = F.bit_or(value)
    else:
        agg = F.max_by(value, seq)
    return both.groupBy(key).agg(agg.alias(value))
