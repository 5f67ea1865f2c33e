"""Dense vertex numbers (A5, G1): ids to slots ``0 .. n - 1`` without gaps.

The second program gives every vertex of a partition the next place of that partition's arrays. As a table: ids
are dealt to ``partitions`` parts, numbered inside their part in ascending order, and the parts' counts, summed up in the
order of the parts, say where each part begins. Only the counts, one row a part, are brought together; there is no
global sort and no task that sees more than a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtables.functions.columns import modulo_partition
from graphtables.operators.graph import collapse_edges
from graphtables.operators.skew import split_join
from graphtables.session import checkpoint_dir

PARTS = ("modulo", "hash")


def _part(by: str, partitions: int) -> Column:
    if by not in PARTS:
        raise ValueError(f"by must be one of {PARTS}")
    return modulo_partition(F.col("id") if by == "modulo" else F.xxhash64("id"), partitions)


def part_offsets(ids: DataFrame, partitions: int, by: str = "modulo") -> DataFrame:
    """``part, first, n``: of each part that has ids its first slot and its number of ids; at most ``partitions`` rows."""
    counts = ids.groupBy(_part(by, partitions).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # the window sees the counts alone, at most ``partitions`` rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"), "n")


def vertex_slots(ids: DataFrame, partitions: int | None = None, by: str = "modulo") -> DataFrame:
    """``id, slot`` for the distinct not-null ``ids``: ordered by (part, id), from 0, without gaps.

    ``by="modulo"`` deals an id to part ``pmod(id, partitions)``, as hashing a number does; ``by="hash"`` by a 64-bit hash, for
    ids whose remainders are uneven."""
    n = int(partitions or ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = ids.where(F.col("id").isNotNull())
    numbered = ids.select("id", _part(by, n).alias("part")).withColumn(
        "k", F.row_number().over(Window.partitionBy("part").orderBy("id")))
    first = F.broadcast(part_offsets(ids, n, by).select("part", "first"))          # at most ``partitions`` rows
    return numbered.join(first, "part").select("id", (F.col("first") + F.col("k") - 1).alias("slot"))


def slot_edges(edges: DataFrame, slots: DataFrame) -> DataFrame:
    """The edges between slots: ``src_id, dst_id, weight`` with every id replaced by its slot.

    Repeated edges are merged first, and vertices with many edges are looked up by broadcast of their slots (see
    :func:`graphtables.operators.skew.split_join`, which reads its sides more than once, so they are checkpointed)."""
    checkpoint_dir(edges.sparkSession)
    slots, out = slots.checkpoint(), collapse_edges(edges).checkpoint()
    for end in ("src_id", "dst_id"):
        other = [c for c in ("src_id", "dst_id", "weight") if c != end]
        found = split_join(out, slots.select(F.col("id").alias("_id"), F.col("slot").alias("_slot")), [end], ["_id"])
        out = found.select(F.col("_slot").alias(end), *other).checkpoint()
    return out.select("src_id", "dst_id", "weight")
