"""Layout operators (L1-L5, J5): placement and in-partition order.

These only change where rows live and in which order, never the rows
themselves. Give ``n`` explicitly: with ``n`` fixed, two tables placed by the
same key land co-partitioned and a later join between them needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from graphtables._workers import ship_with_tasks

ship_with_tasks(__name__)


def co_locate(df: DataFrame, keys: str | Sequence[str], n: int | None = None,
              sort: bool = True) -> DataFrame:
    """L1 + L2: hash-place rows by ``keys`` into ``n`` partitions, sorted inside each."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = df.repartition(n, *keys) if n else df.repartition(*keys)
    return out.sortWithinPartitions(*keys) if sort else out


def sort_edges(edges: DataFrame) -> DataFrame:
    """L3: ascending ``(src_id, dst_id)`` order inside each partition (no shuffle)."""
    return edges.sortWithinPartitions("src_id", "dst_id")


def place_edges(edges: DataFrame, n: int) -> DataFrame:
    """L4 + L3: edges placed by ``edge_partition``, sorted by ``(src_id, dst_id)`` inside."""
    return sort_edges(edges.repartition(n, "edge_partition"))


def place_vertices(vertex_table: DataFrame, n: int) -> DataFrame:
    """Vertices placed by ``id`` into ``n`` partitions, sorted by ``id``."""
    return co_locate(vertex_table, "id", n)


def placement(df: DataFrame, keys: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """What a layout promises, as one row: ``rows``, ``ordered`` (every partition is in ascending
    ``order``) and ``placed`` (each value of ``keys`` lives in one partition)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    where = df.select(*keys, F.spark_partition_id().alias("_partition")).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"))
    placed = where.select(F.coalesce(F.max("n") == 1, F.lit(True))).scalar()
    return partition_order(df, order).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                                          F.coalesce(F.bool_and("ordered"), F.lit(True)).alias("ordered")
                                          ).withColumn("placed", placed)


def partition_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per partition: row count and whether rows are in ascending ``keys`` order.

    ``partition INT, rows BIGINT, ordered BOOLEAN``; one row per non-empty
    partition. Checks the layout where it lives (an Arrow-batched pass per
    partition), nothing is brought to the driver.
    """
    keys = list(keys)
    # exact in pandas: an integer key with nulls would become float64, so each
    # integer key travels as (not-null flag, value or 0); nulls sort first, as in
    # Spark's ascending order
    cols, names = [], []
    for i, k in enumerate(keys):
        dtype = df.schema[k].dataType
        if isinstance(dtype, IntegralType):
            cols += [F.col(k).isNotNull().cast("int").alias(f"_n{i}"),
                     F.coalesce(F.col(k), F.lit(0).cast(dtype)).alias(f"_k{i}")]
            names += [f"_n{i}", f"_k{i}"]
        else:
            cols.append(F.col(k).alias(f"_k{i}"))
            names.append(f"_k{i}")
    tagged = df.select(F.spark_partition_id().alias("_partition"), *cols)
    keys = names

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, rows, ordered, last = None, 0, True, None
        for pdf in batches:
            if pdf.empty:
                continue
            part = int(pdf["_partition"].iloc[0])
            rows += len(pdf)
            block = pdf[keys]
            if last is not None:
                block = pd.concat([last, block], ignore_index=True)
            if not pd.MultiIndex.from_frame(block).is_monotonic_increasing:
                ordered = False
            last = pdf[keys].iloc[[-1]]
        if part is not None:
            yield pd.DataFrame({"partition": [part], "rows": [rows], "ordered": [ordered]})

    return tagged.mapInPandas(check, "partition int, rows long, ordered boolean")
