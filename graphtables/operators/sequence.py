"""Successor pairs in a global order, without one task per group.

``lead(value) OVER (PARTITION BY g ORDER BY o)`` sends every row of a group
to one task; with few groups (an event type, say) that is one task for a
large share of the table. Here the rows are range-partitioned on
``(g, o...)`` instead, so each task gets an ordered slice of roughly equal
size whatever the group sizes:

1. ``repartitionByRange(n, g, o...)`` (one shuffle) + sort inside partitions;
2. inside each slice, consecutive rows of the same group form a pair
   (an Arrow-batched pass, state carried across batches); the pass also gives the slice's
   first and last row. Its output is checkpointed to the shared folder, so the pass runs once
   however often the pairs are read, and one set of slices serves both kinds of rows;
3. the last row of each slice pairs with the first row of the next non-empty
   slice when both have the same group. That table has one row a slice, whatever the data.

``o`` must give a total order inside a group (add a unique tiebreaker).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from graphtables._workers import ship_with_tasks
from graphtables.session import checkpoint_dir

ship_with_tasks(__name__)


def _same_as_next(g: pd.Series) -> np.ndarray:
    """``out[i]``: row ``i`` and row ``i + 1`` have the same group (null equals null).

    The groups are factorised to integer codes (null gets a code of its own),
    so the comparison is one vectorised pass, whatever the group type.
    """
    codes, _ = pd.factorize(g, use_na_sentinel=False)
    return codes[:-1] == codes[1:]


def successor_pairs(df: DataFrame, group: str, order: Sequence[str], value: str,
                    partitions: int | None = None) -> DataFrame:
    """``value``, and the ``value`` of the next row of the same ``group`` in ``order``.

    Returns ``value, next_value`` (both of ``value``'s type), one row per row
    that has a successor, like ``lead`` without its trailing nulls.
    """
    spark = df.sparkSession
    n = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    order = list(order)
    keys = [group] + order
    vtype = df.schema[value].dataType
    value_type = vtype.simpleString()
    checkpoint_dir(spark)
    ranged = (df.select(*dict.fromkeys([*keys, value])).repartitionByRange(n, *keys)
              .sortWithinPartitions(*keys))

    # Exact values in pandas: an integer column with nulls would become float64
    # (ids above 2**53 would change), so integers travel null-free with a null
    # flag; groups are compared on their exact string form.
    if isinstance(vtype, IntegralType):
        v_cols = [F.coalesce(F.col(value), F.lit(0).cast(vtype)).alias("_v"),
                  F.col(value).isNull().alias("_vn")]
    else:
        v_cols = [F.col(value).alias("_v"), F.lit(False).alias("_vn")]
    slim = ranged.select(F.col(group).cast("string").alias("_g"), *v_cols)
    columns = ["value", "value_null", "next_value", "next_null", "slice", "first_group", "last_group"]

    def local_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = prev = None  # first and last row seen in this slice
        for pdf in batches:
            if pdf.empty:
                continue
            block = pdf if prev is None else pd.concat([prev, pdf], ignore_index=True)
            same = _same_as_next(block["_g"])
            v, vn = block["_v"].to_numpy(), block["_vn"].to_numpy()
            out = pd.DataFrame({"value": v[:-1][same], "value_null": vn[:-1][same],
                                "next_value": v[1:][same], "next_null": vn[1:][same],
                                "slice": -1, "first_group": None, "last_group": None})
            first = pdf.iloc[0] if first is None else first
            prev = pdf.iloc[[-1]].reset_index(drop=True)
            if len(out):
                yield out[columns]
        if prev is not None:
            # the slice's bounds: its last row as the value, its first row as the next one
            last = prev.iloc[0]
            yield pd.DataFrame([[last["_v"], last["_vn"], first["_v"], first["_vn"], TaskContext.get().partitionId(),
                                 first["_g"], last["_g"]]], columns=columns)

    schema = (f"value {value_type}, value_null boolean, next_value {value_type}, next_null boolean, "
              "slice int, first_group string, last_group string")
    # where the pass does not run again for each reader: the checkpoint's files
    passed = slim.mapInPandas(local_pairs, schema).checkpoint()

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select(F.when(~F.col("value_null"), F.col("value")).alias("value"),
                           F.when(~F.col("next_null"), F.col("next_value")).alias("next_value"))

    # at most n rows: one window over all slices is bounded by the partition count
    after = Window.orderBy("slice")
    bounds = passed.filter("slice >= 0").select(
        "value", "value_null", "last_group", F.lead("first_group").over(after).alias("next_group"),
        F.lead("next_value").over(after).alias("next_value"), F.lead("next_null").over(after).alias("next_null"))
    stitched = bounds.filter(F.col("next_null").isNotNull() & F.col("last_group").eqNullSafe(F.col("next_group")))
    return pairs(passed.filter("slice < 0")).unionByName(pairs(stitched))
