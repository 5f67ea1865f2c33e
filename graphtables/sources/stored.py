"""Tables whose placement outlives the session that wrote them.

A stored table is a folder: ``data`` holds parquet files, one a bucket (rows hashed by the keys,
sorted inside), and ``layout`` says what was written: columns, keys, order, buckets, rows. ``layout`` is
written last and whole, so a table without it is no table; a later writer clears what a lost one left.

:func:`open_stored` registers the files with their buckets again, in any session that reaches the folder: no
metastore has to remember them. Two tables stored by their join keys with one number of buckets join
without an exchange, however many sessions lie between (:mod:`tests.test_stored`).

One bucket is one task's work. Tables with hot keys are stored by keys that spread them, as
:class:`graphtables.plans.durable.DurableRankLoop` does with the edges of hot sources.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.operators.graph import collapse_edges, vertices
from graphtables.plans.metrics import StageTimer
from graphtables.session import discard, exists, read_text, write_text


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether a whole table is at ``path``."""
    return exists(spark, f"{path}/layout")


def stored_layout(spark: SparkSession, path: str) -> dict:
    """What :func:`store` wrote at ``path``: ``columns, keys, order, buckets, rows``."""
    return json.loads(read_text(spark, f"{path}/layout"))


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def store(df: DataFrame, path: str, keys: Sequence[str], buckets: int, order: Sequence[str] | None = None,
          placed: bool = False, timer: StageTimer | None = None, stage: str = "store") -> int:
    """Write ``df`` in ``buckets`` buckets of ``keys``, sorted by ``order`` (the keys) inside; returns its rows, counted by the
    write itself. ``placed``: the rows already lie by the hash of ``keys`` in ``buckets`` partitions."""
    spark = df.sparkSession
    if is_stored(spark, path):
        raise FileExistsError(path)
    discard(spark, path)                # what a lost writer left
    keys, order = list(keys), list(order or keys)
    name = f"stored_{uuid.uuid4().hex}"

    def write(rows: DataFrame) -> None:
        (rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*order)
         .option("path", f"{path}/data").saveAsTable(name))
        spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external

    out = df if placed else df.repartition(buckets, *keys)
    rows = (timer or StageTimer()).observed(stage, out, write)
    write_text(spark, f"{path}/layout", json.dumps(
        {"columns": _columns(df), "keys": keys, "order": order, "buckets": buckets, "rows": rows}))
    return rows


def open_stored(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` with its placement, in this session."""
    at = stored_layout(spark, path)
    name = f"stored_{uuid.uuid4().hex}"

    def listed(names: list[str]) -> str:
        return ", ".join(f"`{n}`" for n in names)

    location = f"{path}/data".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({at['columns']}) USING parquet CLUSTERED BY ({listed(at['keys'])}) "
              f"SORTED BY ({listed(at['order'])}) INTO {at['buckets']} BUCKETS LOCATION '{location}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def store_graph(edges: DataFrame, path: str, buckets: int | None = None) -> None:
    """The edges (repeated ones merged, weights summed) by source and the vertices by id, both with ``buckets`` buckets."""
    spark = edges.sparkSession
    n = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
    parts: dict[str, Callable[[], None]] = {
        "edges": lambda: store(collapse_edges(edges), f"{path}/edges", ["src_id"], n, ["src_id", "dst_id"]),
        "vertices": lambda: store(vertices(open_stored(spark, f"{path}/edges")), f"{path}/vertices", ["id"], n)}
    for name, write in parts.items():
        if not is_stored(spark, f"{path}/{name}"):
            write()


def open_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of :func:`store_graph`."""
    return open_stored(spark, f"{path}/edges"), open_stored(spark, f"{path}/vertices")


def bucket_placement(spark: SparkSession, path: str) -> DataFrame:
    """What the files of a stored table hold, as one row: ``rows``, ``buckets`` (files with rows), and ``placed`` (each value of
    the keys lies in one file)."""
    at = stored_layout(spark, path)
    rows = open_stored(spark, path).select(*at["keys"], F.input_file_name().alias("file"))
    found = rows.groupBy(*at["keys"], "file").agg(F.count(F.lit(1)).alias("n"))
    by_key = found.groupBy(*at["keys"]).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"), F.min("file").alias("file"))
    return by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_distinct("file").alias("buckets"),
                      F.coalesce(F.max("files") == 1, F.lit(True)).alias("placed"))
