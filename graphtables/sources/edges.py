"""Edge-list ingest (S1-S6, S9) and the text sink.

Grammar of one line: a line starting with ``#`` in column 0 is a comment;
otherwise the line is split on TAB, fields 0 and 1 are signed 64-bit ids,
further fields are ignored and every edge weighs 1.0. Anything else is a
malformed line: ``mode="failfast"`` fails the job on it (like the original
programs), ``mode="permissive"`` drops it and reports it in a rejects table
(an extension).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtables._workers import ship_with_tasks
from graphtables.functions.columns import EDGE_WEIGHT, edge_partition_of, modulo_partition
from graphtables.session import shared_path

# Fixed value: an id field is an optional sign followed by decimal digits
# only (no spaces, no decimal point).
ID_PATTERN = r"^[+-]?[0-9]+$"
COMMENT_PREFIX = "#"
FIELD_SEPARATOR = "\t"
#: bytes of a block, what an edge partition of a text scan is
BLOCK_BYTES = 128 << 20
#: files whose first block numbers are broadcast; more are joined by shuffle
BROADCAST_FILES = 100_000
#: lines that one task sorts, about
SORT_ROWS = 500_000


#: a line whose ids have at most 18 digits, so that they fit whatever they are: one test for nearly all lines
PLAIN_LINE = r"^[+-]?[0-9]{1,18}\t[+-]?[0-9]{1,18}(\t|$)"


def _id_field(parts: Column, i: int) -> Column:
    """Field ``i`` as an id; null for overflow and junk."""
    raw = F.get(parts, i)
    return F.when(raw.rlike(ID_PATTERN), raw.try_cast("bigint"))


def _data_lines(lines: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    return lines.filter(v.isNull() | ~v.startswith(COMMENT_PREFIX))


def _well_formed(v: Column) -> Column:
    """Whether a data line is an edge. Fields are cut and cast here for lines with long ids only."""
    parts = F.split(v, FIELD_SEPARATOR, 3)      # limit 3: the ignored tail is not split further
    long_ids = _id_field(parts, 0).isNotNull() & _id_field(parts, 1).isNotNull()
    return F.when(v.rlike(PLAIN_LINE), F.lit(True)).otherwise(F.coalesce(long_ids, F.lit(False)))


def parse_edges(lines: DataFrame, mode: str = "failfast", column: str = "value") -> DataFrame:
    """Lines (a string column) -> ``src_id BIGINT, dst_id BIGINT, weight DOUBLE``, and
    ``edge_partition`` where ``lines`` has one.

    Works on any DataFrame with a line column, batch or streaming.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError(f"unknown mode {mode!r}")
    v = F.col(column)
    ok = _well_formed(v)
    if mode == "failfast":
        # in the filter, not in the id columns: those may be pruned (count(), sum(weight))
        err = F.raise_error(F.concat(F.lit("malformed edge line: "), F.coalesce(v, F.lit("<null>"))))
        ok = F.when(ok, F.lit(True)).otherwise(err.cast("boolean"))
    rest = F.substring_index(v, FIELD_SEPARATOR, 2)
    return _data_lines(lines, column).filter(ok).select(
        F.substring_index(v, FIELD_SEPARATOR, 1).try_cast("bigint").alias("src_id"),
        F.substring_index(rest, FIELD_SEPARATOR, -1).try_cast("bigint").alias("dst_id"),
        F.lit(EDGE_WEIGHT).alias("weight"), *(c for c in lines.columns if c == "edge_partition"))


def rejected_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that ``mode="permissive"`` drops (extension): ``line STRING``."""
    v = F.col(column)
    return _data_lines(lines, column).filter(~_well_formed(v)).select(v.alias("line"))


def read_edge_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The text scan, one row per line (``value STRING``)."""
    return spark.read.text(path)


def read_edges(spark: SparkSession, path: str | list[str], mode: str = "failfast") -> DataFrame:
    """Text edge file(s) -> edge table."""
    return parse_edges(read_edge_lines(spark, path), mode=mode)


def read_split_edges(spark: SparkSession, path: str | list[str], mode: str = "failfast") -> DataFrame:
    """S1-S6 as the original: the edge table with the index of its input split as
    ``edge_partition``, written to the shared folder and read back, so that the index of a row is
    fixed whatever the later plan is."""
    lines = with_split_partition(read_edge_lines(spark, path))
    stored = shared_path(spark, "split-edges")
    parse_edges(lines, mode=mode).write.parquet(stored)
    return spark.read.parquet(stored)


@contextmanager
def block_splits(spark: SparkSession, block_bytes: int = BLOCK_BYTES, tasks: int | None = None):
    """Within it, file scans are cut at multiples of ``block_bytes`` and nowhere else, whatever the number of cores: what a
    split is then depends on the files alone, as with the original's input splits. ``tasks``: how many read the
    splits, about, where there are more splits (default: one a split); a task then reads several, each by itself, and
    shuffles have as many partitions."""
    settings = {"spark.sql.files.maxPartitionBytes": str(block_bytes), "spark.sql.files.openCostInBytes": str(block_bytes),
                "spark.sql.files.minPartitionNum": "1"}
    if tasks is not None:
        settings |= {"spark.sql.files.maxPartitionNum": str(tasks), "spark.sql.shuffle.partitions": str(tasks)}
    saved = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_block(lines: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The lines of a text scan with ``file`` and ``block``: the number of the ``block_bytes`` bytes of the file that the line's
    split lies in. A line keeps both in every plan, retry and session whose splits do not cross blocks (sizes
    that divide ``block_bytes``, as under :func:`block_splits`); a split that does raises an error."""
    start, length = F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length")
    block = F.floor(start / block_bytes)
    crosses = F.floor((start + F.greatest(length, F.lit(1)) - 1) / block_bytes) != block
    number = F.when(crosses, F.raise_error(F.concat(
        F.lit("a split crosses blocks; use block_splits: "), F.col("_metadata.file_path"))).cast("int")).otherwise(block.cast("int"))
    return lines.select("*", F.col("_metadata.file_path").alias("file"), number.alias("block"))


def block_offsets(spark: SparkSession, path: str | list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, first``: the number of each file's first block when the blocks of all files are numbered in the order of
    their paths. One row a file that is not empty, from the listing alone (the files are not read); the running sum is over
    that list, which the driver has made."""
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"), F.ceil(F.col("_metadata.file_size") / block_bytes).cast("int").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("first"))


def read_block_edges(spark: SparkSession, path: str | list[str], mode: str = "failfast",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The edge table with the block of its line as ``edge_partition``. Nothing is stored: the number is read off
    the scan (:func:`with_block`), so it is the same whenever the plan runs."""
    lines = with_block(read_edge_lines(spark, path), block_bytes)
    first = block_offsets(spark, path, block_bytes)
    if first.count() <= BROADCAST_FILES:
        first = F.broadcast(first)
    numbered = lines.join(first, "file").select("value", (F.col("first") + F.col("block")).cast("int").alias("edge_partition"))
    return parse_edges(numbered, mode=mode)


def edges_from(df: DataFrame, src: str | Column = "src_id", dst: str | Column = "dst_id",
               weight: str | Column | None = None) -> DataFrame:
    """Edge table from any DataFrame. Rows with a null endpoint are dropped, since a
    null would otherwise become a vertex of its own."""
    s = F.col(src) if isinstance(src, str) else src
    d = F.col(dst) if isinstance(dst, str) else dst
    if weight is None:
        w = F.lit(EDGE_WEIGHT)
    else:
        w = F.col(weight) if isinstance(weight, str) else weight
    return (df.select(s.cast("bigint").alias("src_id"), d.cast("bigint").alias("dst_id"),
                      w.cast("double").alias("weight"))
            .filter(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()))


def edge_lines(edges: DataFrame, extra: str | Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Edge table -> text lines ``src<TAB>dst[<TAB>extra]`` (``value STRING``), after the columns ``keep``."""
    fields = [F.col("src_id").cast("string"), F.col("dst_id").cast("string")]
    if extra is not None:
        fields.append((F.col(extra) if isinstance(extra, str) else extra).cast("string"))
    return edges.select(*keep, F.concat_ws(FIELD_SEPARATOR, *fields).alias("value"))


def write_edges(edges: DataFrame, path: str, header: str | None = None,
                mode: str = "errorifexists") -> None:
    """Write an edge table as TAB-separated text, optionally with a ``#`` header line."""
    lines = edge_lines(edges)
    if header is not None:
        spark = edges.sparkSession
        head = spark.createDataFrame([(f"{COMMENT_PREFIX} {header}",)], "value string")
        lines = head.unionByName(lines)
    lines.write.mode(mode).text(path)


def write_sorted_edges(edges: DataFrame, path: str, part: Column, parts: int, rows: int) -> None:
    """Write an edge table of about ``rows`` rows as text, for each value of ``part`` (0 .. ``parts`` - 1) one file in a folder
    of that name, sorted by (source, destination).

    Tasks of about ``SORT_ROWS`` lines sort them and join what follows one another to runs; the task that writes a
    file has its runs to order, not its lines. Copies of an edge are dealt by their row, so they may lie in several tasks."""
    lines = edge_lines(edges.select(part.cast("int").alias("part"), "src_id", "dst_id",
                                    F.monotonically_increasing_id().alias("row")), keep=("part", "src_id", "dst_id", "row"))
    order = ["part", "src_id", "dst_id", "row"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for n in pc.value_counts(batch.column(0)).field("counts").to_pylist():      # sorted: a run of each part
                one = batch.slice(first, n)
                first += n
                joined = pc.binary_join(pa.LargeListArray.from_arrays([0, n], one.column(4)), "\n")
                yield pa.RecordBatch.from_arrays([*(one.column(k).slice(0, 1) for k in range(4)), joined.cast(pa.string())],
                                                 names=[*order, "value"])

    tasks = max(1, math.ceil(rows / SORT_ROWS))
    joined = lines.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(runs, lines.schema)
    (joined.repartitionById(parts, "part").sortWithinPartitions(*order).select("part", "value")
     .write.partitionBy("part").text(path))


def with_split_partition(lines: DataFrame) -> DataFrame:
    """S6 as the original: ``edge_partition`` = index of the input split.

    Not stable across cluster sizes or re-planning; :func:`read_split_edges` stores it
    before anything depends on it.
    """
    return lines.withColumn("edge_partition", F.spark_partition_id())


def with_edge_partition(edges: DataFrame, n: int, by: str = "edge") -> DataFrame:
    """S6, reproducible: ``edge_partition`` (INT) in ``0 .. n-1``.

    ``by="edge"``: a grid over source and destination (:func:`edge_partition_of`), spreads the
    edges of one source over about sqrt(n) partitions; ``by="src"``: ``pmod(src_id, n)``,
    keeps all edges of a source together (a hot source then makes one large
    partition).
    """
    if by == "edge":
        return edges.withColumn("edge_partition", edge_partition_of("src_id", "dst_id", n))
    if by == "src":
        return edges.withColumn("edge_partition", modulo_partition("src_id", n))
    raise ValueError("by must be 'edge' or 'src'")


ship_with_tasks(__name__)
