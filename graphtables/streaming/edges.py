"""The edge-list source as a stream: new TSV files in a folder become edge rows.

Same grammar and operator as the batch source (``parse_edges`` works on a
streaming DataFrame unchanged); the sink appends parquet files and keeps its
progress in a folder beside the table, which a later application finds again:
it resumes where the last one stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphtables.sources.edges import parse_edges


def read_edge_stream(spark: SparkSession, folder: str, mode: str = "failfast",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming edge table over the text files that arrive in ``folder``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_edges(reader.load(folder), mode=mode)


def append_edges(stream: DataFrame, table_path: str, checkpoint: str | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Append a streaming edge table to parquet at ``table_path``.

    ``available_now`` processes what is there and stops (batch-like runs);
    otherwise the query keeps running. The progress folder defaults to
    ``<table_path>_progress``: it belongs to this table alone and, unlike a
    context's checkpoint folder, is the same in every application.
    """
    if checkpoint is None:
        checkpoint = table_path.rstrip("/") + "_progress"
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", table_path))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
