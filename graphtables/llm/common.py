"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables._workers import ship_with_tasks
from graphtables.session import discard, shared_path


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text of an Arrow string column, None for null."""
    for v in pc.cast(column, pa.large_binary()):
        yield v.as_py()


#: the lists of those who delete what is written meanwhile
_OPEN: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that :func:`written` wrote within it. Results that read them must be written
    or collected before."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        for path in paths:
            discard(spark, path)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that
    every executor can reach, computed once however often it is used."""
    path = shared_path(df.sparkSession, name)
    for paths in _OPEN:
        paths.append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pack(numbers: np.ndarray) -> bytes:
    """Integers as compressed bytes: a plane of each of their eight bytes, then zstd."""
    planes = np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_words(words: list[str]) -> bytes:
    """Words without line breaks as compressed bytes."""
    return zstandard.ZstdCompressor(level=1).compress("\n".join(words).encode())


def unpack_words(data: bytes) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(data).decode()
    return text.split("\n") if text else []


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep in lambdas ``body``
    uses it (a projected column would be copied into each lambda that names it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows (counted), else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


ship_with_tasks(__name__)
