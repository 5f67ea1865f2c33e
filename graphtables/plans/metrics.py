"""Stage timing (S7, S8): materialise a table, record its rows and wall time.

A table that is kept in memory is counted, which fills the cache. A table that is written counts its
rows on the way (``observed``), so no second job reads it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

METRICS_SCHEMA = "stage string, rows bigint, ms double"


@dataclass
class StageTimer:
    """Collects ``(stage, rows, ms)`` for timed materialisations."""

    records: list[tuple[str, int, float]] = field(default_factory=list)

    def materialise(self, stage: str, df: DataFrame,
                    level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
        """Persist ``df`` and count it; the count is the only thing sent to the driver."""
        start = time.perf_counter()
        df = df.persist(level)
        rows = df.count()
        self.records.append((stage, int(rows), (time.perf_counter() - start) * 1000.0))
        return df

    def observed(self, stage: str, df: DataFrame, write: Callable[[DataFrame], None]) -> int:
        """S7 without a second pass: ``write`` gets ``df`` with its rows counted as they are written.

        The count sits right below the write, so a task that is tried again counts once."""
        start = time.perf_counter()
        seen = Observation()
        write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        rows = int(seen.get["rows"])
        self.records.append((stage, rows, (time.perf_counter() - start) * 1000.0))
        return rows

    def record(self, stage: str, rows: int, ms: float) -> None:
        self.records.append((stage, int(rows), float(ms)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The report as a table ``stage STRING, rows BIGINT, ms DOUBLE``."""
        return spark.createDataFrame(self.records, METRICS_SCHEMA)

    def report(self) -> str:
        return "\n".join(f"{s}: {ms:.1f} ms ({rows} rows)" for s, rows, ms in self.records)
