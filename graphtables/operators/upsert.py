"""Keyed merge into a stored table (K4): only what the new rows touch is rewritten.

The table lies in ``parts`` folders by a hash of the key. A merge reads the folders that the new keys fall into, merges
them (:func:`graphtables.operators.keyed.keyed_merge`) and replaces just those, by dynamic partition
overwrite; the files of all others stay as they are. The written rows are counted by the write.

A merge has a ``batch`` name, which is noted beside the table after its folders are replaced; a batch that is noted is
not merged again, so a caller may repeat one that may have gone through. The folders of one merge are replaced one
after another: with ``max``, ``min``, ``bit_or`` and ``last`` a merge that was cut off in between is simply repeated; with ``sum``
the parts it had replaced would count twice, so their names are noted as well, when the merge begins
(``pending``), with what they held before, and a repeated merge restores them first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.functions.columns import modulo_partition
from graphtables.operators.keyed import MERGES, keyed_merge
from graphtables.plans.metrics import StageTimer
from graphtables.session import children, discard, exists, read_text, write_text

PART = "part"


def _part(key: str, parts: int) -> Column:
    return modulo_partition(F.xxhash64(F.col(key)), parts)


def _replace(rows: DataFrame, path: str, timer: StageTimer, stage: str) -> int:
    return timer.observed(stage, rows, lambda df: df.write.partitionBy(PART).mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(path))


class StoredKeyed:
    """A table ``key, value`` (and ``seq`` with ``how="last"``) in the folder ``path``.

    ``parts`` and ``how`` are fixed by the first call for a folder."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key", value: str = "value", how: str = "sum",
                 seq: str | None = None, parts: int = 64):
        if how not in MERGES:
            raise ValueError(f"how must be one of {MERGES}")
        if how == "last" and seq is None:
            raise ValueError("how='last' needs a sequence column")
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.value, self.how, self.seq = key, value, how, seq if how == "last" else None
        self.timer = StageTimer()
        wanted = {"key": key, "value": value, "how": how, "seq": self.seq, "parts": int(parts)}
        at = f"{self.path}/about"
        if not exists(spark, at):
            write_text(spark, at, json.dumps(wanted))
        known = json.loads(read_text(spark, at))
        differing = [k for k in ("key", "value", "how", "seq") if known[k] != wanted[k]]
        if differing:
            raise ValueError(f"{self.path} was made with other {', '.join(differing)}")
        self.parts = known["parts"]

    @property
    def _data(self) -> str:
        return f"{self.path}/data"

    def _columns(self) -> list[str]:
        return [self.key, self.value] + ([self.seq] if self.seq else [])

    def _merged(self, old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            old = new.limit(0)
        if not self.seq:
            return keyed_merge(old, new, self.key, self.value, self.how)
        # the winning sequence number stays with the value, for the next merge
        both = old.unionByName(new)
        return both.groupBy(self.key).agg(F.max_by(self.value, self.seq).alias(self.value), F.max(self.seq).alias(self.seq))

    def batches(self) -> list[str]:
        """The batches that are merged."""
        return [name for name in children(self.spark, f"{self.path}/batches") if not name.startswith(".")]

    def table(self) -> DataFrame:
        """The table as it is, ``key, value``."""
        return self._stored().select(self.key, self.value)

    def _stored(self, parts: list[int] | None = None, path: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(path or self._data)
        return rows if parts is None else rows.where(F.col(PART).isin(parts))

    def merge(self, new: DataFrame, batch: str) -> list[int]:
        """Merge ``new`` and return the parts that were rewritten; none if ``batch`` was merged before."""
        spark = self.spark
        if batch in self.batches():
            return []
        self._restore()
        new = new.select(*self._columns())
        dealt = new.withColumn(PART, _part(self.key, self.parts))
        touched = sorted(r[PART] for r in dealt.select(PART).distinct().collect())       # at most ``parts`` numbers
        there = {int(name.split("=")[1]) for name in children(spark, self._data) if name.startswith(f"{PART}=")}
        old_parts = [p for p in touched if p in there]
        if old_parts and self.how == "sum":
            before = f"{self.path}/before"
            discard(spark, before)
            _replace(self._stored(old_parts), before, self.timer, "keep")
        write_text(spark, f"{self.path}/pending", json.dumps({"batch": batch, "parts": touched, "old": old_parts}))
        old = self._stored(old_parts).select(*self._columns()) if old_parts else None
        merged = self._merged(old, new).withColumn(PART, _part(self.key, self.parts))
        # one file a part: rows of a part meet in one task
        _replace(merged.repartition(PART), self._data, self.timer, f"merge {batch}")
        write_text(spark, f"{self.path}/batches/{batch}", json.dumps({"parts": touched}))
        discard(spark, f"{self.path}/pending")
        discard(spark, f"{self.path}/before")
        return touched

    def _restore(self) -> None:
        """Undo a merge that was cut off."""
        at = f"{self.path}/pending"
        if not exists(self.spark, at):
            return
        pending = json.loads(read_text(self.spark, at))
        if self.how == "sum" and pending["batch"] not in self.batches():
            for part in set(pending["parts"]) - set(pending["old"]):
                discard(self.spark, f"{self._data}/{PART}={part}")
            if pending["old"]:
                _replace(self._stored(path=f"{self.path}/before"), self._data, self.timer, "restore")
        discard(self.spark, at)
        discard(self.spark, f"{self.path}/before")
