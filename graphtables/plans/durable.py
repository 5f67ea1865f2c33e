"""A round loop that a new application continues.

All of the loop's state lies in one folder of the shared store, as tables with their placement
(:mod:`graphtables.sources.stored`):

* ``manifest``: the variant, the constants, the number of buckets, and the fingerprint of the edges;
* ``edges`` by source, ``hot_edges`` by source and destination, ``hot_ids``, ``vertices`` by id;
* ``ranks/N``: the ranks after round N by id; ``rounds/N``: that round N is finished, with its rows and time.

A round joins the stored ranks with the stored edges without an exchange, shuffles its sums once by
destination, and writes the result placed by id; rows are counted by the write. ``rounds/N`` is written after ``ranks/N``,
so whatever is lost on the way, the next application finds the last finished round and continues after it: the edges
are neither read again nor collapsed or placed again. Of the ranks, the last ``keep_rounds`` rounds stay.

Given edges must be those of the state (row count, and sum of a 64-bit hash of every row; weights in any order),
and the parameters its own; otherwise nothing is touched and an error says what differs.
"""

from __future__ import annotations

import json
import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.functions.columns import DAMPING, INITIAL_RANK, RESET
from graphtables.operators.graph import collapse_edges, out_degrees, vertex_ids
from graphtables.operators.rank import initial_ranks, summed_initial_ranks
from graphtables.operators.skew import SourceSplit
from graphtables.plans.loop import _LOOP_CONF, RankLoop, _session_conf
from graphtables.plans.metrics import StageTimer
from graphtables.session import children, discard, exists, read_text, write_text
from graphtables.sources.stored import is_stored, open_stored, store


def edge_fingerprint(edges: DataFrame) -> dict:
    """``rows`` and ``hash`` of an edge table, whatever its order and splits: one pass, no shuffle of rows."""
    row = edges.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("src_id", "dst_id", "weight").cast(
        "decimal(38,0)")).alias("hash")).first()
    return {"rows": row["rows"], "hash": str(row["hash"] or 0)}


class DurableRankLoop(RankLoop):
    """:class:`RankLoop` with its rounds in the folder ``state``.

    ``edges`` starts the state, or is checked against it; without edges an existing state is continued.
    ``run(rounds)`` does the rounds that are missing; a finished round that is still kept is returned as it is."""

    def __init__(self, spark: SparkSession, state: str, edges: DataFrame | None = None, init: str = "unique",
                 missing: str = "drop", contribution: str = "rank", reset: float = RESET, damping: float = DAMPING,
                 initial: float = INITIAL_RANK, partitions: int | None = None, hot_threshold: int | None = None,
                 target_partition_rows: int = 10_000_000, keep_rounds: int = 2):
        self.state = state.rstrip("/")
        self.keep_rounds = max(1, keep_rounds)
        known = self._manifest(spark)
        if known is None and edges is None:
            raise FileNotFoundError(f"no loop state in {state}")
        if edges is None:               # the parameters are the state's
            p = known["parameters"]
            init, missing, contribution = p["init"], p["missing"], p["contribution"]
            reset, damping, initial = p["reset"], p["damping"], p["initial"]
        table = edges if edges is not None else spark.createDataFrame([], "src_id long, dst_id long, weight double")
        super().__init__(table, init, missing, contribution, reset, damping, initial, partitions, 0, hot_threshold,
                         target_partition_rows=target_partition_rows)
        self.started_at = 0             # the round that this application continued from
        self._given = edges is not None
        if known is not None and self._given:
            self._check(known)

    # ---- state ----------------------------------------------------------------

    def _at(self, *names: str) -> str:
        return "/".join((self.state, *names))

    def _manifest(self, spark: SparkSession) -> dict | None:
        path = self._at("manifest")
        return json.loads(read_text(spark, path)) if exists(spark, path) else None

    def _parameters(self) -> dict:
        return {"init": self.init, "missing": self.missing, "contribution": self.contribution, "reset": self.reset,
                "damping": self.damping, "initial": self.initial}

    def _check(self, known: dict) -> None:
        found = {**self._parameters(), **edge_fingerprint(self.edges)}
        stored = {**known["parameters"], **known["edges"]}
        differing = [f"{k}: {stored[k]!r} in the state, {found[k]!r} now" for k in stored if stored[k] != found[k]]
        if differing:
            raise ValueError(f"{self.state} is the state of another run ({'; '.join(differing)})")

    def finished_rounds(self) -> list[int]:
        """The rounds that are finished, in order."""
        return sorted(int(name) for name in children(self.spark, self._at("rounds")) if name.isdigit())

    def rounds(self) -> DataFrame:
        """``round, rows, ms`` of the finished rounds, whichever application did them."""
        records = [json.loads(read_text(self.spark, self._at("rounds", str(i)))) for i in self.finished_rounds()]
        return self.spark.createDataFrame([(r["round"], r["rows"], r["ms"]) for r in records], "round int, rows bigint, ms double")

    # ---- layout ---------------------------------------------------------------

    def _stored(self, name: str, build, keys: list[str], order: list[str] | None, stage: str, placed: bool = False) -> DataFrame:
        """A table of the layout, written unless an earlier application has."""
        if not is_stored(self.spark, self._at(name)):
            store(build(), self._at(name), keys, self.partitions, order, placed, self.timer, stage)
        return open_stored(self.spark, self._at(name))

    def _lay_out(self) -> None:
        """Everything up to round 0; the manifest is its last file."""
        spark = self.spark
        fingerprint = edge_fingerprint(self.edges)
        path = self._at("collapsed")
        discard(spark, path)
        n_edges = self.timer.observed("collapse edges", collapse_edges(self.edges), lambda df: df.write.parquet(path))
        collapsed = spark.read.parquet(path)
        if not self.requested_partitions:
            self.partitions = max(self.partitions, math.ceil(n_edges / self.target_partition_rows))
        with _session_conf(spark, self._conf()):
            for name in ("edges", "hot_edges", "hot_ids", "vertices", "ranks"):
                discard(spark, self._at(name))
            p = self.partitions
            threshold = max(1, math.ceil(n_edges / p) if self.hot_threshold is None else max(
                self.hot_threshold, math.ceil(n_edges / (2 * p))))
            hot = out_degrees(collapsed).filter(F.col("out_degree") > threshold).select("src_id")
            num_hot = self.timer.observed("find hot sources", hot, lambda df: df.write.parquet(self._at("hot_ids")))
            ids = F.broadcast(spark.read.schema("src_id long").parquet(self._at("hot_ids")))      # fewer than 2 P
            self._stored("edges", lambda: collapsed.join(ids, "src_id", "left_anti"), ["src_id"], ["src_id", "dst_id"], "build edges")
            if num_hot:
                self._stored("hot_edges", lambda: collapsed.join(ids, "src_id", "left_semi"), ["src_id", "dst_id"], None,
                             "build edges (hot sources)")
            if self.missing == "retain":
                self._stored("vertices", lambda: vertex_ids(collapsed), ["id"], None, "build vertex set", placed=True)
            first = (summed_initial_ranks(self.edges, self.init, self.initial) if self.init == "incidence" else
                     vertex_ids(collapsed).select("id", F.lit(float(self.initial)).alias("rank")))
            self._stored("ranks/0", lambda: first, ["id"], None, "build vertices", placed=True)
        write_text(spark, self._at("manifest"), json.dumps(
            {"parameters": self._parameters(), "edges": fingerprint, "partitions": self.partitions, "hot_sources": num_hot}))
        discard(spark, path)

    def _conf(self) -> dict[str, str]:
        return {**_LOOP_CONF, "spark.sql.shuffle.partitions": str(self.partitions)}

    # ---- rounds ---------------------------------------------------------------

    def run(self, rounds: int) -> DataFrame:
        """The ranks after ``rounds`` rounds, ``id, rank``, read from the state."""
        spark = self.spark
        self.timer, self.round_exchanges = StageTimer(), []
        if self._manifest(spark) is None:
            self._lay_out()
        known = self._manifest(spark)
        self.partitions, self.num_hot = known["partitions"], known["hot_sources"]
        if rounds <= 0:
            if self.init == "incidence":
                if not self._given:
                    raise ValueError("the incidence rows of round 0 need the edges")
                return initial_ranks(self.edges, self.init, self.initial)
            rounds = 0
        finished = self.finished_rounds()
        done = max((r for r in [0, *finished] if r <= rounds and is_stored(spark, self._at("ranks", str(r)))), default=None)
        if done is None:
            raise FileNotFoundError(f"round {rounds} and those before it are no longer kept in {self.state}")
        self.started_at = done
        hot_ids = spark.read.schema("src_id long").parquet(self._at("hot_ids"))
        normal = open_stored(spark, self._at("edges"))
        hot = open_stored(spark, self._at("hot_edges")) if self.num_hot else normal.limit(0)
        self.split = SourceSplit(normal, hot, hot_ids)
        self._vertices = open_stored(spark, self._at("vertices")) if self.missing == "retain" else None
        with _session_conf(spark, self._conf()):
            for i in range(done + 1, rounds + 1):
                self._round(i)
        return open_stored(spark, self._at("ranks", str(rounds))).select("id", "rank")

    def _round(self, i: int) -> None:
        start = time.perf_counter()
        step = self._step(open_stored(self.spark, self._at("ranks", str(i - 1))))
        path = self._at("ranks", str(i))
        if is_stored(self.spark, path):         # whole, but its application ended before it said so
            discard(self.spark, path)
        rows = store(step, path, ["id"], self.partitions, None, True, self.timer, f"iteration {i}")
        write_text(self.spark, self._at("rounds", str(i)), json.dumps(
            {"round": i, "rows": rows, "ms": (time.perf_counter() - start) * 1000.0}))
        for name in children(self.spark, self._at("ranks")):
            if int(name) <= i - self.keep_rounds:
                discard(self.spark, self._at("ranks", name))

    def discard_state(self) -> None:
        """Delete the state."""
        discard(self.spark, self.state)
