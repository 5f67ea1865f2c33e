"""The second program's loop with its own stages and placements.

* **edges**: collapsed per partition, edge partition ``p`` in Spark partition ``p`` (L4; modulo their number), sorted by (source,
  destination) inside (L3);
* **routing tables**: packed messages built inside the edge partitions and shuffled once, by vertex, where they stay (G3);
* **vertices**: the routing tables' ids, placed as those are, in ``vertex_partitions`` partitions (G1, L5).

A round is J2 -> J3 -> A2 -> A3 -> J4 -> P5 with two exchanges: the ranks that edge partitions need as a source, by
edge partition (they meet the routing tables where both lie), and the partial sums, one row per
(edge partition, destination), by vertex. With the two-dimensional edge partition a vertex is a source in about sqrt(n)
partitions; with the blocks of a text scan it follows the blocks. ``contribution="source_id"`` is the program as written:
its rounds ship the ranks as well, and their times include it.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtables.functions.columns import DAMPING, INITIAL_RANK, RESET
from graphtables.operators.layout import sort_edges
from graphtables.operators.rank import apply_damping, contrib_final, retain_all
from graphtables.operators.routing import edge_partition_count, placed_partials, routing_from_messages, ship_along
from graphtables.plans.inspect import shuffle_exchanges
from graphtables.plans.loop import _LOOP_CONF, _session_conf
from graphtables.plans.metrics import StageTimer
from graphtables.session import checkpoint_dir

#: collapsed edges of a Spark partition, on average, from which on more edge partitions than ``vertex_partitions`` share one
PLACED_ROWS = 500_000


class RoutedLoop:
    """``edges``: ``src_id, dst_id, weight, edge_partition``; every vertex is kept.

    ``vertex_partitions`` (default: the session's shuffle partitions; the original has 200) and
    ``edge_partitions`` (default: the greatest in use and one) are the numbers of placed partitions. By default, of more edge
    partitions than ``vertex_partitions`` and than the edges fill, several lie in a Spark partition, each whole
    (``p`` in ``p`` modulo their number): small blocks need no task each."""

    def __init__(self, edges: DataFrame, contribution: str = "rank", reset: float = RESET, damping: float = DAMPING,
                 initial: float = INITIAL_RANK, checkpoint_every: int = 10,
                 level: StorageLevel = StorageLevel.MEMORY_AND_DISK, vertex_partitions: int | None = None,
                 edge_partitions: int | None = None):
        if contribution not in ("rank", "source_id"):
            raise ValueError("contribution must be 'rank' or 'source_id'")
        self.spark = edges.sparkSession
        self.edges = edges.select("src_id", "dst_id", "weight", "edge_partition")
        self.contribution, self.reset, self.damping, self.initial = contribution, reset, damping, initial
        self.checkpoint_every, self.level = checkpoint_every, level
        self.vertex_partitions, self.edge_partitions = vertex_partitions, edge_partitions
        self.timer = StageTimer()
        self.round_exchanges: list[list[str]] = []
        self._kept: list[DataFrame] = []

    def _keep(self, stage: str, df: DataFrame) -> DataFrame:
        self._kept.append(df)
        return self.timer.materialise(stage, df, self.level)

    def run(self, rounds: int) -> DataFrame:
        """Materialise ``rounds`` rounds and return the final ``id, rank`` table (persisted)."""
        self.release()
        self.timer, self.round_exchanges = StageTimer(), []
        if self.checkpoint_every and rounds > self.checkpoint_every:
            checkpoint_dir(self.spark)
        # repeated edges are combined before they are placed, so a group of copies is one row of its partition
        collapsed = self.edges.groupBy("edge_partition", "src_id", "dst_id").agg(F.sum("weight").alias("weight")).persist(self.level)
        self._kept.append(collapsed)
        try:
            n_vertex = int(self.vertex_partitions or self.spark.conf.get("spark.sql.shuffle.partitions"))
            n_edge = max(1, self.edge_partitions or edge_partition_count(collapsed).first()["n"])
            if not self.edge_partitions and n_edge > n_vertex:
                n_edge = min(n_edge, max(n_vertex, math.ceil(collapsed.count() / PLACED_ROWS)))
            settings = {**_LOOP_CONF, "spark.sql.shuffle.partitions": str(n_vertex),
                        # edges and shipped ranks meet on (partition, source), both placed by partition alone
                        "spark.sql.requireAllClusterKeysForCoPartition": "false"}
            with _session_conf(self.spark, settings):
                edges = self._keep("build edges", sort_edges(collapsed.repartitionById(n_edge, "edge_partition")))
                self._release(collapsed)
                ranks = self._rounds(edges, rounds, n_edge, n_vertex)
        except BaseException:
            self.release()
            raise
        self._kept.remove(ranks)
        self.release()
        return ranks

    def _rounds(self, edges: DataFrame, rounds: int, n_edge: int, n_vertex: int) -> DataFrame:
        routing = self._keep("build routing tables", routing_from_messages(edges, n_vertex))
        ids = routing.groupBy(F.col("vertex_id").alias("id")).agg(F.lit(float(self.initial)).alias("rank"))
        vertex_table = ranks = self._keep("build vertices", ids)
        for i in range(1, rounds + 1):
            shipped = ship_along(routing, ranks, n_edge)
            totals = contrib_final(placed_partials(edges, shipped, self.contribution))
            new = self._keep(f"iteration {i}", apply_damping(retain_all(vertex_table, totals), self.reset, self.damping))
            try:
                self.round_exchanges.append(shuffle_exchanges(new))
            except Exception:  # diagnostics only (e.g. no JVM plan objects on Spark Connect)
                self.round_exchanges.append([])
            if self.checkpoint_every and i % self.checkpoint_every == 0 and i < rounds:
                kept, new = new, new.checkpoint(eager=True)
                self._release(kept)
                self._kept.append(new)
            if ranks is not vertex_table:
                self._release(ranks)
            ranks = new
        return ranks

    def _release(self, df: DataFrame) -> None:
        self._kept.remove(df)
        df.unpersist(blocking=False)

    def release(self) -> None:
        """Drop all kept tables."""
        for df in self._kept:
            df.unpersist(blocking=False)
        self._kept = []

    def metrics(self) -> DataFrame:
        return self.timer.frame(self.spark)
