"""The materialising round loop (R4 with L1-L6, J5): one key shuffle per round.

Layout, built once and kept:

* **edges** are first collapsed: repeated ``(src, dst)`` become one edge whose
  weight is the sum (exact, the recurrence is linear in the weight). A group
  of copies holding a large share of the rows turns into one row; partial
  aggregation combines copies before the shuffle.
* **hot sources**, those with more than ``T = ceil(|E| / P)`` out-edges, are
  split off (:mod:`graphtables.operators.skew`). Fewer than ``P`` sources
  can be hot (``2 P`` with a caller's lower threshold, which is raised to ``|E| / 2 P``), so their ids, and their rank rows in each round, are tables with
  a proven bound and are broadcast to the hot edges, which stay spread evenly
  by ``(src_id, dst_id)`` (unique after collapsing).
* **all other edges** are placed by ``src_id`` into ``P`` partitions, exactly
  like the rank table and the vertex table, so their joins need no shuffle.

One round: ranks (placed by ``id``) join the co-placed edges without a
shuffle; the rank rows of hot sources (< P rows) are broadcast to the hot
edges; contributions are partially summed per task, shuffled once by
destination and summed; the retaining variant joins the co-placed vertex
table. The result is placed by ``id`` again, ready for the next round.

Each round is persisted and the previous one released; every
``checkpoint_every`` rounds the ranks are checkpointed to the session's
``spark.checkpoint.dir`` so the lineage stays short and a lost executor costs
at most that many rounds of recomputation (every step is deterministic, so
recomputed partitions are identical). Session settings changed for the loop
(fixed shuffle partitions, adaptive execution off, cached placement kept) are
restored afterwards.
"""

from __future__ import annotations

import math
import time
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtables.functions.columns import (
    DAMPING,
    INITIAL_RANK,
    RESET,
    damp,
    edge_contribution,
    source_id_contribution,
)
from graphtables.operators.graph import collapse_edges, out_degrees, vertex_ids
from graphtables.operators.rank import check_variant, initial_ranks, summed_initial_ranks
from graphtables.operators.skew import SourceSplit, join_split
from graphtables.plans.inspect import shuffle_exchanges
from graphtables.plans.metrics import StageTimer
from graphtables.session import checkpoint_dir

_LOOP_CONF = {
    # keep the placement of persisted tables as planned, so the next round
    # can join them without a shuffle
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false",
    # The loop fixes P (co-placement), splits hot sources itself and relies on
    # partial aggregation, so adaptive coalescing / skew rewriting would only
    # undo the co-placement. Adaptive planning of the nested cached rounds also
    # grows with every round (measured: 0.3 s -> 4.9 s per round by round 10 on
    # 600k edges, flat 0.25 s without).
    "spark.sql.adaptive.enabled": "false",
}


@contextmanager
def _session_conf(spark, settings: dict[str, str]):
    saved = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class RankLoop:
    """Run the rank recurrence for many rounds, materialising each round.

    Parameters mirror :func:`graphtables.operators.rank.rank`; in addition
    ``partitions`` (P; default: the session's shuffle partitions, raised so a
    partition holds at most ``target_partition_rows`` edges),
    ``checkpoint_every`` (0 = never) and ``hot_threshold`` (out-edges above
    which a source is split; default ``ceil(|E| / P)``, at least ``|E| / 2 P``).
    """

    def __init__(self, edges: DataFrame, init: str = "unique", missing: str = "drop",
                 contribution: str = "rank", reset: float = RESET, damping: float = DAMPING,
                 initial: float = INITIAL_RANK, partitions: int | None = None,
                 checkpoint_every: int = 10, hot_threshold: int | None = None,
                 level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
                 target_partition_rows: int = 10_000_000):
        check_variant(init, missing, contribution)
        self.spark = edges.sparkSession
        self.edges = edges.select("src_id", "dst_id", "weight")
        self.init, self.missing, self.contribution = init, missing, contribution
        self.reset, self.damping, self.initial = reset, damping, initial
        self.requested_partitions = partitions
        self.partitions = int(partitions or self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.target_partition_rows = target_partition_rows
        self.checkpoint_every = checkpoint_every
        self.hot_threshold = hot_threshold
        self.level = level
        self.timer = StageTimer()
        self.round_exchanges: list[list[str]] = []
        self._kept: list[DataFrame] = []
        self.num_hot = 0

    # ---- layout -------------------------------------------------------------

    def _keep(self, stage: str, df: DataFrame) -> DataFrame:
        self._kept.append(df)       # before the job: released even if that fails
        return self.timer.materialise(stage, df, self.level)

    def _collapse(self) -> tuple[DataFrame, int]:
        """Collapsed edges, counted (planned with the session's own settings)."""
        start = time.perf_counter()
        collapsed = self.edges.transform(collapse_edges).persist(self.level)
        self._kept.append(collapsed)
        n_edges = collapsed.count()
        self.timer.record("collapse edges", n_edges, (time.perf_counter() - start) * 1000)
        if not self.requested_partitions:
            # spill-aware: no partition holds more than target_partition_rows edges
            self.partitions = max(self.partitions, math.ceil(n_edges / self.target_partition_rows))
        return collapsed, n_edges

    def _build(self, collapsed: DataFrame, n_edges: int) -> None:
        p = self.partitions
        start = time.perf_counter()
        if self.hot_threshold is None:
            threshold = max(1, math.ceil(n_edges / p))
        else:
            threshold = max(1, self.hot_threshold, math.ceil(n_edges / (2 * p)))
        # the out-degrees sum to n_edges: fewer than n_edges / threshold <= 2 P sources are hot
        hot_ids = (out_degrees(collapsed).filter(F.col("out_degree") > threshold)
                   .select("src_id"))
        hot_ids = hot_ids.persist(self.level)
        self._kept.append(hot_ids)
        self.num_hot = hot_ids.count()
        self.timer.record("find hot sources", self.num_hot, (time.perf_counter() - start) * 1000)
        ids = F.broadcast(hot_ids)
        normal = collapsed.join(ids, "src_id", "left_anti")
        normal = self._keep("build edges",
                            normal.repartition(p, "src_id").sortWithinPartitions("src_id"))
        if self.num_hot:
            # (src, dst) is unique after collapsing: hashing both spreads a hot source evenly
            hot = collapsed.join(ids, "src_id", "left_semi").repartition(p, "src_id", "dst_id")
            hot = self._keep("build edges (hot sources)", hot)
        else:
            hot = collapsed.limit(0)
        self.split = SourceSplit(normal, hot, hot_ids)

        if self.missing == "retain":
            verts = vertex_ids(collapsed).repartition(p, "id").sortWithinPartitions("id")
            self._vertices = self._keep("build vertex set", verts)
        else:
            self._vertices = None

        # Round-0 ranks. Every source below comes out of an aggregation by id with
        # exactly P partitions (the loop's settings), i.e. already placed for the
        # first join; the unique start reuses the vertex set instead of re-reading
        # the input.
        if self.contribution == "source_id":
            self._initial = None  # the literal second program never reads the previous ranks
        else:
            if self.init == "unique":
                ids = self._vertices if self._vertices is not None else vertex_ids(collapsed)
                init = ids.select("id", F.lit(float(self.initial)).alias("rank"))
            else:
                init = summed_initial_ranks(self.edges, self.init, self.initial)
            self._initial = self._keep("build vertices", init)
        collapsed.unpersist(blocking=False)

    # ---- one round ------------------------------------------------------------

    def _totals(self, ranks: DataFrame) -> DataFrame:
        split = self.split
        if self.contribution == "source_id":
            parts = [split.normal, split.hot] if self.num_hot else [split.normal]
            contribs = parts[0].select(F.col("dst_id").alias("id"),
                                       source_id_contribution().alias("contrib"))
            for extra in parts[1:]:
                contribs = contribs.unionByName(extra.select(
                    F.col("dst_id").alias("id"), source_id_contribution().alias("contrib")))
        elif self.num_hot:
            contribs = join_split(split, ranks, unique_ranks=True).select(
                F.col("dst_id").alias("id"), edge_contribution("weight", "rank").alias("contrib"))
        else:
            e = split.normal
            contribs = (e.join(ranks.hint("shuffle_hash"), e["src_id"] == ranks["id"])
                        .select(F.col("dst_id").alias("id"),
                                edge_contribution("weight", "rank").alias("contrib")))
        totals = contribs.groupBy("id").agg(F.sum("contrib").alias("total_contrib"))
        if self._vertices is not None:
            totals = (self._vertices.join(totals, "id", "left")
                      .select("id", F.coalesce(F.col("total_contrib"), F.lit(0.0))
                              .alias("total_contrib")))
        return totals

    def _step(self, ranks: DataFrame) -> DataFrame:
        return self._totals(ranks).select(
            "id", damp("total_contrib", self.reset, self.damping).alias("rank"))

    # ---- driver ---------------------------------------------------------------

    def run(self, rounds: int) -> DataFrame:
        """Materialise ``rounds`` rounds and return the final ``id, rank`` table (persisted)."""
        self.release_layout()
        self.timer = StageTimer()
        self.round_exchanges = []
        self.partitions = int(self.requested_partitions
                              or self.spark.conf.get("spark.sql.shuffle.partitions"))
        if rounds <= 0:
            return self.timer.materialise("build vertices",
                                          initial_ranks(self.edges, self.init, self.initial),
                                          self.level)
        if self.checkpoint_every and rounds > self.checkpoint_every:
            checkpoint_dir(self.spark)      # a missing folder fails here, not after finished rounds
        try:
            collapsed, n_edges = self._collapse()
            settings = {**_LOOP_CONF, "spark.sql.shuffle.partitions": str(self.partitions)}
            with _session_conf(self.spark, settings):
                self._build(collapsed, n_edges)
                ranks = self._rounds(rounds)
        except BaseException:
            self.release_layout()
            raise
        self._kept.remove(ranks)
        self.release_layout()
        return ranks

    def _rounds(self, rounds: int) -> DataFrame:
        ranks = self._initial
        for i in range(1, rounds + 1):
            new = self._keep(f"iteration {i}", self._step(ranks))
            try:
                self.round_exchanges.append(shuffle_exchanges(new))
            except Exception:  # diagnostics only (e.g. no JVM plan objects on Spark Connect)
                self.round_exchanges.append([])
            if self.checkpoint_every and i % self.checkpoint_every == 0 and i < rounds:
                kept, new = new, new.checkpoint(eager=True)
                self._release(kept)
                self._kept.append(new)
            if ranks is not None:
                self._release(ranks)
            ranks = new
        return ranks

    def _release(self, df: DataFrame) -> None:
        self._kept.remove(df)
        df.unpersist(blocking=False)

    def release_layout(self) -> None:
        """Drop all kept tables."""
        for df in self._kept:
            df.unpersist(blocking=False)
        self._kept = []

    def metrics(self) -> DataFrame:
        return self.timer.frame(self.spark)
