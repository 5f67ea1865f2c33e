"""Rank recurrence: one step and the fixed-count composition.

``rank(v) = reset + damping * sum over edges (u, v) of contribution(u, v)``

Variants are explicit parameters, never blended:

* ``init="unique"``: each vertex starts once with rank 1.0 (G1).
* ``init="incidence"``: the first program's literal start, one row of rank
  1.0 per distinct incident edge (G2). The join in round 1 fans those rows out;
  since the sum is linear, the rows of one id are pre-summed to a single row
  of rank ``n`` first, so the join never multiplies rows.
* ``missing="drop"``: inner join + group by, a vertex without incoming
  contribution disappears (R1, R5, R6).
* ``missing="retain"``: every vertex is kept, missing sum = 0 (J4, R2, R8).
* ``contribution="rank"``: ``weight * rank(src)``;
  ``contribution="source_id"``: the second program's literal
  ``src_id * weight``, independent of the previous ranks (R3, R7).

Everything here is lazy; the result of ``rank`` is one plan whose rounds each shuffle
the partial sums by vertex and the finished ranks by ``(vertex, salt)`` (hot sources
are salted; see :mod:`graphtables.operators.skew`). For many rounds use
:class:`graphtables.plans.loop.RankLoop`, which materialises and checkpoints
the rounds, with one key shuffle per round.
"""

from __future__ import annotations

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
from graphtables.operators.graph import (
    incidence_counts,
    incidence_vertices,
    vertex_ids,
    vertices,
)
from graphtables.operators.skew import (
    SourceSplit,
    join_split,
    salt_graph,
    salted_totals,
    split_sources,
    summed_ranks,
)

INITS = ("unique", "incidence")
MISSING = ("drop", "retain")
CONTRIBUTIONS = ("rank", "source_id")


def join_ranks(edges: DataFrame, ranks: DataFrame, split: SourceSplit | None = None,
               unique_ranks: bool = False) -> DataFrame:
    """Inner equi-join ``src_id = id``; an edge fans out if ``id`` repeats.

    Skew-safe: sources with more than ``|E| / P`` out-edges are split off and
    meet their rank rows through a broadcast join (see
    :mod:`graphtables.operators.skew`); all other edges use a shuffled hash
    join built on the rank side, so the edge table (the big side) is never
    broadcast. This is the single-step form; :func:`rank` chains rounds through
    the salted layout instead, which references the previous ranks once per
    round. Only with ``unique_ranks`` (ranks out of an aggregation by id) the hot
    side is broadcast; a rank multiset has no bound.
    """
    split = split if split is not None else split_sources(edges)
    return join_split(split, ranks, unique_ranks)


def contributions(edges: DataFrame, ranks: DataFrame, split: SourceSplit | None = None,
                  unique_ranks: bool = False) -> DataFrame:
    """J1 + P1 + P3: one row per (edge, matching rank row): ``id (= dst_id), contrib``."""
    return join_ranks(edges, ranks, split, unique_ranks).select(
        F.col("dst_id").alias("id"), edge_contribution("weight", "rank").alias("contrib"))


def source_id_contributions(edges: DataFrame) -> DataFrame:
    """``id (= dst_id), contrib = src_id * weight``."""
    return edges.select(F.col("dst_id").alias("id"),
                        source_id_contribution("src_id", "weight").alias("contrib"))


def contrib_sum(contribs: DataFrame) -> DataFrame:
    """A1: ``groupBy(id).sum(contrib)`` -> ``id, total_contrib``."""
    return contribs.groupBy("id").agg(F.sum("contrib").alias("total_contrib"))


def contrib_partial(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """A2: partial sums per (edge_partition, destination): ``edge_partition, id, partial``.

    ``edges`` must carry ``edge_partition``.
    """
    j = join_ranks(edges, summed_ranks(ranks), unique_ranks=True)
    return (j.groupBy("edge_partition", F.col("dst_id").alias("id"))
            .agg(F.sum(edge_contribution("weight", "rank")).alias("partial")))


def contrib_final(partials: DataFrame) -> DataFrame:
    """A3: sum the partials of each vertex: ``id, total_contrib``."""
    return partials.groupBy("id").agg(F.sum("partial").alias("total_contrib"))


def apply_damping(totals: DataFrame, reset: float = RESET, damping: float = DAMPING) -> DataFrame:
    """P5: ``id, total_contrib`` -> ``id, rank``."""
    return totals.select("id", damp("total_contrib", reset, damping).alias("rank"))


def retain_all(vertex_table: DataFrame, totals: DataFrame) -> DataFrame:
    """Every vertex kept, a missing sum becomes 0.0: ``id, total_contrib``."""
    v = vertex_table.select("id")
    return (v.join(totals, "id", "left")
            .select("id", F.coalesce(F.col("total_contrib"), F.lit(0.0)).alias("total_contrib")))


def rank_step_drop(edges: DataFrame, ranks: DataFrame, reset: float = RESET,
                   damping: float = DAMPING, split: SourceSplit | None = None) -> DataFrame:
    """J1 -> P1/P3 -> A1 -> P5. Destinations without contribution vanish.

    Only sums leave the step, so the ranks of an id are summed first (a rank multiset,
    as the literal first round has, never multiplies edge rows)."""
    contribs = contributions(edges, summed_ranks(ranks), split, unique_ranks=True)
    return apply_damping(contrib_sum(contribs), reset, damping)


def rank_step_retain(vertex_table: DataFrame, edges: DataFrame, ranks: DataFrame,
                     reset: float = RESET, damping: float = DAMPING,
                     split: SourceSplit | None = None) -> DataFrame:
    """R2 (plain form): J1 -> A1 -> J4 -> P5. Every vertex is kept."""
    totals = contrib_sum(contributions(edges, summed_ranks(ranks), split, unique_ranks=True))
    return apply_damping(retain_all(vertex_table, totals), reset, damping)


def source_id_mass(vertex_table: DataFrame, edges: DataFrame, reset: float = RESET,
                   damping: float = DAMPING, missing: str = "retain") -> DataFrame:
    """The literal second-program step, ``reset + damping * sum(src_id * weight)``."""
    totals = contrib_sum(source_id_contributions(edges))
    if missing == "retain":
        totals = retain_all(vertex_table, totals)
    return apply_damping(totals, reset, damping)


def initial_ranks(edges: DataFrame, init: str = "unique",
                  initial: float = INITIAL_RANK) -> DataFrame:
    """Round-0 table as the variant defines it (the incidence multiset for ``incidence``)."""
    if init == "unique":
        return vertices(edges, initial)
    if init == "incidence":
        return incidence_vertices(edges, initial)
    raise ValueError(f"unknown init {init!r}")


def summed_initial_ranks(edges: DataFrame, init: str = "unique",
                         initial: float = INITIAL_RANK) -> DataFrame:
    """Round-0 ranks with unique ids: the incidence rows of one id pre-summed to one row."""
    if init == "unique":
        return vertices(edges, initial)
    if init == "incidence":
        return incidence_counts(edges).select(
            "id", (F.col("n").cast("double") * F.lit(float(initial))).alias("rank"))
    raise ValueError(f"unknown init {init!r}")


def check_variant(init: str, missing: str, contribution: str) -> None:
    if init not in INITS:
        raise ValueError(f"init must be one of {INITS}")
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    if contribution not in CONTRIBUTIONS:
        raise ValueError(f"contribution must be one of {CONTRIBUTIONS}")


def rank(edges: DataFrame, rounds: int, init: str = "unique", missing: str = "drop",
         contribution: str = "rank", reset: float = RESET, damping: float = DAMPING,
         initial: float = INITIAL_RANK, partitions: int | None = None) -> DataFrame:
    """``rounds`` steps of the recurrence as one lazy plan -> ``id, rank``.

    ``rounds <= 0`` returns the round-0 table (R4: ``1 to iters`` is empty).

    * R5 = ``rank(e, k, init="incidence", missing="drop")``
    * R6 = ``rank(e, k, init="unique", missing="drop")``
    * R7 = ``rank(e, k, contribution="source_id", missing="retain")``
    * R8 = ``rank(e, k, init="unique", missing="retain")``

    ``partitions`` is the ``P`` of the hot-source threshold ``|E| / P``
    (default: the session's shuffle partitions).
    """
    check_variant(init, missing, contribution)
    edges = edges.select("src_id", "dst_id", "weight")
    if rounds <= 0:
        return initial_ranks(edges, init, initial)
    if contribution == "source_id":
        # independent of the previous ranks: every round >= 1 gives the same table
        return source_id_mass(vertices(edges), edges, reset, damping, missing)
    # collapsed and salted once; every round references the previous ranks once, and
    # shuffles its sums by vertex and the finished ranks by (vertex, salt)
    graph = salt_graph(edges, partitions)
    vertex_table = vertex_ids(edges) if missing == "retain" else None
    ranks = summed_initial_ranks(edges, init, initial)
    for _ in range(rounds):
        totals = salted_totals(graph, ranks)
        if vertex_table is not None:
            totals = retain_all(vertex_table, totals)
        ranks = apply_damping(totals, reset, damping)
    return ranks
