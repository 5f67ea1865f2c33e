"""Hot sources: keep a source with a large share of the edges out of any single task.

Joining edges to ranks on ``src_id`` puts all out-edges of one source into one
task. A source with more than ``T = ceil(|E| / P)`` out-edges (more than an
average partition on its own) is *hot*. Since the out-degrees sum to ``|E|``,
fewer than ``P`` sources can be hot, whatever the data, so the hot ids, and
the rank rows of hot sources, form tables with a proven size bound:

* edges of ordinary sources join the ranks by shuffle on ``src_id``;
* edges of hot sources stay spread over the tasks and meet their (fewer than
  ``P``) rank rows through a broadcast join.

``T`` is computed inside the plan (a scalar subquery over the out-degree
table), so building the split runs no job by itself. This split serves single
steps and the materialising loop (whose rank table is a cached leaf); plans
that chain many rounds use the salted layout below, which references the
previous ranks once per round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtables.operators.graph import collapse_edges, out_degrees


@dataclass(frozen=True)
class SourceSplit:
    """Edges split by source hotness: ``normal`` and ``hot`` edge rows (all input columns), and
    ``hot_ids``, the ``src_id`` of the fewer than ``2 P`` hot sources."""

    normal: DataFrame
    hot: DataFrame
    hot_ids: DataFrame


def hot_threshold(degrees: DataFrame, partitions: int) -> Column:
    """``ceil(|E| / P)`` as a scalar-subquery column over an out-degree table."""
    total = degrees.select(F.sum("out_degree")).scalar()
    return F.ceil(total / F.lit(int(partitions)))


def split_sources(edges: DataFrame, partitions: int | None = None,
                  threshold: int | None = None) -> SourceSplit:
    """Split ``edges`` into ordinary and hot sources (lazy).

    With the default threshold fewer than ``partitions`` sources are hot. A
    ``threshold`` below ``|E| / 2 P`` counts as that, so that the hot ids keep a
    proven bound (``2 P``) and are always broadcast.
    """
    spark = edges.sparkSession
    p = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    deg = out_degrees(edges)
    t = hot_threshold(deg, p) if threshold is None else F.greatest(
        F.lit(int(threshold)).cast("long"), hot_threshold(deg, 2 * p).cast("long"))
    hot_ids = deg.filter(F.col("out_degree") > t).select("src_id")
    ids = F.broadcast(hot_ids)
    normal = edges.join(ids, "src_id", "left_anti")
    # hot edges stay where the input put them: the broadcast join needs no exchange
    hot = edges.join(ids, "src_id", "left_semi")
    return SourceSplit(normal, hot, hot_ids)


def summed_ranks(ranks: DataFrame) -> DataFrame:
    """``ranks`` with one row per id: equal ids summed, exact wherever only sums of contributions are used."""
    return ranks.groupBy("id").agg(F.sum("rank").alias("rank"))


def join_split(split: SourceSplit, ranks: DataFrame, unique_ranks: bool = False) -> DataFrame:
    """Edges joined to ranks on ``src_id = id``.

    Ordinary sources: shuffled hash join built on the ranks. Hot sources: with
    ``unique_ranks`` (the ranks come out of an aggregation by id) their fewer than ``2 P``
    rows are broadcast to the hot edges where they are. A rank multiset has no
    such bound and is joined by shuffle; sum it first (:func:`summed_ranks`) where only
    sums are used.
    """
    normal = split.normal.join(ranks.hint("shuffle_hash"), split.normal["src_id"] == ranks["id"])
    ids = F.broadcast(split.hot_ids)
    hot_ranks = ranks.join(ids, ranks["id"] == ids["src_id"], "left_semi")
    hot_ranks = F.broadcast(hot_ranks) if unique_ranks else hot_ranks.hint("shuffle_hash")
    hot = split.hot.join(hot_ranks, split.hot["src_id"] == hot_ranks["id"])
    return normal.unionByName(hot)


def _one_row_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    rows = df.groupBy(*keys).agg(*(F.any_value(c).alias(c) for c in df.columns if c not in keys),
                                 F.count(F.lit(1)).alias("_rows"))
    unique = F.when(F.col("_rows") == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit("split_join: a key of the small side is not unique")).cast("boolean"))
    return rows.filter(unique).select(*df.columns)


def split_join(big: DataFrame, small: DataFrame, big_keys: list[str], small_keys: list[str],
               how: str = "inner", partitions: int | None = None) -> DataFrame:
    """Many-to-one join (``small`` has unique keys) without a hot-key task.

    Keys holding more than ``ceil(|big| / P)`` rows of ``big`` (fewer than ``P``
    keys, by the same counting argument as for sources) meet their ``small``
    rows through a broadcast join, where ``big`` rows stay put; all other keys
    use a shuffled hash join built on ``small``. ``how``: ``inner`` or ``left``.
    Output: the columns of ``big`` followed by those of ``small``. The broadcast rows come
    out of an aggregation by key, so there are fewer than ``P``; a hot key that
    ``small`` has twice raises an error.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    spark = big.sparkSession
    p = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    counts = big.groupBy(*big_keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.select(F.sum("_n")).scalar()
    hot = F.broadcast(counts.filter(F.col("_n") > F.ceil(total / F.lit(p))).select(*big_keys))
    big_normal = big.join(hot, big_keys, "left_anti")
    big_hot = big.join(hot, big_keys, "left_semi")
    hot_s = hot.select(*[F.col(b).alias(f"_h{i}") for i, b in enumerate(big_keys)])
    small_hot = small.join(hot_s, [small[k] == hot_s[f"_h{i}"] for i, k in enumerate(small_keys)],
                           "left_semi")
    small_hot = _one_row_per_key(small_hot, small_keys)

    def cond(left: DataFrame, right: DataFrame):
        c = None
        for b, k in zip(big_keys, small_keys):
            term = left[b] == right[k]
            c = term if c is None else c & term
        return c

    normal = big_normal.join(small.hint("shuffle_hash"), cond(big_normal, small), how)
    small_b = F.broadcast(small_hot)
    hot_part = big_hot.join(small_b, cond(big_hot, small_b), how)
    return normal.unionByName(hot_part)


# ---- salted form: one join per round, for plans that chain many rounds -------------
#
# A hot source has ``ceil(deg / T)`` salts, an ordinary one the salt 0; an edge carries
# ``salt = pmod(xxhash64(dst_id), salts)`` of its source. Each round copies the finished
# rank rows to their salts (fewer than 2 P more rows), joins them to the edges by
# (vertex, salt), and sums the contributions by vertex. Contributions are never
# copied, so a vertex that is hot in both directions costs no more than its edges.

@dataclass(frozen=True)
class SaltedGraph:
    """``edges``: ``src_id, dst_id, weight, src_salt``, each pair of vertices once; ``lookup``:
    ``_hot_id, salts`` of the hot sources (fewer than ``P`` rows, fewer than ``2 P`` salts), broadcast."""

    edges: DataFrame
    lookup: DataFrame


def salt_graph(edges: DataFrame, partitions: int | None = None) -> SaltedGraph:
    """Collapse repeated edges (weights summed, exact) and salt those of hot sources (lazy).

    Collapsed, an edge is one row however often it repeats, so hashing ``dst_id``
    spreads a hot source evenly.
    """
    spark = edges.sparkSession
    p = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    edges = collapse_edges(edges.select("src_id", "dst_id", "weight"))
    deg = out_degrees(edges)
    t = hot_threshold(deg, p)
    lookup = F.broadcast(deg.filter(F.col("out_degree") > t).select(
        F.col("src_id").alias("_hot_id"), F.ceil(F.col("out_degree") / t).cast("int").alias("salts")))
    salted = edges.join(lookup, edges["src_id"] == lookup["_hot_id"], "left").select(
        "src_id", "dst_id", "weight",
        F.pmod(F.xxhash64("dst_id"), F.coalesce(F.col("salts"), F.lit(1))).cast("int").alias("src_salt"))
    return SaltedGraph(salted, lookup)


def with_salts(graph: SaltedGraph, df: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with a ``salt`` column: one row per salt of ``key`` (one row, salt 0, if not hot)."""
    hot = graph.lookup
    j = df.join(hot, df[key] == hot["_hot_id"], "left")
    n = F.coalesce(F.col("salts"), F.lit(1))
    return j.select(*[F.col(c) for c in df.columns],
                    F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"))


def salted_contributions(graph: SaltedGraph, ranks: DataFrame) -> DataFrame:
    """One row per (collapsed) edge whose source has a rank: ``id (= dst_id), contrib``.
    ``ranks`` (``id, rank``) has unique ids."""
    e, r = graph.edges, with_salts(graph, ranks)
    j = e.join(r.hint("shuffle_hash"), (e["src_id"] == r["id"]) & (e["src_salt"] == r["salt"]))
    return j.select(F.col("dst_id").alias("id"), (F.col("weight") * F.col("rank")).alias("contrib"))


def salted_totals(graph: SaltedGraph, ranks: DataFrame) -> DataFrame:
    """One round's sums: ``ranks`` (``id, rank``) -> ``id, total_contrib``."""
    return salted_contributions(graph, ranks).groupBy("id").agg(F.sum("contrib").alias("total_contrib"))
