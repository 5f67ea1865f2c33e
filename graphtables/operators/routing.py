"""Routing tables: which vertex each edge partition needs, and in which position.

Flat form: ``edge_partition INT, vertex_id BIGINT, is_src BOOLEAN, is_dst BOOLEAN``,
one row per (edge partition, vertex). Built with one explode and one
aggregation (partial aggregation removes repeats before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtables.functions.columns import (
    DAMPING,
    RESET,
    edge_contribution,
    message_partition,
    message_position,
    pack_message,
    position,
    position_is_dst,
    position_is_src,
    source_id_contribution,
)
from graphtables.operators.rank import apply_damping, contrib_final, retain_all
from graphtables.operators.skew import split_join

ROUTING_COLUMNS = ("edge_partition", "vertex_id", "is_src", "is_dst")


def routing_table(edges: DataFrame) -> DataFrame:
    """G3 + A6: edges with ``edge_partition`` -> flat routing table.

    An empty edge table gives an empty routing table with the same schema.
    """
    ends = edges.select(
        "edge_partition",
        F.explode(F.array(
            F.struct(F.col("src_id").alias("vertex_id"), F.lit(True).alias("is_src"),
                     F.lit(False).alias("is_dst")),
            F.struct(F.col("dst_id").alias("vertex_id"), F.lit(False).alias("is_src"),
                     F.lit(True).alias("is_dst")),
        )).alias("e"))
    return (ends.groupBy("edge_partition", F.col("e.vertex_id").alias("vertex_id"))
            .agg(F.bool_or("e.is_src").alias("is_src"), F.bool_or("e.is_dst").alias("is_dst")))


def routing_from_messages(edges: DataFrame, vertex_partitions: int) -> DataFrame:
    """G3 in the original's two steps: ``vertex_id, message``, placed by vertex.

    An edge partition's vertices are found inside it, once each, with their positions; each becomes one packed
    INT, and the messages are shuffled once, by vertex, into ``vertex_partitions`` partitions, where they stay. Edges
    that lie placed by ``edge_partition`` need no other exchange."""
    ends = edges.select("edge_partition", F.explode(F.array(
        F.struct(F.col("src_id").alias("vertex_id"), position(F.lit(True), F.lit(False)).alias("position")),
        F.struct(F.col("dst_id").alias("vertex_id"), position(F.lit(False), F.lit(True)).alias("position")))).alias("e"))
    local = ends.groupBy("edge_partition", F.col("e.vertex_id").alias("vertex_id")).agg(
        F.bit_or("e.position").alias("position"))
    return local.select("vertex_id", pack_message("edge_partition", "position").alias("message")).repartition(
        int(vertex_partitions), "vertex_id")


def routing_of_messages(messages: DataFrame) -> DataFrame:
    """The flat routing table that packed messages hold; their placement stays."""
    at = message_position("message")
    return messages.select(message_partition("message").alias("edge_partition"), "vertex_id",
                           position_is_src(at).alias("is_src"), position_is_dst(at).alias("is_dst"))


def ship_along(messages: DataFrame, ranks: DataFrame, edge_partitions: int) -> DataFrame:
    """J2 from placed messages: the ranks each edge partition needs as a source, ``edge_partition, id, rank``, placed by
    edge partition. Messages and ranks placed alike by vertex meet where they lie, so this is one exchange."""
    flat = routing_filter(routing_of_messages(messages), True, False)
    return (flat.join(ranks.hint("shuffle_hash"), flat["vertex_id"] == ranks["id"])
            .select("edge_partition", "id", "rank").repartitionById(int(edge_partitions), "edge_partition"))


def placed_partials(edges: DataFrame, shipped: DataFrame, contribution: str = "rank") -> DataFrame:
    """J3 -> A2 inside each edge partition: ``edge_partition, id, partial``.

    ``edges`` are collapsed and, like ``shipped``, placed by edge partition, so neither the join nor the sums
    exchange rows (with ``spark.sql.requireAllClusterKeysForCoPartition`` off). ``contribution="source_id"``: the literal
    second program, which ships the ranks as well and then does not read them."""
    s = shipped.select(F.col("edge_partition").alias("s_ep"), "id", "rank").hint("shuffle_hash")
    at = (edges["edge_partition"] == s["s_ep"]) & (edges["src_id"] == s["id"])
    if contribution == "rank":
        joined, value = edges.join(s, at), edge_contribution("weight", "rank")
    else:
        joined, value = edges.join(s, at, "left"), source_id_contribution("src_id", "weight")
    return joined.groupBy("edge_partition", F.col("dst_id").alias("id")).agg(F.sum(value).alias("partial"))


def routing_messages(routing: DataFrame) -> DataFrame:
    """Pack position and partition into one INT and unpack them again.

    ``vertex_id, message, edge_partition, position``; ``position`` is the
    sign-extended value read back from the top bits (3 -> -1, 2 -> -2, 1 -> 1).
    """
    packed = routing.select(
        "vertex_id", pack_message("edge_partition", position("is_src", "is_dst")).alias("message"))
    return packed.select("vertex_id", "message",
                         message_partition("message").alias("edge_partition"),
                         message_position("message").alias("position"))


def routing_vertex_ids(routing: DataFrame) -> DataFrame:
    """Every vertex id over all partitions, repeats kept: ``vertex_id``."""
    return routing.select("vertex_id")


def routing_filter(routing: DataFrame, include_src: bool, include_dst: bool) -> DataFrame:
    """Vertices of each partition, selected by position.

    Both flags: all rows; neither: none; one flag: rows carrying that flag.
    """
    if include_src and include_dst:
        return routing
    if not include_src and not include_dst:
        return routing.filter(F.lit(False))
    return routing.filter(F.col("is_src") if include_src else F.col("is_dst"))


def reverse_routing(routing: DataFrame) -> DataFrame:
    """The routing table of the reversed graph (flags swapped)."""
    return routing.select("edge_partition", "vertex_id",
                          F.col("is_dst").alias("is_src"), F.col("is_src").alias("is_dst"))


def routing_sizes(routing: DataFrame, num_edge_partitions: int) -> DataFrame:
    """A7 + A8: vertices needed per edge partition, 0 for partitions without any:
    ``edge_partition INT, n BIGINT`` for ``edge_partition`` in ``0 .. num_edge_partitions-1``."""
    spark = routing.sparkSession
    counts = routing.groupBy("edge_partition").agg(F.count(F.lit(1)).alias("n"))
    ids = spark.range(num_edge_partitions).select(F.col("id").cast("int").alias("edge_partition"))
    return (ids.join(counts, "edge_partition", "left")
            .select("edge_partition", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def edge_partition_count(df: DataFrame) -> DataFrame:
    """Number of edge partitions, ``max(edge_partition) + 1`` (``n INT``; 0 when empty).

    Equals the partition count only when the highest partition is populated;
    otherwise pass the count as a parameter, as :func:`routing_sizes` takes it.
    """
    return df.agg(F.coalesce(F.max("edge_partition") + 1, F.lit(0)).cast("int").alias("n"))


def ship_ranks(routing: DataFrame, ranks: DataFrame) -> DataFrame:
    """The ranks each edge partition needs as a source: ``edge_partition, id, rank``.

    A semi-join-reduced copy of the rank table: each rank travels once per edge
    partition that uses it.
    """
    src = routing.filter("is_src").select("edge_partition", "vertex_id")
    return (src.join(ranks.hint("shuffle_hash"), src["vertex_id"] == ranks["id"], "inner")
            .select("edge_partition", "id", "rank"))


def triplets(edges: DataFrame, shipped: DataFrame) -> DataFrame:
    """Edges joined with the shipped ranks inside their edge partition:
    ``edge_partition, src_id, dst_id, weight, rank, contrib``."""
    # many-to-one on (edge partition, source): a hot group is joined by broadcast,
    # the rest by a shuffled hash join built on the shipped side
    s = shipped.select(F.col("edge_partition").alias("s_ep"), "id", "rank")
    j = split_join(edges, s, ["edge_partition", "src_id"], ["s_ep", "id"])
    return j.select("edge_partition", "src_id", "dst_id", "weight", "rank",
                    edge_contribution("weight", "rank").alias("contrib"))


def routed_partials(edges: DataFrame, routing: DataFrame, ranks: DataFrame) -> DataFrame:
    """J2 -> J3 -> A2: partial sums per (edge partition, destination).

    Meant for chained rounds, so the ranks are referenced once (the plan grows
    linearly). Repeated edges are collapsed per partition first (weights
    summed, exact: only sums leave this step); with an edge partition that
    spreads a source's edges over ``n`` partitions (:func:`edge_partition_of`),
    a (partition, source) group then holds at most about ``deg / n`` edges.
    """
    e = edges.groupBy("edge_partition", "src_id", "dst_id").agg(F.sum("weight").alias("weight"))
    s = ship_ranks(routing, ranks).select(F.col("edge_partition").alias("s_ep"), "id", "rank")
    j = e.join(s.hint("shuffle_hash"), (e["edge_partition"] == s["s_ep"]) & (e["src_id"] == s["id"]))
    return j.groupBy("edge_partition", F.col("dst_id").alias("id")).agg(
        F.sum(edge_contribution("weight", "rank")).alias("partial"))


def routed_step(vertex_table: DataFrame, edges: DataFrame, routing: DataFrame,
                ranks: DataFrame, reset: float = RESET, damping: float = DAMPING) -> DataFrame:
    """R2 composed from the routing operators: J2 -> J3 -> A2 -> A3 -> J4 -> P5."""
    totals = contrib_final(routed_partials(edges, routing, ranks))
    return apply_damping(retain_all(vertex_table, totals), reset, damping)
