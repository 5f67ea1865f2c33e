"""Vertex and incidence derivation (U1, G1, G2, A4, A5) and edge reshaping.

A vertex exists iff it is an endpoint of some edge. All operators are
aggregations with map-side partial aggregation, so a hot vertex or a
heavily repeated edge is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtables.functions.columns import INITIAL_RANK


def endpoints(edges: DataFrame) -> DataFrame:
    """One row per (edge, endpoint), parent columns kept: ``src_id, dst_id, weight, id``.

    A self-loop yields two identical rows, as the row-to-two-rows generator does.
    """
    return edges.select("*", F.explode(F.array("src_id", "dst_id")).alias("id"))


def vertex_ids(edges: DataFrame) -> DataFrame:
    """A5: distinct endpoint ids (``id BIGINT``).

    The explicit not-null filter (edges have no null endpoint) makes every use of
    the vertex set the same plan, so one exchange serves them all.
    """
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"))
    return ends.filter(F.col("id").isNotNull()).distinct()


def vertices(edges: DataFrame, initial: float = INITIAL_RANK) -> DataFrame:
    """G1: every endpoint once, with the initial rank: ``id BIGINT, rank DOUBLE``."""
    return vertex_ids(edges).select("id", F.lit(float(initial)).alias("rank"))


def incidences(edges: DataFrame) -> DataFrame:
    """A4: distinct (edge, endpoint) rows over all four columns.

    Duplicate edges collapse to one; a self-loop counts once.
    """
    return endpoints(edges.select("src_id", "dst_id", "weight")).distinct()


def incidence_counts(edges: DataFrame) -> DataFrame:
    """Rows of :func:`incidences` per id: ``id BIGINT, n BIGINT``.

    Computed as distinct edges -> distinct endpoints per edge -> count, which is
    the same multiset without materialising the 4-column rows.
    """
    distinct_edges = edges.select("src_id", "dst_id", "weight").distinct()
    ends = distinct_edges.select(
        F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def incidence_vertices(edges: DataFrame, initial: float = INITIAL_RANK) -> DataFrame:
    """The incidence multiset with the initial rank, one row per incidence: ``id, rank``."""
    return incidences(edges).select("id", F.lit(float(initial)).alias("rank"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Edges with source and destination exchanged (other columns kept)."""
    cols = [F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")]
    cols += [F.col(c) for c in edges.columns if c not in ("src_id", "dst_id")]
    return edges.select(*cols)


def collapse_edges(edges: DataFrame) -> DataFrame:
    """Merge repeated edges into one whose weight is the sum of their weights.

    Exact for every rank variant, because each contribution is linear in the
    weight; a group of copies holding a large share of all rows becomes one row
    (partial aggregation combines the copies before the shuffle).
    """
    return edges.groupBy("src_id", "dst_id").agg(F.sum("weight").alias("weight"))


def out_degrees(edges: DataFrame) -> DataFrame:
    """Edges per source: ``src_id, out_degree``."""
    return edges.groupBy("src_id").agg(F.count(F.lit(1)).alias("out_degree"))
