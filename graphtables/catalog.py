"""The registered queries: one per operator group, over the driver's tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
match the DuckDB text in :mod:`graphtables.catalog_sql`. Ranks and other
doubles are rounded to 6 decimals (with weight 1.0 and at most 3 rounds
every value has at most 6 decimals, so rounding is tie-free).

Graphs (see :mod:`graphtables.sources.tables`): TG1 part -> supplier,
TG2 nation -> nation, TG3 user succession, TG4 customer -> nation -> region.
``ep`` = the reproducible two-dimensional edge partition of
:func:`graphtables.functions.columns.edge_partition_of` with n = 4.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.functions.columns import edge_partition_of
from graphtables.operators import bitmaps, generate, keyed, layout, numbering, rank as rk, routing as rt
from graphtables.operators.graph import (
    collapse_edges,
    endpoints,
    incidence_vertices,
    incidences,
    reverse_edges,
    vertex_ids,
    vertices,
)
from graphtables.operators.upsert import StoredKeyed
from graphtables.plans.durable import DurableRankLoop
from graphtables.plans.loop import RankLoop
from graphtables.plans.routed import RoutedLoop
from graphtables.session import checkpoint_dir, discard, shared_path
from graphtables.sources.edges import (
    SORT_ROWS,
    block_offsets,
    block_splits,
    parse_edges,
    read_block_edges,
    read_edges,
    rejected_lines,
    write_edges,
    write_sorted_edges,
)
from graphtables.sources.stored import bucket_placement, open_graph, store_graph
from graphtables.sources.tables import (
    customer_geo_edges,
    nation_trade_edges,
    part_supplier_edges,
    table,
    user_succession_edges,
)

BLOCK = 1 << 14     # bytes of a block of the text queries
NUM_EP = 4          # edge partitions of the routing queries
NUM_EP_SIZES = 6    # partition domain of routing_sizes: 4 and 5 stay empty

Query = Callable[[SparkSession, str], DataFrame]


def _r6(x: str = "rank") -> F.Column:
    return F.round(F.col(x), 6).alias(x)


def _ranks_out(df: DataFrame) -> DataFrame:
    return df.select("id", _r6("rank"))


def _tg1_ep(spark: SparkSession, d: str) -> DataFrame:
    return part_supplier_edges(spark, d).withColumn(
        "edge_partition", edge_partition_of("src_id", "dst_id", NUM_EP))


def _tg1_routing(spark: SparkSession, d: str) -> DataFrame:
    return rt.routing_table(_tg1_ep(spark, d))


def _tg1_r6_k1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = part_supplier_edges(spark, d)
    return e, rk.rank_step_drop(e, vertices(e))


# ---- ingest ------------------------------------------------------------------

def edge_parse(spark: SparkSession, d: str) -> DataFrame:
    """TG1 as text lines (a third, ignored field) plus one comment line per order."""
    li = table(spark, d, "lineitem")
    data = li.select(F.concat_ws("\t", F.col("l_partkey").cast("string"),
                                 F.col("l_suppkey").cast("string"),
                                 F.col("l_quantity").cast("string")).alias("value"))
    comments = table(spark, d, "orders").select(
        F.concat(F.lit("# order "), F.col("o_orderkey").cast("string")).alias("value"))
    return parse_edges(data.unionByName(comments))


def _kept_copy(df: DataFrame, *paths: str) -> DataFrame:
    """``df`` checkpointed, and the written tables that it was read from deleted."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    for path in paths:
        discard(df.sparkSession, path)
    return out


def edge_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """TG1 written as TSV with a ``#`` header below the shared folder, read back."""
    path = shared_path(spark, "tg1-edges")
    write_edges(part_supplier_edges(spark, d), path, header="src_id\tdst_id")
    return _kept_copy(read_edges(spark, path), path)


def edge_stream_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """S1-S5 as a stream: TG1 written as TSV files, ingested by a streaming query into
    a parquet edge table (both below the shared folder), read back."""
    from graphtables.streaming import append_edges, read_edge_stream

    src = shared_path(spark, "tg1-stream-in")
    write_edges(part_supplier_edges(spark, d), src, header="src_id\tdst_id")
    out = shared_path(spark, "tg1-stream-out")
    q = append_edges(read_edge_stream(spark, src), out, checkpoint=out + "-progress")
    q.awaitTermination()
    return _kept_copy(spark.read.parquet(out), src, out, out + "-progress")


def _tg1_text(spark: SparkSession, d: str) -> tuple[str, int]:
    """TG1 as text lines in the folder of a path: eight files, by the source modulo 8, each sorted by (source, destination);
    and the number of tasks that read it."""
    path = shared_path(spark, "tg1-blocks")
    rows = table(spark, d, "lineitem").count()
    write_sorted_edges(part_supplier_edges(spark, d), path, F.pmod("src_id", F.lit(8)), 8, rows)
    return path, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / SORT_ROWS))


def split_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    """S6 on TG1 as text, its edges with the block of their line; per edge how many rows it has, and whether
    all block numbers are below the number of blocks."""
    path, tasks = _tg1_text(spark, d)
    with block_splits(spark, BLOCK, tasks):
        blocks = block_offsets(spark, path, BLOCK).agg(F.max("first")).first()[0] + 1
        edges = read_block_edges(spark, path, block_bytes=BLOCK)
        last = edges.where(F.col("edge_partition") >= blocks).select("edge_partition").distinct().count()
        out = edges.groupBy("src_id", "dst_id").agg(
            F.count(F.lit(1)).alias("n"), F.bool_and(F.col("edge_partition").between(0, blocks + last - 1)).alias("in_range"))
        return _kept_copy(out, path)


def block_groups(spark: SparkSession, d: str) -> DataFrame:
    """What lies in each block of TG1 as text: rows, and distinct sources."""
    path, tasks = _tg1_text(spark, d)
    with block_splits(spark, BLOCK, tasks):
        edges = read_block_edges(spark, path, block_bytes=BLOCK)
        return _kept_copy(edges.groupBy("edge_partition").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("src_id").alias("sources")), path)


def rank_routed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """R2 over the blocks of a text scan, 3 rounds on TG1 (= R8)."""
    path, tasks = _tg1_text(spark, d)
    with block_splits(spark, BLOCK, tasks):
        out = _loop_ranks(RoutedLoop(read_block_edges(spark, path, block_bytes=BLOCK)), 3)
    discard(spark, path)
    return out


def _mixed_lines(spark: SparkSession, d: str) -> DataFrame:
    """TG1 edge lines plus one malformed (space-separated) line per order."""
    li = table(spark, d, "lineitem")
    good = li.select(F.concat_ws("\t", F.col("l_partkey").cast("string"),
                                 F.col("l_suppkey").cast("string")).alias("value"))
    bad = table(spark, d, "orders").select(
        F.concat_ws(" ", F.col("o_orderkey").cast("string"),
                    F.col("o_custkey").cast("string")).alias("value"))
    return good.unionByName(bad)


def edge_parse_permissive(spark: SparkSession, d: str) -> DataFrame:
    """Permissive parse (extension): malformed lines dropped, the edges kept."""
    return parse_edges(_mixed_lines(spark, d), mode="permissive")


def edge_rejects(spark: SparkSession, d: str) -> DataFrame:
    """The lines a permissive parse rejects (extension)."""
    return rejected_lines(_mixed_lines(spark, d))


def successor_edges(spark: SparkSession, d: str) -> DataFrame:
    """TG3 itself: user -> next user within an event type, by range slices."""
    return user_succession_edges(spark, d)


def edge_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Repeated edges merged, weights summed (the loop's edge layout) on TG2."""
    return collapse_edges(nation_trade_edges(spark, d)).select("src_id", "dst_id", _r6("weight"))


def edge_reverse(spark: SparkSession, d: str) -> DataFrame:
    """TG4 with source and destination exchanged."""
    return reverse_edges(customer_geo_edges(spark, d))


# ---- vertices ------------------------------------------------------------------

def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """U1 on TG3."""
    return endpoints(user_succession_edges(spark, d))


def vertex_set(spark: SparkSession, d: str) -> DataFrame:
    """G1, A5, P2 on TG1."""
    return vertices(part_supplier_edges(spark, d))


def vertex_incidence(spark: SparkSession, d: str) -> DataFrame:
    """G2, A4 on TG3: rows of the incidence multiset per id."""
    inc = incidences(user_succession_edges(spark, d))
    return inc.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


# ---- contributions ---------------------------------------------------------------

def edge_rank_join(spark: SparkSession, d: str) -> DataFrame:
    """J1, P1, P3 on TG1 with the ranks after one dropping round."""
    e, r1 = _tg1_r6_k1(spark, d)
    return rk.contributions(e, r1, unique_ranks=True).select("id", _r6("contrib"))


def contrib_sum(spark: SparkSession, d: str) -> DataFrame:
    """A1 on TG1."""
    e, r1 = _tg1_r6_k1(spark, d)
    return rk.contrib_sum(rk.contributions(e, r1, unique_ranks=True)).select("id", _r6("total_contrib"))


def contrib_partial(spark: SparkSession, d: str) -> DataFrame:
    """A2, S6 on TG1: partial sums per (ep, destination)."""
    e, r1 = _tg1_r6_k1(spark, d)
    e = e.withColumn("edge_partition", edge_partition_of("src_id", "dst_id", NUM_EP))
    return rk.contrib_partial(e, r1).select("edge_partition", "id", _r6("partial"))


def contrib_final(spark: SparkSession, d: str) -> DataFrame:
    """A3 on TG1: the partials summed per vertex."""
    e, r1 = _tg1_r6_k1(spark, d)
    e = e.withColumn("edge_partition", edge_partition_of("src_id", "dst_id", NUM_EP))
    return rk.contrib_final(rk.contrib_partial(e, r1)).select("id", _r6("total_contrib"))


def rank_damping(spark: SparkSession, d: str) -> DataFrame:
    """P5 on TG1."""
    e, r1 = _tg1_r6_k1(spark, d)
    return _ranks_out(rk.apply_damping(rk.contrib_sum(rk.contributions(e, r1, unique_ranks=True))))


# ---- single steps ------------------------------------------------------------------

def rank_step_drop(spark: SparkSession, d: str) -> DataFrame:
    """R1 on TG3."""
    e = user_succession_edges(spark, d)
    return _ranks_out(rk.rank_step_drop(e, vertices(e)))


def rank_step_retain(spark: SparkSession, d: str) -> DataFrame:
    """R2 (plain), J4 on TG1."""
    e = part_supplier_edges(spark, d)
    v = vertices(e)
    return _ranks_out(rk.rank_step_retain(v, e, v))


def source_id_mass(spark: SparkSession, d: str) -> DataFrame:
    """R3, P4 on TG1."""
    e = part_supplier_edges(spark, d)
    return _ranks_out(rk.source_id_mass(vertices(e), e))


# ---- rank variants -------------------------------------------------------------------

def rank_incidence_drop(spark: SparkSession, d: str) -> DataFrame:
    """R5 on TG3, 3 rounds."""
    return _ranks_out(rk.rank(user_succession_edges(spark, d), 3, init="incidence", missing="drop"))


def rank_unique_drop(spark: SparkSession, d: str) -> DataFrame:
    """R6 on TG1, 3 rounds (flagship)."""
    return _ranks_out(rk.rank(part_supplier_edges(spark, d), 3, init="unique", missing="drop"))


def rank_source_id(spark: SparkSession, d: str) -> DataFrame:
    """R7 on TG1: the table of every round from the first on (the loop's query runs three)."""
    return _ranks_out(rk.rank(part_supplier_edges(spark, d), 1, contribution="source_id",
                              missing="retain"))


def rank_unique_retain(spark: SparkSession, d: str) -> DataFrame:
    """R8 on TG1, 3 rounds."""
    return _ranks_out(rk.rank(part_supplier_edges(spark, d), 3, init="unique", missing="retain"))


def rank_dag_drop(spark: SparkSession, d: str) -> DataFrame:
    """R6 on the DAG TG4, 2 rounds: only the region ids remain."""
    return _ranks_out(rk.rank(customer_geo_edges(spark, d), 2, missing="drop"))


def rank_dag_retain(spark: SparkSession, d: str) -> DataFrame:
    """R8 on TG4, 3 rounds."""
    return _ranks_out(rk.rank(customer_geo_edges(spark, d), 3, missing="retain"))


def rank_zero_rounds(spark: SparkSession, d: str) -> DataFrame:
    """R4 with 0 rounds on TG3: the vertex set."""
    return _ranks_out(rk.rank(user_succession_edges(spark, d), 0))


def rank_incidence_zero(spark: SparkSession, d: str) -> DataFrame:
    """G2 / R5 with 0 rounds on TG4: the incidence multiset, one row per incidence."""
    return _ranks_out(rk.rank(customer_geo_edges(spark, d), 0, init="incidence"))


def rank_hot_sources(spark: SparkSession, d: str) -> DataFrame:
    """R8 on TG4 reversed (region -> nation -> customer), 3 rounds, P = 64: every nation
    has more than |E| / P out-edges, so the salted hot-source layout carries the plan
    (the result does not depend on P)."""
    e = reverse_edges(customer_geo_edges(spark, d))
    return _ranks_out(rk.rank(e, 3, missing="retain", partitions=64))


def rank_dense_drop(spark: SparkSession, d: str) -> DataFrame:
    """R6 on the heavy multigraph TG2, 2 rounds."""
    return _ranks_out(rk.rank(nation_trade_edges(spark, d), 2, missing="drop"))


# ---- routing -------------------------------------------------------------------------

def routing_table(spark: SparkSession, d: str) -> DataFrame:
    """G3, A6, S6 on TG1."""
    return _tg1_routing(spark, d)


def routing_pack(spark: SparkSession, d: str) -> DataFrame:
    """Packed message and its unpacked parts."""
    return rt.routing_messages(_tg1_routing(spark, d))


def routing_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Routing rows per vertex id."""
    ids = rt.routing_vertex_ids(_tg1_routing(spark, d))
    return ids.groupBy("vertex_id").agg(F.count(F.lit(1)).alias("n"))


def _routing_filter(include_src: bool, include_dst: bool) -> Query:
    def q(spark: SparkSession, d: str) -> DataFrame:
        f = rt.routing_filter(_tg1_routing(spark, d), include_src, include_dst)
        return f.select("edge_partition", "vertex_id")
    q.__doc__ = f"P7, G5: routing rows with include_src={include_src}, include_dst={include_dst}."
    return q


def routing_filter_flags(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each partition under all four flag settings (none of them under neither)."""
    table_ = _tg1_routing(spark, d)
    parts = [rt.routing_filter(table_, s, t).select("edge_partition", F.lit(s).alias("src"), F.lit(t).alias("dst"))
             for s in (False, True) for t in (False, True)]
    tagged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return tagged.groupBy("edge_partition", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def edge_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The number of edge partitions that TG1 fills."""
    return rt.edge_partition_count(_tg1_routing(spark, d))


def routing_reverse(spark: SparkSession, d: str) -> DataFrame:
    """G4 on TG1."""
    return rt.reverse_routing(_tg1_routing(spark, d))


def routing_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Vertices per edge partition over 6 partition ids (two empty)."""
    return rt.routing_sizes(_tg1_routing(spark, d), NUM_EP_SIZES)


def _tg1_r8_k1(spark: SparkSession, d: str) -> DataFrame:
    e = part_supplier_edges(spark, d)
    v = vertices(e)
    return rk.rank_step_retain(v, e, v)


def routing_ship(spark: SparkSession, d: str) -> DataFrame:
    """Ranks after one retaining round, shipped to the partitions using them as source."""
    s = rt.ship_ranks(_tg1_routing(spark, d), _tg1_r8_k1(spark, d))
    return s.select("edge_partition", "id", _r6("rank"))


def routing_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Edges joined with the shipped ranks inside their partition."""
    shipped = rt.ship_ranks(_tg1_routing(spark, d), _tg1_r8_k1(spark, d))
    t = rt.triplets(_tg1_ep(spark, d), shipped)
    return t.select("edge_partition", "src_id", "dst_id", _r6("contrib"))


def rank_routed(spark: SparkSession, d: str) -> DataFrame:
    """R2 composed from J2 -> J3 -> A2 -> A3 -> J4 -> P5, 3 rounds on TG1 (= R8).

    Through the routed loop: the routing table is built once and kept. The result does not
    depend on the edge partitioning, so the number of edge partitions follows the session's
    shuffle partitions.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = part_supplier_edges(spark, d).withColumn(
        "edge_partition", edge_partition_of("src_id", "dst_id", n))
    return _loop_ranks(RoutedLoop(e), 3)


# ---- keyed tables ----------------------------------------------------------------------

def id_union(spark: SparkSession, d: str) -> DataFrame:
    """K1: source ids of TG1 united with destination ids."""
    e = part_supplier_edges(spark, d)
    return keyed.id_union(e.select(F.col("src_id").alias("id")), e.select(F.col("dst_id").alias("id")))


def id_membership(spark: SparkSession, d: str) -> DataFrame:
    """K2: distinct source ids of TG1 that are also destinations."""
    e = part_supplier_edges(spark, d)
    srcs = e.select(F.col("src_id").alias("id")).distinct()
    return keyed.id_membership(srcs, e.select(F.col("dst_id").alias("id")))


def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    """K3: every TG1 vertex with its contribution sum after one round, 0.0 when absent."""
    e, r1 = _tg1_r6_k1(spark, d)
    sums = rk.contrib_sum(rk.contributions(e, r1, unique_ranks=True)).select(
        "id", F.col("total_contrib").alias("value"))
    out = keyed.lookup(vertex_ids(e), sums, "id", "value", default=0.0)
    return out.select("id", _r6("value"))


def _keyed_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.pmod(F.col("event_id"), F.lit(16)).cast("bigint").alias("value"),
        F.col("event_id").alias("seq"))
    even = F.pmod(F.col("seq"), F.lit(2)) == 0
    return ev.filter(even), ev.filter(~even)


def _keyed_merge(how: str) -> Query:
    def q(spark: SparkSession, d: str) -> DataFrame:
        old, new = _keyed_sides(spark, d)
        return keyed.keyed_merge(old, new, "key", "value", how=how,
                                 seq="seq" if how == "last" else None)
    q.__doc__ = f"K4: events with even ids merged with those with odd ids, merge = {how}."
    return q


# ---- layout -------------------------------------------------------------------------------

def layout_edges(spark: SparkSession, d: str) -> DataFrame:
    """TG1 placed by edge partition and sorted; content unchanged (counted per edge).

    The edge-partition count follows the session's shuffle partitions, so the
    placement spreads over as many tasks as the cluster is configured for.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = part_supplier_edges(spark, d).withColumn("edge_partition",
                                                 edge_partition_of("src_id", "dst_id", n))
    placed = layout.place_edges(e, n)
    return placed.groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("n_rows"))


def _ep_edges(spark: SparkSession, d: str) -> DataFrame:
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return part_supplier_edges(spark, d).withColumn("edge_partition", edge_partition_of("src_id", "dst_id", n))


def layout_by_source(spark: SparkSession, d: str) -> DataFrame:
    """L1, L2: TG1 placed by source and sorted inside: rows, order and placement as they are."""
    placed = layout.co_locate(part_supplier_edges(spark, d), "src_id", 8)
    return layout.placement(placed, "src_id", ["src_id"])


def layout_edge_order(spark: SparkSession, d: str) -> DataFrame:
    """L3, L4: TG1 placed by edge partition and sorted by (source, destination) inside."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return layout.placement(layout.place_edges(_ep_edges(spark, d), n), "edge_partition", ["src_id", "dst_id"])


def layout_vertices(spark: SparkSession, d: str) -> DataFrame:
    """The vertices of TG1 placed and sorted by id."""
    return layout.placement(layout.place_vertices(vertices(part_supplier_edges(spark, d)), 8), "id", ["id"])


# ---- materialising loop ------------------------------------------------------------------------

def _loop_ranks(loop: RankLoop | RoutedLoop, rounds: int) -> DataFrame:
    """The loop's final ranks, checkpointed, so that no table stays cached after the query."""
    ranks = loop.run(rounds)
    checkpoint_dir(ranks.sparkSession)
    out = _ranks_out(ranks).checkpoint()
    ranks.unpersist(blocking=False)
    return out


def rank_loop_retain(spark: SparkSession, d: str) -> DataFrame:
    """R8 on TG1 for 3 rounds through the materialising loop (= rank_unique_retain)."""
    loop = RankLoop(part_supplier_edges(spark, d), missing="retain")
    return _loop_ranks(loop, 3)


def rank_loop_split(spark: SparkSession, d: str) -> DataFrame:
    """R6 on TG2 for 2 rounds through the loop with every source split (= rank_dense_drop): at
    P = 64 each of the 25 nations has more than |E| / 2 P out-edges."""
    loop = RankLoop(nation_trade_edges(spark, d), missing="drop", hot_threshold=1, partitions=64)
    return _loop_ranks(loop, 2)


def rank_loop_incidence(spark: SparkSession, d: str) -> DataFrame:
    """R5 on TG3 for 3 rounds through the loop (= rank_incidence_drop)."""
    loop = RankLoop(user_succession_edges(spark, d), init="incidence", missing="drop")
    return _loop_ranks(loop, 3)


def rank_loop_checkpointed(spark: SparkSession, d: str) -> DataFrame:
    """R8 on TG1 for 3 rounds, checkpointing every round to the shared folder."""
    loop = RankLoop(part_supplier_edges(spark, d), missing="retain", checkpoint_every=1)
    return _loop_ranks(loop, 3)


def rank_loop_source_id(spark: SparkSession, d: str) -> DataFrame:
    """R7 on TG1 through the loop (= rank_source_id)."""
    loop = RankLoop(part_supplier_edges(spark, d), contribution="source_id", missing="retain")
    return _loop_ranks(loop, 3)


def rank_loop_hot_sources(spark: SparkSession, d: str) -> DataFrame:
    """The same through the loop with P = 64 (nations split off as hot sources)."""
    loop = RankLoop(reverse_edges(customer_geo_edges(spark, d)), missing="retain", partitions=64)
    return _loop_ranks(loop, 3)


def stage_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows each stage of a 3-round R6 loop on TG1 materialised (P fixed at 8,
    so the hot-source rule gives the same table in every session)."""
    loop = RankLoop(part_supplier_edges(spark, d), missing="drop", partitions=8)
    final = loop.run(3)
    final.unpersist(blocking=False)
    return loop.metrics().select("stage", "rows")


def stage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The second program's stages on TG1 (routed, P = 4), 3 rounds as written: rows of
    each, and whether a time was taken."""
    loop = RoutedLoop(_tg1_ep(spark, d), contribution="source_id")
    loop.run(3).unpersist(blocking=False)
    return loop.metrics().select("stage", "rows", (F.col("ms") > 0).alias("timed"))


# ---- stored tables and loops ---------------------------------------------------------------------

def _from_state(spark: SparkSession, edges: DataFrame, first: int, rounds: int, **options) -> DataFrame:
    """``first`` rounds by one loop; another one, which knows the state alone, does the rest."""
    state = shared_path(spark, "loop-state")
    DurableRankLoop(spark, state, edges, **options).run(first)
    later = DurableRankLoop(spark, state)
    return _kept_copy(_ranks_out(later.run(rounds)), state)


def rank_resumed(spark: SparkSession, d: str) -> DataFrame:
    """R8 on TG1, one round, then continued to 3 from the stored state (= rank_unique_retain)."""
    return _from_state(spark, part_supplier_edges(spark, d), 1, 3, missing="retain")


def rank_resumed_hot(spark: SparkSession, d: str) -> DataFrame:
    """The same on TG4 reversed with P = 64: every nation's edges are stored apart (= rank_hot_sources)."""
    return _from_state(spark, reverse_edges(customer_geo_edges(spark, d)), 2, 3, missing="retain", partitions=64)


def rank_resumed_incidence(spark: SparkSession, d: str) -> DataFrame:
    """R5 on TG3, layout and round 0 by one loop, 3 rounds by another (= rank_incidence_drop)."""
    return _from_state(spark, user_succession_edges(spark, d), 1, 3, init="incidence")


def resumed_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The finished rounds of a dropping loop on TG3 that was continued after round 1, with their rows."""
    state = shared_path(spark, "loop-state")
    DurableRankLoop(spark, state, user_succession_edges(spark, d)).run(1)
    later = DurableRankLoop(spark, state)
    later.run(3)
    return _kept_copy(later.rounds().select("round", "rows", F.lit(later.started_at).alias("started_at")), state)


def stage_rows_observed(spark: SparkSession, d: str) -> DataFrame:
    """The rows of stage_rows, counted by the writes of the resumable loop."""
    state = shared_path(spark, "loop-state")
    loop = DurableRankLoop(spark, state, part_supplier_edges(spark, d), partitions=8)
    loop.run(3)
    loop.discard_state()
    return loop.metrics().select("stage", "rows")


def stored_edge_join(spark: SparkSession, d: str) -> DataFrame:
    """TG1 and its vertices stored by source and by id, opened again and joined where they lie; sums by destination."""
    path = shared_path(spark, "tg1-stored")
    store_graph(part_supplier_edges(spark, d), path)
    e, v = open_graph(spark, path)
    joined = e.join(v.hint("shuffle_hash"), e["src_id"] == v["id"]).select(
        F.col("dst_id").alias("id"), (F.col("weight") * F.col("rank")).alias("contrib"))
    return _kept_copy(rk.contrib_sum(joined).select("id", _r6("total_contrib")), path)


def stored_placement(spark: SparkSession, d: str) -> DataFrame:
    """What the files of the stored edges and vertices of TG1 hold: rows, whether each key lies in one file, and whether
    there are at most as many files as buckets."""
    path = shared_path(spark, "tg1-stored")
    store_graph(part_supplier_edges(spark, d), path, 16)
    parts = [bucket_placement(spark, f"{path}/{name}").select(
        F.lit(name).alias("stored"), "rows", "placed", (F.col("buckets") <= 16).alias("bounded")) for name in ("edges", "vertices")]
    return _kept_copy(parts[0].unionByName(parts[1]), path)


# ---- dense numbers, bitmaps, messages, generated rows ------------------------------------------------

def vertex_slots(spark: SparkSession, d: str) -> DataFrame:
    """A5, G1: the vertices of TG1 numbered over 200 parts, without gaps."""
    return numbering.vertex_slots(vertex_ids(part_supplier_edges(spark, d)), 200)


def slot_edges(spark: SparkSession, d: str) -> DataFrame:
    """A5: TG3 (ids collapsed) between the slots of its vertices over 200 parts."""
    e = user_succession_edges(spark, d)
    return numbering.slot_edges(e, numbering.vertex_slots(vertex_ids(e), 200)).select("src_id", "dst_id", _r6("weight"))


def _tg1_bitmaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = part_supplier_edges(spark, d)
    return bitmaps.id_bitmap(e, "src_id"), bitmaps.id_bitmap(e, "dst_id")


def bitmap_sizes(spark: SparkSession, d: str) -> DataFrame:
    """K1, K2 as bitmaps: how many sources and destinations TG1 has, how many ids are either, and both."""
    src, dst = _tg1_bitmaps(spark, d)
    sets = {"sources": src, "destinations": dst, "either": bitmaps.bitmap_union(src, dst),
            "both": bitmaps.bitmap_intersection(src, dst)}
    parts = [bitmaps.bitmap_size(s).select(F.lit(name).alias("ids"), "n") for name, s in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def bitmap_union(spark: SparkSession, d: str) -> DataFrame:
    """K1: the ids of the united bitmaps of TG1 (= id_union)."""
    return bitmaps.bitmap_ids(bitmaps.bitmap_union(*_tg1_bitmaps(spark, d)))


def bitmap_membership(spark: SparkSession, d: str) -> DataFrame:
    """K2: the ids in both bitmaps of TG1 (= id_membership)."""
    return bitmaps.bitmap_ids(bitmaps.bitmap_intersection(*_tg1_bitmaps(spark, d)))


def _keyed_upsert(how: str) -> Query:
    def q(spark: SparkSession, d: str) -> DataFrame:
        ev = table(spark, d, "events").select(
            F.col("user_id").alias("key"), F.pmod(F.col("event_id"), F.lit(16)).cast("bigint").alias("value"),
            F.col("event_id").alias("seq"))
        path = shared_path(spark, "keyed")
        stored = StoredKeyed(spark, path, how=how, seq="seq" if how == "last" else None, parts=16)
        for k in range(3):
            stored.merge(ev.where(F.pmod("seq", F.lit(3)) == k), f"batch-{k}")
        return _kept_copy(stored.table(), path)
    q.__doc__ = f"K4 on a stored table: two merges after the first, events by id modulo 3, merge = {how}."
    return q


def routing_by_messages(spark: SparkSession, d: str) -> DataFrame:
    """The routing table of TG1 built inside its edge partitions, as packed messages placed by vertex, and unpacked."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rt.routing_of_messages(rt.routing_from_messages(_tg1_ep(spark, d), n))


def edge_endpoints_function(spark: SparkSession, d: str) -> DataFrame:
    """U1 on TG3 by a caller's function (= edge_endpoints)."""
    return generate.endpoints_by_function(user_succession_edges(spark, d))


def rank_two_way_hub(spark: SparkSession, d: str) -> DataFrame:
    """R8 on TG4 united with its reverse, 3 rounds, P = 64: every nation is a hot source and a hot
    destination, so a plan that copied contributions to salts would multiply its rows."""
    e = customer_geo_edges(spark, d)
    return _ranks_out(rk.rank(e.unionByName(reverse_edges(e)), 3, missing="retain", partitions=64))


def rank_first_round_literal(spark: SparkSession, d: str) -> DataFrame:
    """R1 on the incidence multiset of TG1: round 1 of the first program as written."""
    e = part_supplier_edges(spark, d)
    return _ranks_out(rk.rank_step_drop(e, incidence_vertices(e)))


QUERIES: dict[str, Query] = {
    "edge_parse": edge_parse,
    "edge_file_roundtrip": edge_file_roundtrip,
    "edge_stream_roundtrip": edge_stream_roundtrip,
    "edge_parse_permissive": edge_parse_permissive,
    "edge_rejects": edge_rejects,
    "successor_edges": successor_edges,
    "edge_collapse": edge_collapse,
    "edge_reverse": edge_reverse,
    "edge_endpoints": edge_endpoints,
    "vertex_set": vertex_set,
    "vertex_incidence": vertex_incidence,
    "edge_rank_join": edge_rank_join,
    "contrib_sum": contrib_sum,
    "contrib_partial": contrib_partial,
    "contrib_final": contrib_final,
    "rank_damping": rank_damping,
    "rank_step_drop": rank_step_drop,
    "rank_step_retain": rank_step_retain,
    "source_id_mass": source_id_mass,
    "rank_incidence_drop": rank_incidence_drop,
    "rank_unique_drop": rank_unique_drop,
    "rank_source_id": rank_source_id,
    "rank_unique_retain": rank_unique_retain,
    "rank_dag_drop": rank_dag_drop,
    "rank_dag_retain": rank_dag_retain,
    "rank_zero_rounds": rank_zero_rounds,
    "rank_incidence_zero": rank_incidence_zero,
    "rank_dense_drop": rank_dense_drop,
    "rank_hot_sources": rank_hot_sources,
    "routing_table": routing_table,
    "routing_pack": routing_pack,
    "routing_vertices": routing_vertices,
    "routing_filter_src": _routing_filter(True, False),
    "routing_filter_dst": _routing_filter(False, True),
    "routing_filter_both": _routing_filter(True, True),
    "routing_filter_flags": routing_filter_flags,
    "edge_partitions": edge_partitions,
    "routing_reverse": routing_reverse,
    "routing_sizes": routing_sizes,
    "routing_ship": routing_ship,
    "routing_triplets": routing_triplets,
    "rank_routed": rank_routed,
    "id_union": id_union,
    "id_membership": id_membership,
    "lookup_default": lookup_default,
    "keyed_merge_sum": _keyed_merge("sum"),
    "keyed_merge_max": _keyed_merge("max"),
    "keyed_merge_min": _keyed_merge("min"),
    "keyed_merge_bit_or": _keyed_merge("bit_or"),
    "keyed_merge_last": _keyed_merge("last"),
    "layout_edges": layout_edges,
    "layout_by_source": layout_by_source,
    "layout_edge_order": layout_edge_order,
    "layout_vertices": layout_vertices,
    "split_partition_counts": split_partition_counts,
    "rank_two_way_hub": rank_two_way_hub,
    "rank_first_round_literal": rank_first_round_literal,
    "rank_loop_retain": rank_loop_retain,
    "rank_loop_split": rank_loop_split,
    "rank_loop_incidence": rank_loop_incidence,
    "rank_loop_checkpointed": rank_loop_checkpointed,
    "rank_loop_source_id": rank_loop_source_id,
    "rank_loop_hot_sources": rank_loop_hot_sources,
    "stage_rows": stage_rows,
    "stage_metrics": stage_metrics,
    "block_groups": block_groups,
    "rank_routed_blocks": rank_routed_blocks,
    "rank_resumed": rank_resumed,
    "rank_resumed_hot": rank_resumed_hot,
    "rank_resumed_incidence": rank_resumed_incidence,
    "resumed_rounds": resumed_rounds,
    "stage_rows_observed": stage_rows_observed,
    "stored_edge_join": stored_edge_join,
    "stored_placement": stored_placement,
    "vertex_slots": vertex_slots,
    "slot_edges": slot_edges,
    "bitmap_sizes": bitmap_sizes,
    "bitmap_union": bitmap_union,
    "bitmap_membership": bitmap_membership,
    "keyed_upsert_sum": _keyed_upsert("sum"),
    "keyed_upsert_last": _keyed_upsert("last"),
    "routing_by_messages": routing_by_messages,
    "edge_endpoints_function": edge_endpoints_function,
}
