"""Routing tables on F1 with partition 0 = first four edges, 1 = last three."""

from graphtables.functions import position_is_dst, position_is_src
from graphtables.operators import routing as rt
from graphtables.operators.graph import reverse_edges, vertices
from graphtables.operators.rank import rank, rank_step_retain

F1 = [(1, 2), (2, 3), (3, 1), (1, 2), (3, 3), (4, 1), (3, 5)]


def _f1(spark):
    rows = [(s, d, 1.0, 0 if i < 4 else 1) for i, (s, d) in enumerate(F1)]
    return spark.createDataFrame(rows, "src_id long, dst_id long, weight double, edge_partition int")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_routing_table(spark):
    got = _rows(rt.routing_table(_f1(spark)))
    assert got == [(0, 1, True, True), (0, 2, True, True), (0, 3, True, True),
                   (1, 1, False, True), (1, 3, True, True), (1, 4, True, False), (1, 5, False, True)]


def test_filters_and_sizes(spark):
    table = rt.routing_table(_f1(spark))
    src = _rows(rt.routing_filter(table, True, False).select("edge_partition", "vertex_id"))
    assert src == [(0, 1), (0, 2), (0, 3), (1, 3), (1, 4)]
    dst = _rows(rt.routing_filter(table, False, True).select("edge_partition", "vertex_id"))
    assert dst == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 3), (1, 5)]
    assert rt.routing_filter(table, True, True).count() == 7
    assert rt.routing_filter(table, False, False).count() == 0
    assert _rows(rt.routing_sizes(table, 3)) == [(0, 3), (1, 4), (2, 0)]
    assert rt.edge_partition_count(table).collect()[0]["n"] == 2
    assert rt.edge_partition_count(table.filter("false")).collect()[0]["n"] == 0


def test_pack_round_trip(spark):
    msgs = rt.routing_messages(rt.routing_table(_f1(spark)))
    got = {(r["vertex_id"], r["edge_partition"]): (r["message"], r["position"]) for r in msgs.collect()}
    assert got[(1, 0)] == (-1073741824, -1)       # both: 3 << 30, sign-extended back to -1
    assert got[(4, 1)] == (1073741825, 1)         # source only
    assert got[(5, 1)] == (-2147483647, -2)       # destination only
    flags = msgs.select("edge_partition", "vertex_id",
                        position_is_src("position").alias("s"),
                        position_is_dst("position").alias("d"))
    assert _rows(flags) == _rows(rt.routing_table(_f1(spark)))


def test_reverse_equals_routing_of_reversed_edges(spark):
    table = rt.routing_table(_f1(spark))
    assert _rows(rt.reverse_routing(table)) == _rows(rt.routing_table(reverse_edges(_f1(spark))))


def test_ship_and_routed_rank(spark):
    e = _f1(spark)
    table = rt.routing_table(e)
    v = vertices(e)
    shipped = _rows(rt.ship_ranks(table, v))
    assert shipped == [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0), (1, 3, 1.0), (1, 4, 1.0)]
    trip = rt.triplets(e, rt.ship_ranks(table, v))
    assert trip.count() == len(F1)
    plain = {r["id"]: r["rank"] for r in rank_step_retain(v, e, v).collect()}
    routed = {r["id"]: r["rank"] for r in rt.routed_step(v, e, table, v).collect()}
    assert plain == routed
    ranks = v
    for _ in range(3):
        ranks = rt.routed_step(v, e, table, ranks)
    want = {r["id"]: round(r["rank"], 9) for r in rank(e, 3, missing="retain").collect()}
    assert {r["id"]: round(r["rank"], 9) for r in ranks.collect()} == want


def test_empty_edges_give_empty_routing(spark):
    e = spark.createDataFrame([], "src_id long, dst_id long, weight double, edge_partition int")
    table = rt.routing_table(e)
    assert table.count() == 0
    assert table.columns == list(rt.ROUTING_COLUMNS)


def test_two_dimensional_partitions_bound_the_routing_table(spark):
    import math

    from graphtables.functions.columns import edge_partition_of
    from graphtables.sources.tables import part_supplier_edges
    from tests.conftest import SF_ORACLE

    e = part_supplier_edges(spark, SF_ORACLE)
    sources = e.select("src_id").distinct().count()
    for n in (64, 1024):
        ep = e.withColumn("edge_partition", edge_partition_of("src_id", "dst_id", n))
        assert ep.filter(~ep["edge_partition"].between(0, n - 1)).count() == 0
        table = rt.routing_table(ep)
        assert table.filter("is_src").count() <= sources * math.isqrt(n)
        assert table.groupBy("vertex_id").count().agg({"count": "max"}).first()[0] <= 2 * math.isqrt(n)


def test_a_partition_beyond_the_message_raises(spark):
    import pytest

    table = spark.createDataFrame([(1 << 30, 5, True, False)], "edge_partition int, vertex_id long, is_src boolean, is_dst boolean")
    with pytest.raises(Exception, match="beyond 30 bits"):
        rt.routing_messages(table).collect()
