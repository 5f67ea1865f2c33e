"""Plan checks of the lazy rank plan."""

import pytest

from graphtables.operators.rank import rank
from graphtables.plans.inspect import exchanges, plan_text, shuffle_exchanges
from graphtables.sources.tables import part_supplier_edges

from tests.conftest import SF_SMALL


def _shuffles(spark, k, **kw):
    df = rank(part_supplier_edges(spark, SF_SMALL), k, **kw)
    df.collect()
    return shuffle_exchanges(df), plan_text(df)


@pytest.mark.parametrize("missing", ["drop", "retain"])
def test_shuffles_of_a_round(spark, missing):
    one, _ = _shuffles(spark, 1, missing=missing)
    three, text = _shuffles(spark, 3, missing=missing)
    # partial sums by vertex, and the finished ranks by (vertex, salt)
    assert len(three) - len(one) == 4
    # the edge table is exchanged once and reused by the other rounds
    assert sum("src_salt" in e for e in three) == 1
    assert "ReusedExchange" in text


@pytest.mark.parametrize("p", [8, 200, 4000])
def test_a_two_way_hub_multiplies_no_rows(spark, p):
    """A vertex that is hot in both directions: the rows that are summed stay the edges."""
    from pyspark.sql import functions as F

    from graphtables.operators.rank import summed_initial_ranks
    from graphtables.operators.skew import salt_graph, salted_contributions, with_salts

    out = spark.range(1, 2001).select(F.lit(0).cast("long").alias("src_id"), F.col("id").alias("dst_id"))
    e = out.unionByName(out.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))).withColumn("weight", F.lit(1.0))
    g = salt_graph(e, p)
    ranks = summed_initial_ranks(e)
    assert salted_contributions(g, ranks).count() == 4000
    assert with_salts(g, ranks).count() <= 2001 + 2 * p


def test_a_rank_multiset_is_summed_not_broadcast(spark):
    """Round 1 of the first program as written: the incidence rows of a hub are one row at the join."""
    from pyspark.sql import functions as F

    from graphtables.operators.graph import incidence_vertices
    from graphtables.operators.rank import rank_step_drop

    hub = spark.range(1, 3001).select(F.lit(0).cast("long").alias("src_id"), F.col("id").alias("dst_id"), F.lit(1.0).alias("weight"))
    step = rank_step_drop(hub, incidence_vertices(hub))
    got = {r["id"]: round(r["rank"], 6) for r in step.collect()}
    want = {r["id"]: round(r["rank"], 6) for r in rank(hub, 1, init="incidence").collect()}
    assert got == want and len(got) == 3000
    tree = step._jdf.queryExecution().executedPlan().toString()
    for part in tree.split("BroadcastExchange")[1:]:
        assert "HashAggregate" in part       # only aggregated rows (hot ids, one rank row an id)


def test_scan_reads_only_the_key_columns(spark):
    df = rank(part_supplier_edges(spark, SF_SMALL), 2)
    text = plan_text(df, "formatted")
    schemas = [ln for ln in text.splitlines() if "ReadSchema" in ln]
    assert schemas and all(ln.strip() == "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>"
                           for ln in schemas)
    assert "PushedFilters: [IsNotNull(l_partkey), IsNotNull(l_suppkey)]" in text


def test_no_estimate_based_broadcast_of_edges(spark):
    df = rank(part_supplier_edges(spark, SF_SMALL), 2)
    df.collect()
    for e in exchanges(df):
        if e.startswith("BroadcastExchange"):
            # only the hot-source lookup or measured rank totals: never the 3-column edge rows
            assert "input[2, double" not in e


def _plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_chained_rounds_plan_grows_linearly(spark):
    from graphtables.operators import routing as rt
    from graphtables.operators.graph import vertices
    from graphtables.sources.edges import with_edge_partition

    e = part_supplier_edges(spark, SF_SMALL)
    sizes = {k: _plan_size(rank(e, k, missing="retain")) for k in (2, 4, 8)}
    # linear: doubling the rounds adds about as much as the previous doubling, times two
    assert sizes[8] - sizes[4] <= 2.5 * (sizes[4] - sizes[2])

    ep = with_edge_partition(e, 4)
    table = rt.routing_table(ep)
    v = vertices(ep)

    def routed(k):
        r = v
        for _ in range(k):
            r = rt.routed_step(v, ep, table, r)
        return _plan_size(r)

    rs = {k: routed(k) for k in (2, 4, 8)}
    assert rs[8] - rs[4] <= 2.5 * (rs[4] - rs[2])
