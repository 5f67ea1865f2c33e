from pyspark.sql import functions as F

from graphtables.operators import layout
from graphtables.sources.tables import part_supplier_edges

from tests.conftest import SF_SMALL


def test_place_edges_keeps_rows_and_orders_partitions(spark):
    e = part_supplier_edges(spark, SF_SMALL).withColumn(
        "edge_partition", F.pmod("src_id", F.lit(4)).cast("int"))
    placed = layout.place_edges(e, 4)
    report = placed.transform(lambda d: layout.partition_order(d, ["src_id", "dst_id"])).collect()
    assert all(r["ordered"] for r in report)
    assert sum(r["rows"] for r in report) == e.count()
    # each edge partition lives in exactly one physical partition
    where = placed.select("edge_partition", F.spark_partition_id().alias("p")).distinct()
    assert where.groupBy("edge_partition").count().filter("count > 1").count() == 0
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, e.collect()))


def test_co_locate_and_vertices(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 101).alias("id"))
    placed = layout.place_vertices(df, 5)
    assert placed.rdd.getNumPartitions() == 5
    assert all(r["ordered"] for r in layout.partition_order(placed, ["id"]).collect())
    unsorted = spark.createDataFrame([(3,), (1,), (2,)], "id long").coalesce(1)
    assert [r["ordered"] for r in layout.partition_order(unsorted, ["id"]).collect()] == [False]


def test_placement_reports_what_is_there(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    assert layout.placement(layout.co_locate(df, "k", 4), "k", ["k"]).first() == (100, True, True)
    spread = df.repartition(4, "v").sortWithinPartitions(F.desc("k"))
    assert layout.placement(spread, "k", ["k"]).first() == (100, False, False)
    assert layout.placement(df.limit(0), "k", ["k"]).first() == (0, True, True)


def test_partition_order_is_exact_for_large_ids_and_nulls(spark):
    big = 2 ** 62
    ordered = spark.createDataFrame([(None,), (big,), (big + 1,)], "id long").coalesce(1)
    swapped = spark.createDataFrame([(big + 1,), (big,)], "id long").coalesce(1)
    nulls_last = spark.createDataFrame([(big,), (None,)], "id long").coalesce(1)
    assert [r["ordered"] for r in layout.partition_order(ordered, ["id"]).collect()] == [True]
    assert [r["ordered"] for r in layout.partition_order(swapped, ["id"]).collect()] == [False]
    assert [r["ordered"] for r in layout.partition_order(nulls_last, ["id"]).collect()] == [False]
