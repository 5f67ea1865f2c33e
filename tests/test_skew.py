"""Skew-safe joins: a key holding a third of the rows is joined by broadcast."""

import pytest
from pyspark.sql import functions as F

from graphtables.operators.skew import split_join
from graphtables.plans.inspect import plan_text


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_hot_key(spark, how):
    n = 6000
    big = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 500).cast("long").alias("k"),
        F.col("id").alias("row"))
    small = spark.range(0, 400).select(F.col("id").alias("key"), (F.col("id") * 10).alias("val"))
    out = split_join(big, small, ["k"], ["key"], how, partitions=8)
    rows = out.collect()
    got = sorted((r["row"], r["k"], r["val"]) for r in rows)
    b = big.collect()
    s = {r["key"]: r["val"] for r in small.collect()}
    want = sorted((r["row"], r["k"], s.get(r["k"])) for r in b if how == "left" or r["k"] in s)
    assert got == want
    assert "BroadcastHashJoin" in plan_text(out)


def test_split_join_refuses_a_repeated_hot_key(spark):
    big = spark.range(300).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("row"))
    small = spark.createDataFrame([(1, 10), (1, 11)], "key long, val long")
    with pytest.raises(Exception, match="not unique"):
        split_join(big, small, ["k"], ["key"], partitions=4).collect()
