"""Graphs derived from the driver's parquet tables (TG1-TG4).

Each builder reads only the columns it needs (column pruning reaches the
parquet scan) and returns a plain edge table ``src_id, dst_id, weight``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.operators.sequence import successor_pairs
from graphtables.sources.edges import edges_from

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def part_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TG1: ``l_partkey -> l_suppkey``, one edge per line item (ids in one id space)."""
    li = table(spark, sf_dir, "lineitem")
    return edges_from(li, "l_partkey", "l_suppkey")


def nation_trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TG2: supplier nation -> customer nation, one edge per line item."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(o, li["l_orderkey"] == o["o_orderkey"])
         .join(c, F.col("o_custkey") == c["c_custkey"])
         .join(s, F.col("l_suppkey") == s["s_suppkey"]))
    return edges_from(j, "s_nationkey", "c_nationkey")


def user_succession_edges(spark: SparkSession, sf_dir: str,
                          partitions: int | None = None) -> DataFrame:
    """TG3: ``user_id -> next user_id`` within an event type, ordered by ``(ts, event_id)``."""
    ev = table(spark, sf_dir, "events")
    pairs = successor_pairs(ev, "event_type", ["ts", "event_id"], "user_id", partitions)
    return edges_from(pairs, "value", "next_value")


# Fixed values of TG4: customers, nations and regions share one id space by
# offsetting customers by 1000 and nations by 100.
CUSTOMER_OFFSET = 1000
NATION_OFFSET = 100


def customer_geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TG4: customer -> nation -> region, a DAG of depth 2."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    cust = edges_from(c, F.col("c_custkey") + CUSTOMER_OFFSET,
                      F.col("c_nationkey").cast("bigint") + NATION_OFFSET)
    nat = edges_from(n, F.col("n_nationkey").cast("bigint") + NATION_OFFSET, "n_regionkey")
    return cust.unionByName(nat)


GRAPHS = {
    "TG1": part_supplier_edges,
    "TG2": nation_trade_edges,
    "TG3": user_succession_edges,
    "TG4": customer_geo_edges,
}


def graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return GRAPHS[name](spark, sf_dir)
