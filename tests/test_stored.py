"""Tables with a placement that another session finds again."""

import os
import subprocess
import sys
import textwrap

import pytest

from graphtables.operators.rank import rank
from graphtables.plans.inspect import shuffle_exchanges
from graphtables.session import children, exists, read_text, write_text
from graphtables.sources.stored import (
    bucket_placement,
    is_stored,
    open_graph,
    open_stored,
    store,
    store_graph,
    stored_layout,
)
from tests.conftest import ROOT

EDGES = "src_id long, dst_id long, weight double"
SESSION = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.warehouse.dir", {scratch!r} + "/warehouse").config("spark.sql.autoBroadcastJoinThreshold", "-1")
         .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {scratch!r} + "/ck").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
"""


def python(scratch, body):
    """Runs a program with a session of its own; returns what it printed and its exit code."""
    code = SESSION.format(root=ROOT, scratch=scratch) + textwrap.dedent(body)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=scratch, timeout=300,
                          env={**os.environ, "PYTHONPATH": ROOT})
    return done.stdout, done.returncode, done.stderr


def _edges(spark, n=300):
    return spark.createDataFrame([(i % 23, i * 7 % 61, 1.0) for i in range(n)], EDGES)


def test_a_stored_graph_joins_without_an_exchange(spark, scratch):
    path = f"{scratch}/graph"
    store_graph(_edges(spark), path, 6)
    e, v = open_graph(spark, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hint in ("shuffle_hash", "merge"):
            joined = e.join(v.hint(hint), e["src_id"] == v["id"])
            assert joined.count() == e.count() > 100
            assert shuffle_exchanges(joined) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert stored_layout(spark, f"{path}/edges")["keys"] == ["src_id"]
    assert sum(name.startswith("part-") for name in children(spark, f"{path}/edges/data")) == 6
    row = bucket_placement(spark, f"{path}/edges").first()
    assert (row["rows"], row["placed"]) == (e.count(), True) and row["buckets"] <= 6
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stored_")]


def test_two_applications(spark, scratch):
    """One process stores; another opens the tables and joins them where they lie."""
    out, code, err = python(scratch, f"""
        from graphtables.sources.stored import store_graph
        edges = spark.range(500).selectExpr("id % 23 as src_id", "id * 7 % 61 as dst_id", "1.0D as weight")
        store_graph(edges, {scratch!r} + "/graph", 5)
        """)
    assert code == 0, err
    out, code, err = python(scratch, f"""
        from graphtables.plans.inspect import shuffle_exchanges
        from graphtables.sources.stored import open_graph
        e, v = open_graph(spark, {scratch!r} + "/graph")
        joined = e.join(v.hint("shuffle_hash"), e["src_id"] == v["id"])
        print("rows", joined.count(), "exchanges", len(shuffle_exchanges(joined)))
        """)
    assert code == 0, err
    pairs = {(i % 23, i * 7 % 61) for i in range(500)}
    assert out.split() == ["rows", str(len(pairs)), "exchanges", "0"]


def test_what_a_lost_writer_left_is_cleared(spark, scratch):
    path = f"{scratch}/t"
    os.makedirs(f"{path}/data")
    with open(f"{path}/data/part-00000-lost.parquet", "w") as f:
        f.write("half a file")
    assert not is_stored(spark, path)
    assert store(_edges(spark, 40), path, ["src_id"], 3) == 40
    assert open_stored(spark, path).count() == 40
    with pytest.raises(FileExistsError):
        store(_edges(spark, 40), path, ["src_id"], 3)


def test_empty_and_null_keys(spark, scratch):
    assert store(spark.createDataFrame([], EDGES), f"{scratch}/none", ["src_id"], 3) == 0
    assert open_stored(spark, f"{scratch}/none").collect() == []
    rows = [(None, 1, 1.0), (2, None, None), (None, None, 0.5)]
    store(spark.createDataFrame(rows, EDGES), f"{scratch}/nulls", ["src_id", "dst_id"], 3)
    assert sorted(map(tuple, open_stored(spark, f"{scratch}/nulls").collect()), key=str) == sorted(rows, key=str)


def test_ranks_of_opened_edges(spark, scratch):
    store_graph(_edges(spark), f"{scratch}/g", 4)
    e, _ = open_graph(spark, f"{scratch}/g")
    got = {r["id"]: round(r["rank"], 9) for r in rank(e, 2, missing="retain").collect()}
    assert got == {r["id"]: round(r["rank"], 9) for r in rank(_edges(spark), 2, missing="retain").collect()}


def test_small_files_are_whole(spark, scratch):
    at = f"{scratch}/a/b"
    assert not exists(spark, at) and children(spark, f"{scratch}/a") == []
    write_text(spark, at, "é\nx")
    assert exists(spark, at) and read_text(spark, at) == "é\nx" and children(spark, f"{scratch}/a") == ["b"]
    with pytest.raises(FileExistsError):
        write_text(spark, at, "again")
    assert read_text(spark, at) == "é\nx" and [n for n in children(spark, f"{scratch}/a") if "crc" not in n] == ["b"]
