"""Edge partitions that are blocks of the text: the same in every plan."""

import glob
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphtables.operators.rank import rank
from graphtables.plans.routed import RoutedLoop
from graphtables.sources import edges as edge_sources
from graphtables.sources.edges import block_offsets, block_splits, edges_from, parse_edges, read_block_edges, read_edges

BLOCK = 4096


def _write(scratch, files=3, lines=1500, seed=1):
    rng = random.Random(seed)
    where = {}
    first = 0
    for k in range(files):
        at, text = 0, []
        for i in range(lines * k):                     # the first file is empty, and has no block
            line = f"{k * 100000 + i}\t{rng.randint(0, 10 ** rng.randint(1, 9))}\n"
            # a line belongs to the split that the line break before it lies in
            where[k * 100000 + i] = first + (0 if at == 0 else (at - 1) // BLOCK)
            text.append(line)
            at += len(line)
        with open(f"{scratch}/part-{k}.tsv", "w") as f:
            f.write("".join(text))
        first += -(-at // BLOCK)
    return where


def test_blocks_are_the_same_whatever_the_splits(spark, scratch):
    where = _write(scratch)
    for split in (BLOCK, BLOCK // 2, BLOCK // 8):
        with block_splits(spark, split):
            got = {r["src_id"]: r["edge_partition"] for r in read_block_edges(spark, scratch, block_bytes=BLOCK).collect()}
        assert got == where, split
    assert len(set(where.values())) > 8
    offsets = sorted(r["first"] for r in block_offsets(spark, scratch, BLOCK).collect())
    assert offsets[0] == 0 and len(offsets) == 2


def test_a_split_over_two_blocks_is_an_error(spark, scratch):
    _write(scratch)
    with block_splits(spark, 3000), pytest.raises((PySparkException, Py4JJavaError)):
        read_block_edges(spark, scratch, block_bytes=BLOCK).collect()


def test_block_splits_restores_the_session(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(n, None) for n in names]
    with block_splits(spark, 777):
        assert spark.conf.get(names[0]) == "777"
    assert [spark.conf.get(n, None) for n in names] == before


def test_ranks_over_blocks(spark, scratch):
    _write(scratch, 3, 200)
    edges = read_edges(spark, scratch)
    with block_splits(spark, BLOCK):
        got = RoutedLoop(read_block_edges(spark, scratch, block_bytes=BLOCK)).run(2)
    expected = rank(edges, 2, missing="retain")
    assert {r["id"]: round(r["rank"], 9) for r in got.collect()} == {r["id"]: round(r["rank"], 9) for r in expected.collect()}
    got.unpersist()


def test_few_tasks_read_many_blocks(spark, scratch):
    where = _write(scratch)
    with block_splits(spark, BLOCK, tasks=4):
        edges = read_block_edges(spark, scratch, block_bytes=BLOCK)
        got = {r["src_id"]: r["edge_partition"] for r in edges.collect()}
        assert edges.rdd.getNumPartitions() <= 5
    assert got == where and len(set(where.values())) > 8


def test_many_blocks_share_placed_partitions(spark, scratch):
    """Rounds whose tasks follow the edges, not the number of blocks; still two exchanges each."""
    _write(scratch)
    with block_splits(spark, 512):
        edges = read_block_edges(spark, scratch, block_bytes=512)
        loop = RoutedLoop(edges, vertex_partitions=3)
        got = loop.run(2)
    assert [len(x) for x in loop.round_exchanges] == [2, 2]
    assert all(", 3)" in e for x in loop.round_exchanges for e in x), loop.round_exchanges
    expected = rank(read_edges(spark, scratch), 2, missing="retain")
    assert {r["id"]: round(r["rank"], 9) for r in got.collect()} == {r["id"]: round(r["rank"], 9) for r in expected.collect()}
    got.unpersist()


def test_sorted_files_from_many_tasks(spark, scratch, monkeypatch):
    """One file a part whatever number of tasks sorts it, copies and absent parts included."""
    monkeypatch.setattr(edge_sources, "SORT_ROWS", 100)
    rng = random.Random(2)
    rows = [(rng.randint(-50, 50) * 3, rng.randint(-9, 999)) for _ in range(1500)] + [(6, 7)] * 700
    edges = edges_from(spark.createDataFrame([*rows, (None, 1)], "src_id long, dst_id long").repartition(5))
    path = f"{scratch}/sorted"
    edge_sources.write_sorted_edges(edges, path, F.pmod("src_id", F.lit(6)), 6, len(rows))
    for part in range(6):
        files = glob.glob(f"{path}/part={part}/*.txt")
        expected = "".join(f"{s}\t{d}\n" for s, d in sorted(r for r in rows if r[0] % 6 == part))
        assert [open(f).read() for f in files] == ([expected] if expected else [])
    edge_sources.write_sorted_edges(edges.where("false"), path + "-none", F.pmod("src_id", F.lit(6)), 6, 0)
    assert not glob.glob(path + "-none/part=*")


def test_a_line_is_tested_once(spark):
    """One pattern in the filter for ordinary lines, no pattern where the ids are cut out."""
    lines = spark.createDataFrame([("1\t2",)], "value string")
    plan = parse_edges(lines)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Filter", 1)
    assert "split(" not in above and "RLIKE" not in above
    assert below.count("RLIKE") <= 3


@pytest.mark.parametrize("line,edge", [
    ("123456789012345678\t-123456789012345678", (123456789012345678, -123456789012345678)),
    ("1234567890123456789\t+5\tx\ty", (1234567890123456789, 5)),
    ("-9223372036854775808\t0000000000000000000000007", (-9223372036854775808, 7)),
    ("0\t9223372036854775807\t", (0, 9223372036854775807))])
def test_long_ids(spark, line, edge):
    for mode in ("failfast", "permissive"):
        got = parse_edges(spark.createDataFrame([(line,)], "value string"), mode)
        assert [tuple(r)[:2] for r in got.collect()] == [edge] and got.where(F.col("weight") == 1.0).count() == 1
