"""Edge-line grammar (F5) and the text file round trip."""

import os

import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from graphtables.sources.edges import (
    parse_edges,
    read_edges,
    rejected_lines,
    with_edge_partition,
    with_split_partition,
    write_edges,
)

GOOD = [
    ("1\t2", (1, 2, 1.0)),
    ("1\t2\t0.5", (1, 2, 1.0)),
    ("+1\t2", (1, 2, 1.0)),
    ("-5\t9223372036854775807", (-5, 9223372036854775807, 1.0)),
]
COMMENTS = ["# comment", "#", "#1\t2"]
BAD = [" # c", " 1\t2", "", "1\t", "1 2", "x\t2", "1\t2.5", "1\t99999999999999999999", "\t2"]


def _lines(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


@pytest.mark.parametrize("line,edge", GOOD)
def test_good_lines(spark, line, edge):
    assert [tuple(r) for r in parse_edges(_lines(spark, [line])).collect()] == [edge]


def test_comments_are_skipped(spark):
    assert parse_edges(_lines(spark, COMMENTS)).count() == 0


@pytest.mark.parametrize("line", BAD)
def test_bad_line_fails(spark, line):
    with pytest.raises((PySparkException, Py4JJavaError)):
        parse_edges(_lines(spark, ["1\t2", line])).collect()


def test_permissive_drops_and_reports(spark):
    lines = _lines(spark, [g for g, _ in GOOD] + COMMENTS + BAD)
    assert parse_edges(lines, mode="permissive").count() == len(GOOD)
    assert sorted(r["line"] for r in rejected_lines(lines).collect()) == sorted(BAD)


def test_empty_input(spark):
    assert parse_edges(_lines(spark, [])).count() == 0


def test_file_round_trip(spark, scratch):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 3, 1.0), (2, 3, 1.0)],
                                  "src_id long, dst_id long, weight double")
    path = os.path.join(scratch, "edges")
    write_edges(edges, path, header="src\tdst")
    back = read_edges(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, edges.collect()))
    raw = spark.read.text(path)
    assert raw.filter("value LIKE '#%'").count() == 1


def test_extra_field_file(spark, scratch):
    p = os.path.join(scratch, "e.tsv")
    with open(p, "w") as f:
        f.write("# header\n1\t2\t7.5\n2\t1\n")
    assert sorted(map(tuple, read_edges(spark, p).collect())) == [(1, 2, 1.0), (2, 1, 1.0)]


def test_edge_partition_columns(spark):
    lines = _lines(spark, ["1\t2", "5\t6", "-3\t1"])
    e = with_edge_partition(parse_edges(lines), 4, by="src")
    assert sorted((r["src_id"], r["edge_partition"]) for r in e.collect()) == [(-3, 1), (1, 1), (5, 1)]
    e = with_edge_partition(parse_edges(lines), 4)
    assert sorted((r["src_id"], r["edge_partition"]) for r in e.collect()) == [(-3, 3), (1, 2), (5, 2)]   # pmod(src, 2) * 2 + pmod(dst, 2)
    split = with_split_partition(lines.repartition(2))
    assert {r["edge_partition"] for r in split.collect()} <= {0, 1}


def test_edge_partition_has_no_overflow(spark):
    big = 9223372036854775807
    lines = _lines(spark, [f"{big}\t{big}", f"-{big}\t{big}"])
    e = with_edge_partition(parse_edges(lines), 7).collect()
    # a grid of 2 by 3
    assert [r["edge_partition"] for r in e] == [big % 2 * 3 + big % 3, -big % 2 * 3 + big % 3]


def test_crlf_file(spark, scratch):
    p = os.path.join(scratch, "crlf.tsv")
    with open(p, "w", newline="") as f:
        f.write("# header\r\n1\t2\r\n3\t4\r\n")
    assert sorted(map(tuple, read_edges(spark, p).collect())) == [(1, 2, 1.0), (3, 4, 1.0)]


def test_edges_from_any_table(spark):
    from graphtables.sources.edges import edges_from

    df = spark.createDataFrame([(1, 2, 3), (None, 2, 1), (4, None, 1), (5, 6, None)],
                               "a int, b int, w int")
    e = edges_from(df, "a", "b", "w")
    assert e.schema.simpleString() == "struct<src_id:bigint,dst_id:bigint,weight:double>"
    assert sorted(map(tuple, e.collect()), key=str) == [(1, 2, 3.0), (5, 6, None)]
    assert [tuple(r) for r in edges_from(df.filter("a = 1"), "a", "b").collect()] == [(1, 2, 1.0)]


def test_grammar_does_not_depend_on_ansi_mode(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        lines = _lines(spark, [g for g, _ in GOOD] + COMMENTS + BAD)
        assert parse_edges(lines, mode="permissive").count() == len(GOOD)
        for line in BAD:
            with pytest.raises((PySparkException, Py4JJavaError)):
                parse_edges(_lines(spark, [line])).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("use", [lambda e: e.count(), lambda e: e.agg({"weight": "sum"}).collect(), lambda e: e.select("dst_id").collect()])
def test_failfast_fails_whatever_is_read(spark, use):
    from graphtables.sources.edges import parse_edges

    lines = spark.createDataFrame([("1\t2",), ("bad",), ("3\tx",)], "value string")
    with pytest.raises(Exception, match="malformed edge line"):
        use(parse_edges(lines))
