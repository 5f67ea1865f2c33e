"""Edge files arriving in a folder, appended as a parquet edge table."""

import os
import subprocess
import sys

from graphtables.streaming import append_edges, read_edge_stream
from tests.conftest import ROOT


def test_stream_two_rounds(spark, scratch):
    src = os.path.join(scratch, "in")
    out = os.path.join(scratch, "out")
    ck = os.path.join(scratch, "ck")
    os.makedirs(src)
    with open(os.path.join(src, "a.tsv"), "w") as f:
        f.write("# first\n1\t2\n2\t3\t9\n")
    q = append_edges(read_edge_stream(spark, src), out, checkpoint=ck)
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 2, 1.0), (2, 3, 1.0)]

    with open(os.path.join(src, "b.tsv"), "w") as f:
        f.write("3\t1\n#\n")
    q = append_edges(read_edge_stream(spark, src), out, checkpoint=ck)
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)]


_RUN = """
import sys
sys.path.insert(0, {root!r})
from graphtables.session import local_session
from graphtables.streaming import append_edges, read_edge_stream
spark = local_session(2, 2, extra={{"spark.checkpoint.dir": {ck!r}}})
append_edges(read_edge_stream(spark, {src!r}), {out!r}).awaitTermination(120)
"""


def test_a_new_application_goes_on_where_the_last_stopped(spark, scratch):
    """Two processes, the default progress folder: the second adds exactly the new file's edges."""
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "t", "edges")
    os.makedirs(src)
    code = _RUN.format(root=ROOT, ck=os.path.join(scratch, "ck"), src=src, out=out)
    for name, text, want in (("a.tsv", "1\t2\n2\t3\n", [(1, 2), (2, 3)]), ("b.tsv", "3\t1\n", [(1, 2), (2, 3), (3, 1)])):
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
        subprocess.run([sys.executable, "-c", code], check=True, timeout=240, capture_output=True)
        assert sorted((r["src_id"], r["dst_id"]) for r in spark.read.parquet(out).collect()) == want


def test_tables_of_one_base_name_have_their_own_progress(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.tsv"), "w") as f:
        f.write("5\t6\n")
    for parent in ("x", "y"):
        out = os.path.join(scratch, parent, "edges")
        append_edges(read_edge_stream(spark, src), out).awaitTermination(120)
        assert spark.read.parquet(out).count() == 1
