"""The command line, run in this session (same code path as python -m graphtables)."""

import os

from graphtables.__main__ import main


def test_cli_runs_and_writes(spark, scratch, capsys):
    path = os.path.join(scratch, "f1.tsv")
    with open(path, "w") as f:
        f.write("# F1\n1\t2\n2\t3\n3\t1\n1\t2\n3\t3\n4\t1\n3\t5\n")
    out = os.path.join(scratch, "ranks")
    assert main(["R8", "3", path, "--output", out, "--partitions", "3"]) == 0
    text = capsys.readouterr().out
    assert "iteration 3:" in text and "build edges:" in text
    got = {r["id"]: round(r["rank"], 6) for r in spark.read.parquet(out).collect()}
    assert got == {1: 3.07825, 2: 3.295, 3: 5.7515, 4: 0.15, 5: 2.95075}


def test_cli_programs_as_written(spark, scratch, capsys):
    path = os.path.join(scratch, "f1.tsv")
    with open(path, "w") as f:
        f.write("1\t2\n2\t3\n3\t1\n1\t2\n3\t3\n4\t1\n3\t5\n")
    for program, want in [("dataframe", {1: 4.4, 2: 5.25, 3: 5.25, 5: 3.55}),
                          ("lowlevel", {1: 6.1, 2: 1.85, 3: 4.4, 4: 0.15, 5: 2.7})]:
        out = os.path.join(scratch, program)
        assert main([program, "1", path, "--output", out]) == 0
        got = {r["id"]: round(r["rank"], 6) for r in spark.read.parquet(out).collect()}
        assert got == want


def test_cli_permissive_skips_bad_lines(spark, scratch, capsys):
    path = os.path.join(scratch, "mixed.tsv")
    with open(path, "w") as f:
        f.write("1\t2\nnot an edge\n2\t3\n3\t1\n 4\t1\n")
    out = os.path.join(scratch, "r")
    assert main(["R6", "1", path, "--mode", "permissive", "--output", out]) == 0
    got = {r["id"]: round(r["rank"], 6) for r in spark.read.parquet(out).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0}


def test_cli_continues_a_stored_loop(spark, scratch, capsys):
    path, state = os.path.join(scratch, "f1.tsv"), os.path.join(scratch, "state")
    with open(path, "w") as f:
        f.write("1\t2\n2\t3\n3\t1\n1\t2\n3\t3\n4\t1\n3\t5\n")
    assert main(["R8", "2", path, "--state", state, "--partitions", "3"]) == 0
    capsys.readouterr()
    out = os.path.join(scratch, "ranks")
    assert main(["R8", "3", path, "--state", state, "--output", out]) == 0
    text = capsys.readouterr().out
    assert "iteration 3:" in text and "iteration 2:" not in text and "build edges" not in text
    got = {r["id"]: round(r["rank"], 6) for r in spark.read.parquet(out).collect()}
    assert got == {1: 3.07825, 2: 3.295, 3: 5.7515, 4: 0.15, 5: 2.95075}


def test_spark_submit_runs_both_programs(spark, scratch):
    """The documented launch command, in a process of its own."""
    import subprocess

    import pyspark

    from tests.conftest import ROOT

    path = os.path.join(scratch, "f1.tsv")
    with open(path, "w") as f:
        f.write("# F1\n1\t2\n2\t3\n3\t1\n1\t2\n3\t3\n4\t1\n3\t5\n")
    submit = os.path.join(os.path.dirname(pyspark.__file__), "bin", "spark-submit")
    for program, want, stage in [("dataframe", {1: 4.4, 2: 5.25, 3: 5.25, 5: 3.55}, "build vertices"),
                                 ("lowlevel", {1: 6.1, 2: 1.85, 3: 4.4, 4: 0.15, 5: 2.7}, "build routing tables")]:
        out = os.path.join(scratch, program)
        done = subprocess.run(
            [submit, "--master", "local[2]", "--conf", "spark.ui.enabled=false", "--conf", f"spark.checkpoint.dir={scratch}/ck",
             "--conf", "spark.sql.shuffle.partitions=4", os.path.join(ROOT, "run_rank.py"), program, "1", path, "--output", out],
            cwd=scratch, timeout=300, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr[-2000:]
        assert f"{stage}:" in done.stdout and "iteration 1:" in done.stdout
        assert {r["id"]: round(r["rank"], 6) for r in spark.read.parquet(out).collect()} == want
