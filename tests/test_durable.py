"""The loop that a new application continues."""

import json
import os
import shutil

import pytest

from graphtables.plans.durable import DurableRankLoop, edge_fingerprint
from graphtables.plans.loop import RankLoop
from graphtables.session import children
from tests.test_stored import python

EDGES = "src_id long, dst_id long, weight double"


def _edges(spark, n=400):
    return spark.createDataFrame([(i * i % 37, i * 5 % 53, 1.0) for i in range(n)], EDGES)


def _ranks(df):
    return {r["id"]: round(r["rank"], 9) for r in df.collect()}


def _unbroken(edges, rounds, **options):
    return _ranks(RankLoop(edges, **options).run(rounds))


VARIANTS = [dict(missing="retain", partitions=3), dict(init="incidence", missing="drop", partitions=2),
            dict(contribution="source_id", missing="retain", partitions=2), dict(missing="drop", partitions=20)]


@pytest.mark.parametrize("options", VARIANTS)
def test_continued_rounds_equal_an_unbroken_run(spark, scratch, options):
    """``partitions=20``: many sources are hot and stored apart."""
    state, edges = f"{scratch}/state", _edges(spark)
    DurableRankLoop(spark, state, edges, **options).run(2)
    later = DurableRankLoop(spark, state)               # knows the folder alone
    got = _ranks(later.run(5))
    assert got == _unbroken(edges, 5, **options)
    assert later.started_at == 2 and [r[0] for r in later.timer.records] == [f"iteration {i}" for i in (3, 4, 5)]
    assert (later.num_hot > 0) == (options["partitions"] == 20)
    assert later.finished_rounds() == [1, 2, 3, 4, 5] and children(spark, f"{state}/ranks") == ["4", "5"]
    assert _ranks(DurableRankLoop(spark, state).run(4)) == _unbroken(edges, 4, **options)      # still kept
    with pytest.raises(FileNotFoundError):
        later.run(2)
    later.discard_state()
    assert not os.path.exists(state)


def test_two_applications(spark, scratch):
    """The first process dies in its third round, after the ranks are written and before the round is finished."""
    body = f"""
        import graphtables.plans.durable as durable
        from graphtables.plans.durable import DurableRankLoop
        edges = spark.createDataFrame([(i * i % 37, i * 5 % 53, 1.0) for i in range(400)], "src_id long, dst_id long, weight double")
        state = {scratch!r} + "/state"
        """
    out, code, err = python(scratch, body + """
        import os
        whole = durable.write_text
        def dying(spark, path, text):
            if path.endswith("rounds/3"):
                os._exit(7)
            whole(spark, path, text)
        durable.write_text = dying
        DurableRankLoop(spark, state, edges, missing="retain").run(6)
        """)
    assert code == 7, err
    assert sorted(os.listdir(f"{scratch}/state/rounds")) != [] and not os.path.exists(f"{scratch}/state/rounds/3")
    assert os.path.exists(f"{scratch}/state/ranks/3/layout")
    out, code, err = python(scratch, body + """
        loop = DurableRankLoop(spark, state, edges, missing="retain")
        ranks = {r["id"]: r["rank"] for r in loop.run(6).collect()}
        import json
        print(json.dumps([loop.started_at, ranks]))
        """)
    assert code == 0, err
    started, ranks = json.loads(out)
    assert started in (2, 3)
    assert {int(i): round(r, 9) for i, r in ranks.items()} == _unbroken(_edges(spark), 6, missing="retain")


def test_a_half_written_round_is_done_again(spark, scratch):
    state, edges = f"{scratch}/state", _edges(spark)
    DurableRankLoop(spark, state, edges, partitions=3).run(2)
    os.remove(f"{state}/rounds/2")
    os.remove(f"{state}/ranks/2/layout")
    for name in os.listdir(f"{state}/ranks/2/data")[:2]:
        os.remove(f"{state}/ranks/2/data/{name}")
    loop = DurableRankLoop(spark, state)
    assert _ranks(loop.run(3)) == _unbroken(edges, 3) and loop.started_at == 1


def test_a_layout_without_its_manifest_is_built_again(spark, scratch):
    state, edges = f"{scratch}/state", _edges(spark)
    DurableRankLoop(spark, state, edges, partitions=3).run(1)
    os.remove(f"{state}/manifest")
    shutil.copytree(f"{state}/edges", f"{state}/hot_edges")
    shutil.rmtree(f"{state}/rounds")
    assert _ranks(DurableRankLoop(spark, state, edges, partitions=3).run(2)) == _unbroken(edges, 2)


def test_other_edges_or_parameters_are_refused(spark, scratch):
    state, edges = f"{scratch}/state", _edges(spark)
    DurableRankLoop(spark, state, edges, partitions=2).run(1)
    assert DurableRankLoop(spark, state, edges.repartition(5).orderBy("dst_id")).finished_rounds() == [1]
    with pytest.raises(ValueError, match="rows: 400 in the state, 399 now"):
        DurableRankLoop(spark, state, _edges(spark, 399))
    with pytest.raises(ValueError, match="damping"):
        DurableRankLoop(spark, state, edges, damping=0.5)
    with pytest.raises(FileNotFoundError):
        DurableRankLoop(spark, f"{scratch}/elsewhere")


def test_fingerprint_counts_repeated_rows(spark):
    rows = [(1, 2, 1.0), (3, 4, 1.0)]
    one = edge_fingerprint(spark.createDataFrame(rows, EDGES))
    assert one == edge_fingerprint(spark.createDataFrame(rows[::-1], EDGES))
    assert one != edge_fingerprint(spark.createDataFrame(rows + rows, EDGES))
    assert edge_fingerprint(spark.createDataFrame([], EDGES)) == {"rows": 0, "hash": "0"}


def test_empty_edges_and_no_rounds(spark, scratch):
    none = spark.createDataFrame([], EDGES)
    assert DurableRankLoop(spark, f"{scratch}/a", none, missing="retain", partitions=2).run(2).collect() == []
    loop = DurableRankLoop(spark, f"{scratch}/b", _edges(spark), partitions=2)
    assert set(_ranks(loop.run(0)).values()) == {1.0} and loop.finished_rounds() == []


def test_a_round_shuffles_once_and_counts_as_it_writes(spark, scratch):
    """The stored tables join without an exchange; a stage is one write and no count of its own."""
    from graphtables.plans.inspect import shuffle_exchanges
    from graphtables.plans.loop import _session_conf
    from graphtables.sources.stored import open_stored

    state, edges = f"{scratch}/state", _edges(spark)
    loop = DurableRankLoop(spark, state, edges, missing="retain", partitions=3)
    loop.run(1)
    with _session_conf(spark, loop._conf()):
        step = loop._step(open_stored(spark, f"{state}/ranks/1"))
        step.collect()
        assert len(shuffle_exchanges(step)) == 1
    sc = spark.sparkContext
    sc.setJobGroup("durable-round", "")
    try:
        loop.run(2)
        jobs = sc.statusTracker().getJobIdsForGroup("durable-round")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    vertices = {v for r in edges.collect() for v in (r["src_id"], r["dst_id"])}
    assert loop.timer.records[-1][:2] == ("iteration 2", len(vertices))
    assert [(r["round"], r["rows"]) for r in loop.rounds().collect()] == [(1, len(vertices)), (2, len(vertices))]
    # the write, and one look at the schema of the hot ids at most
    assert len(jobs) <= 2
