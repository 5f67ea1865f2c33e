"""Toy graphs F1-F4 with hand-checkable ranks, through the lazy form and the loop."""

import pytest
from pyspark.sql import functions as F

from graphtables.operators.rank import rank
from graphtables.plans.loop import RankLoop
from graphtables.sources.edges import edges_from

F1 = [(1, 2), (2, 3), (3, 1), (1, 2), (3, 3), (4, 1), (3, 5)]
F2 = [(1, 2), (2, 3), (3, 4)]
F3 = [(10, 1), (11, 1), (12, 1)]
F4 = [(7, 7)]

VARIANTS = {
    "R5": dict(init="incidence", missing="drop"),
    "R6": dict(init="unique", missing="drop"),
    "R7": dict(contribution="source_id", missing="retain"),
    "R8": dict(init="unique", missing="retain"),
}

GOLDEN = [
    (F1, "R5", 1, {1: 4.4, 2: 5.25, 3: 5.25, 5: 3.55}),
    (F1, "R5", 2, {1: 4.6125, 2: 7.63, 3: 9.075, 5: 4.6125}),
    (F1, "R5", 3, {1: 7.86375, 2: 7.99125, 3: 14.34925, 5: 7.86375}),
    (F1, "R6", 1, {1: 1.85, 2: 1.85, 3: 1.85, 5: 1.0}),
    (F1, "R6", 2, {1: 1.7225, 2: 3.295, 3: 3.295, 5: 1.7225}),
    (F1, "R6", 3, {1: 2.95075, 2: 3.07825, 3: 5.7515, 5: 2.95075}),
    (F1, "R8", 1, {1: 1.85, 2: 1.85, 3: 1.85, 4: 0.15, 5: 1.0}),
    (F1, "R8", 2, {1: 1.85, 2: 3.295, 3: 3.295, 4: 0.15, 5: 1.7225}),
    (F1, "R8", 3, {1: 3.07825, 2: 3.295, 3: 5.7515, 4: 0.15, 5: 2.95075}),
    (F1, "R7", 1, {1: 6.1, 2: 1.85, 3: 4.4, 4: 0.15, 5: 2.7}),
    (F1, "R7", 3, {1: 6.1, 2: 1.85, 3: 4.4, 4: 0.15, 5: 2.7}),
    (F2, "R5", 1, {2: 1.0, 3: 1.85, 4: 1.85}),
    (F2, "R5", 2, {3: 1.0, 4: 1.7225}),
    (F2, "R5", 3, {4: 1.0}),
    (F2, "R5", 4, {}),
    (F2, "R6", 1, {2: 1.0, 3: 1.0, 4: 1.0}),
    (F2, "R6", 2, {3: 1.0, 4: 1.0}),
    (F2, "R6", 3, {4: 1.0}),
    (F2, "R6", 4, {}),
    (F2, "R8", 1, {1: 0.15, 2: 1.0, 3: 1.0, 4: 1.0}),
    (F2, "R8", 2, {1: 0.15, 2: 0.2775, 3: 1.0, 4: 1.0}),
    (F2, "R8", 3, {1: 0.15, 2: 0.2775, 3: 0.385875, 4: 1.0}),
    (F2, "R8", 4, {1: 0.15, 2: 0.2775, 3: 0.385875, 4: 0.477994}),
    (F2, "R7", 2, {1: 0.15, 2: 1.0, 3: 1.85, 4: 2.7}),
    (F3, "R5", 1, {1: 2.7}),
    (F3, "R6", 1, {1: 2.7}),
    (F3, "R5", 2, {}),
    (F3, "R6", 2, {}),
    (F3, "R8", 1, {1: 2.7, 10: 0.15, 11: 0.15, 12: 0.15}),
    (F3, "R8", 2, {1: 0.5325, 10: 0.15, 11: 0.15, 12: 0.15}),
    (F3, "R7", 1, {1: 28.2, 10: 0.15, 11: 0.15, 12: 0.15}),
    (F4, "R5", 3, {7: 1.0}),
    (F4, "R6", 3, {7: 1.0}),
    (F4, "R8", 3, {7: 1.0}),
    (F4, "R7", 2, {7: 6.1}),
]


def _edges(spark, pairs):
    return edges_from(spark.createDataFrame(pairs, "src_id long, dst_id long"))


def _as_dict(df):
    return {r["id"]: round(r["rank"], 6) for r in df.collect()}


@pytest.mark.parametrize("graph,variant,k,expected", GOLDEN)
def test_lazy(spark, graph, variant, k, expected):
    assert _as_dict(rank(_edges(spark, graph), k, **VARIANTS[variant])) == expected


@pytest.mark.parametrize("graph,variant,k,expected", GOLDEN)
@pytest.mark.parametrize("hot", [None, 1])
def test_loop(spark, graph, variant, k, expected, hot):
    loop = RankLoop(_edges(spark, graph), hot_threshold=hot, partitions=3, checkpoint_every=2,
                    **VARIANTS[variant])
    out = loop.run(k)
    try:
        assert _as_dict(out) == expected
    finally:
        out.unpersist()


def test_round_zero_tables(spark):
    e = _edges(spark, F1)
    r5 = rank(e, 0, **VARIANTS["R5"]).groupBy("id").agg(F.count("*").alias("n"), F.max("rank").alias("r"))
    assert {r["id"]: (r["n"], r["r"]) for r in r5.collect()} == {
        1: (3, 1.0), 2: (2, 1.0), 3: (4, 1.0), 4: (1, 1.0), 5: (1, 1.0)}
    for v in ("R6", "R7", "R8"):
        assert _as_dict(rank(e, 0, **VARIANTS[v])) == {i: 1.0 for i in range(1, 6)}
    assert rank(_edges(spark, F4), 0, init="incidence").count() == 1


def test_empty_graph(spark):
    e = _edges(spark, [])
    for v in VARIANTS.values():
        assert rank(e, 2, **v).count() == 0
        assert rank(e, 0, **v).count() == 0
