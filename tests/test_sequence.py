"""Successor pairs vs. brute force, including empty and group-spanning slices."""

import random

import pandas as pd
import pytest

from graphtables.operators.sequence import successor_pairs


def _brute(rows):
    df = pd.DataFrame(rows, columns=["g", "t", "u", "v"])
    df = df.sort_values(["g", "t", "u"], na_position="first")
    out = []
    for _, grp in df.groupby("g", dropna=False, sort=False):
        vals = list(grp["v"])
        out += list(zip(vals[:-1], vals[1:]))
    return [(None if pd.isna(a) else int(a), None if pd.isna(b) else int(b)) for a, b in out]


@pytest.mark.parametrize("n_parts", [1, 3, 16, 64])
def test_against_brute_force(spark, n_parts):
    rnd = random.Random(n_parts)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.randrange(50), i,
             rnd.choice([rnd.randrange(10), None]) if i % 17 == 0 else rnd.randrange(10))
            for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t long, u long, v long")
    got = successor_pairs(df, "g", ["t", "u"], "v", partitions=n_parts).collect()
    norm = [(r["value"], r["next_value"]) for r in got]
    key = lambda p: tuple((x is None, x or 0) for x in p)
    assert sorted(norm, key=key) == sorted(_brute(rows), key=key)


def test_one_hot_group(spark):
    # one group holds almost every row: the work still spreads over all slices
    rows = [("hot", i, i, i % 7) for i in range(3000)] + [("x", 0, 0, 1), ("x", 1, 1, 2)]
    df = spark.createDataFrame(rows, "g string, t long, u long, v long")
    pairs = successor_pairs(df, "g", ["t", "u"], "v", partitions=8)
    assert pairs.count() == 2999 + 1


from hypothesis import given, settings, strategies as st  # noqa: E402

rows_st = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 5),
                             st.one_of(st.none(), st.integers(0, 9))), max_size=40)


@settings(max_examples=12, deadline=None)
@given(rows_st, st.integers(1, 12))
def test_successor_pairs_property(spark, raw, n_parts):
    rows = [(g, t, i, v) for i, (g, t, v) in enumerate(raw)]
    df = spark.createDataFrame(rows, "g string, t long, u long, v long")
    got = [(r["value"], r["next_value"]) for r in
           successor_pairs(df, "g", ["t", "u"], "v", partitions=n_parts).collect()]
    key = lambda p: tuple((x is None, x or 0) for x in p)
    assert sorted(got, key=key) == sorted(_brute(rows), key=key) if rows else got == []


def test_large_ids_with_nulls_stay_exact(spark):
    big = 2 ** 62
    rows = [(7, 1, 1, big + 1), (7, 2, 2, None), (7, 3, 3, big + 3), (8, 1, 4, big + 5),
            (None, 1, 5, big + 7), (None, 2, 6, big + 9), (big + 11, 1, 7, 1), (big + 13, 1, 8, 2)]
    df = spark.createDataFrame(rows, "g long, t long, u long, v long")
    got = sorted(((r["value"], r["next_value"]) for r in
                  successor_pairs(df, "g", ["t", "u"], "v", partitions=3).collect()),
                 key=lambda p: tuple((x is None, x or 0) for x in p))
    want = sorted([(big + 1, None), (None, big + 3), (big + 7, big + 9)],
                  key=lambda p: tuple((x is None, x or 0) for x in p))
    assert got == want


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_pairs_do_not_depend_on_exchange_reuse(spark, reuse, adaptive):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from graphtables.sources.tables import table
    from tests.conftest import SF_ORACLE

    ev = table(spark, SF_ORACLE, "events")
    settings = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = successor_pairs(ev, "event_type", ["ts", "event_id"], "user_id", 16)
        lead = F.lead("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
        n = F.lead("event_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
        want = ev.select(F.col("user_id").alias("value"), lead.alias("next_value"), n.alias("n")).where("n is not null").drop("n")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
