"""Dense vertex numbers, bitmaps of ids, and generated rows."""

import random

import pytest

from graphtables.operators import bitmaps, generate, numbering
from graphtables.operators.graph import endpoints
from graphtables.operators.rank import rank
from graphtables.plans.inspect import plan_text, shuffle_exchanges

EDGES = "src_id long, dst_id long, weight double"
IDS = [0, 1, 2, 199, 200, 201, 400, -1, -200, -201, 10 ** 15, 10 ** 15 + 7, -(10 ** 12), 32768, 32769, 65536, -32768, -32769]


def _ids(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_slots_are_dense_and_ordered(spark, parts):
    got = {r["id"]: r["slot"] for r in numbering.vertex_slots(_ids(spark, [*IDS, None]), parts).collect()}
    assert got == {i: k for k, i in enumerate(sorted(IDS, key=lambda i: (i % parts, i)))}
    hashed = numbering.vertex_slots(_ids(spark, IDS), parts, by="hash").collect()
    assert sorted(r["slot"] for r in hashed) == list(range(len(IDS))) and {r["id"] for r in hashed} == set(IDS)


def test_no_task_sees_all_ids(spark):
    """The only window without a key orders the parts' counts."""
    plan = plan_text(numbering.vertex_slots(spark.range(1000), 50), "formatted")
    assert plan.count("SinglePartition") == 1
    ranked = numbering.vertex_slots(spark.range(1000).repartition(3), 50)
    assert [r["slot"] for r in ranked.orderBy("slot").collect()] == list(range(1000))


def test_no_ids(spark):
    assert numbering.vertex_slots(_ids(spark, []), 5).collect() == []
    with pytest.raises(ValueError):
        numbering.vertex_slots(_ids(spark, [1]), 5, by="range")


def test_ranks_do_not_depend_on_the_numbers(spark):
    rng = random.Random(2)
    rows = [(rng.choice(IDS), rng.choice(IDS), 1.0) for _ in range(200)]
    e = spark.createDataFrame(rows, EDGES)
    used = sorted({x for r in rows for x in r[:2]})
    slots = numbering.vertex_slots(_ids(spark, used), 4)
    dense = numbering.slot_edges(e, slots)
    back = {r["slot"]: r["id"] for r in slots.collect()}
    got = {back[r["id"]]: round(r["rank"], 9) for r in rank(dense, 2, missing="retain").collect()}
    assert got == {r["id"]: round(r["rank"], 9) for r in rank(e, 2, missing="retain").collect()}


def test_bitmaps(spark):
    a, b = IDS + IDS[:4] + [None], IDS[::2] + [5, 6, 10 ** 15 + 7]
    x, y = bitmaps.id_bitmap(_ids(spark, a)), bitmaps.id_bitmap(_ids(spark, b))

    def ids(set_):
        found = [r["id"] for r in bitmaps.bitmap_ids(set_).collect()]
        assert len(found) == len(set(found)) == bitmaps.bitmap_size(set_).first()["n"]
        return set(found)

    assert ids(x) == set(IDS) and ids(y) == set(b)
    assert ids(bitmaps.bitmap_union(x, y)) == set(IDS) | set(b)
    assert ids(bitmaps.bitmap_intersection(x, y)) == set(IDS) & set(b)
    assert ids(bitmaps.bitmap_intersection(x, bitmaps.id_bitmap(_ids(spark, [3, 777])))) == set()
    none = bitmaps.id_bitmap(_ids(spark, []))
    assert ids(bitmaps.bitmap_union(none, none)) == set() and bitmaps.bitmap_size(none).first()["n"] == 0


def test_bitmaps_shuffle_buckets_not_ids(spark):
    a = bitmaps.id_bitmap(spark.range(100_000))
    size = bitmaps.bitmap_size(bitmaps.bitmap_union(a, bitmaps.id_bitmap(spark.range(50_000, 150_000))))
    assert size.first()["n"] == 150_000
    found = shuffle_exchanges(size)
    assert found and not any("hashpartitioning(id" in x for x in found)
    assert all("groupingexpression" in x or "bucket" in x or "SinglePartition" in x for x in found), found


def test_rows_of_a_function(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (3, 3, 2.0), (1, 2, 1.0), (4, None, None)], EDGES)
    got, expected = generate.endpoints_by_function(e), endpoints(e)
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))

    def steps(src, dst):
        for k in range(src, dst or 0):
            yield k, f"{k}!"

    made = generate.generate_rows(e.withColumnRenamed("weight", "id"), steps, ["src_id", "dst_id"], "at bigint, name string")
    assert sorted(map(tuple, made.collect())) == [(1, 2, 1.0, 1, "1!"), (1, 2, 1.0, 1, "1!")]
    assert generate.generate_rows(e.limit(0), steps, ["src_id", "dst_id"], "at bigint, name string").collect() == []
