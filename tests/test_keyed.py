from graphtables.operators import keyed


def _ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


def test_union_membership_lookup(spark):
    a, b = _ids(spark, [1, 2, 2, 3]), _ids(spark, [3, 4])
    assert sorted(r["id"] for r in keyed.id_union(a, b).collect()) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in keyed.id_membership(a, b).collect()) == [3]
    t = spark.createDataFrame([(1, 10.0), (3, 30.0)], "id long, value double")
    got = {r["id"]: r["value"] for r in keyed.lookup(_ids(spark, [1, 2, 3]), t, default=-1.0).collect()}
    assert got == {1: 10.0, 2: -1.0, 3: 30.0}
    got = {r["id"]: r["value"] for r in keyed.lookup(_ids(spark, [1, 2]), t).collect()}
    assert got == {1: 10.0, 2: None}


def test_merges(spark):
    old = spark.createDataFrame([(1, 5, 1), (2, 6, 2)], "key long, value long, seq long")
    new = spark.createDataFrame([(2, 1, 3), (3, 4, 4), (2, 8, 0)], "key long, value long, seq long")

    def m(how):
        out = keyed.keyed_merge(old, new, how=how, seq="seq" if how == "last" else None)
        return {r["key"]: r["value"] for r in out.collect()}

    assert m("sum") == {1: 5, 2: 15, 3: 4}
    assert m("max") == {1: 5, 2: 8, 3: 4}
    assert m("min") == {1: 5, 2: 1, 3: 4}
    assert m("bit_or") == {1: 5, 2: 6 | 1 | 8, 3: 4}
    assert m("last") == {1: 5, 2: 1, 3: 4}
