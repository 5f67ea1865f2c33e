import re

import numpy as np
import pytest
import xxhash

from graphtables.llm import catalog, simhash
from tests.llm.samples import awkward_texts, bag, frame


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and 2 * n[b] > len(shingles))


def plain_components(fps, distance=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_near_duplicates_by_brute_force(spark):
    rows = awkward_texts()
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    expected = [(i, signed(f), least.get(roots[f])) for (i, _), f in zip(rows, fps)]
    got = [tuple(r) for r in simhash.near_duplicates(frame(spark)).collect()]
    assert bag(got) == bag(expected)


@pytest.mark.parametrize("distance,large", [(1, 2000), (3, 2000), (4, 2000), (6, 2000), (4, 0), (4, 3), (3, 1), (5, 0)])
def test_links_are_all_pairs_once(spark, distance, large):
    """With ``large`` small, many or all keys are refined."""
    rng = np.random.default_rng(distance)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = set(base)
    for f in base:
        for _ in range(12):
            g = f
            for b in rng.integers(0, 64, rng.integers(1, 9)):
                g ^= 1 << int(b)
            fps.add(g)
    fps = sorted(signed(f) for f in fps)
    table = spark.createDataFrame([(f,) for f in fps + fps[:5]], "fp long")
    got = [tuple(r) for r in simhash.links(table, distance, large).collect()]
    expected = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:]
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
    assert bag(got) == bag(expected) and len(expected) > 10


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 201)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 160)}, 200: 200, 201: 200}


def test_keep_one_leaves_a_row_of_each_component(spark, scratch):
    frame(spark).write.parquet(f"{scratch}/docs")
    docs = spark.read.parquet(f"{scratch}/docs")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = awkward_texts()
    roots = plain_components([plain_fingerprint(t) for _, t in rows])
    assert bag(roots[plain_fingerprint(r.text)] for r in kept.collect()) == bag(set(roots.values()))


def test_keep_one_does_not_follow_the_file_splits(spark, scratch):
    """Built under one split size, run under another."""
    frame(spark, awkward_texts() * 3).repartition(2).write.option("parquet.block.size", 4096).parquet(f"{scratch}/docs")
    docs = spark.read.parquet(f"{scratch}/docs")
    n = simhash.keep_one(docs).count()
    kept = simhash.keep_one(docs)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert kept.count() == n < docs.count() / 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_keys_are_spread_before_they_are_made(spark):
    """The exchange before the explode is one of its own."""
    table = spark.createDataFrame([(f,) for f in range(200)], "fp long")
    plan = simhash.links(table)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_op1_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    roots, least = plain_components(fps.values()), {}
    for i in sorted(fps):
        least.setdefault(roots[fps[i]], i)
    got = [tuple(r) for r in catalog.op1_simhash_variants(spark, "/root/testdata/sf0.001").collect()]
    assert bag(got) == bag((i, f"{f:016x}", least[roots[f]]) for i, f in fps.items())


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert simhash.keep_one(frame(spark, [])).collect() == []
