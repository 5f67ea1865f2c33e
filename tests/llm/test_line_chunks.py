import random
import re

import pytest
import xxhash

from graphtables.llm import line_chunks as lc
from graphtables.llm.catalog import op10_line_chunks
from tests.llm.samples import awkward_texts, bag, frame


def plain_chunks(text):
    lines = text.split("\n")
    h = [(x - (1 << 64) if x >> 63 else x) % lc.MODULUS for x in (xxhash.xxh64_intdigest(s.encode(), 42) for s in lines)]
    out, current = [], []
    for i, line in enumerate(lines):
        current.append(line)
        rolled = 0
        for j in range(i - lc.WINDOW + 1, i + 1):
            rolled = (rolled * lc.BASE + (h[j] if j >= 0 else 0)) % lc.MODULUS
        if rolled % lc.DIVISOR == 0 or i == len(lines) - 1:
            out.append(current)
            current = []
    return out


def plain(rows):
    """(id, text, removed) of each; of rows that tie in the order, all but one lose their copies."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out.append((i, None, 0))
            continue
        kept, gone = [], 0
        for c in plain_chunks(t):
            text = "\n".join(c)
            if len(c) >= 2 and text in seen:
                gone += 1
                continue
            if len(c) >= 2:
                seen.add(text)
            kept.append(text)
        out.append((i, "\n".join(kept), gone))
    return out


def rows():
    rng = random.Random(3)
    passage = "\n".join(f"shared line {rng.randint(0, 9999)} of the passage" for _ in range(25))
    own = [(700 + i, f"own {i}\n" * (i % 3) + f"intro {i}\n" + passage + f"\noutro {i}\nlast {i}") for i in range(12)]
    return awkward_texts() + own + [(800, passage + "\n" + passage)]


@pytest.mark.parametrize("broadcast_rows", [lc.BROADCAST_ROWS, 0])
def test_removals_by_brute_force(spark, scratch, broadcast_rows):
    frame(spark, rows()).write.parquet(f"{scratch}/docs")
    docs = spark.read.parquet(f"{scratch}/docs")
    cleaned = lc.remove_repeated(docs, broadcast_rows=broadcast_rows)
    assert cleaned.columns == [*docs.columns, "n_removed"]
    got = [(r.doc_id, r.text, r.n_removed) for r in cleaned.collect()]
    expected = plain(rows())
    assert bag(got) == bag(expected)
    assert sum(n > 0 for *_, n in expected) > 10


def test_a_shifted_passage_is_cut_alike():
    passage = [f"line {i * 7919 % 1000}" for i in range(60)]
    a = {tuple(c) for c in plain_chunks("\n".join(passage))}
    b = {tuple(c) for c in plain_chunks("\n".join(["new first", *passage, "new last"]))}
    assert len(a & b) >= len(a) - 3


def test_different_chunks_of_equal_hash_stay(spark, monkeypatch):
    """With a hash that is equal for all chunks, bytes alone decide."""
    docs = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (3, "e\nf\ng\nh")]
    monkeypatch.setattr(lc.F, "xxhash64", lambda *c: lc.F.lit(1).cast("long"))
    got = lc.remove_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert bag((r.doc_id, r.text, r.n_removed) for r in got) == [(1, "a\nb\nc\nd", 0), (2, "", 1), (3, "e\nf\ng\nh", 0)]


def test_different_runs_of_equal_hash_stay(spark, monkeypatch):
    """With one hash for all units, bytes alone decide, broadcast or shuffled."""
    docs = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (3, "e\nf\ng\nh"), (4, "x\n" + "w " * 12), (5, "y\n" + "w " * 12)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(lc.F, "xxhash64", lambda *c: lc.F.lit(1).cast("long"))
    for rows in (lc.BROADCAST_ROWS, 0):
        got = lc.remove_runs(table, broadcast_rows=rows).collect()
        assert bag((r.doc_id, r.text, r.n_removed) for r in got) == bag(
            [(1, docs[0][1], 0), (2, "", 4), (3, docs[2][1], 0), (4, docs[3][1], 0), (5, "y", 1)])


def test_units_hash_by_all_bits(spark):
    """Lines that are equal modulo the rolling hash's prime, as some of many lines are, do not clash as units."""
    lines = spark.range(200_000).select(lc.F.concat_ws(" ", *[lc.F.col("id").cast("string")] * lc.RUN_WORDS).alias("line"))
    reduced = lines.select("line", lc.F.get(lc._hashed(lc.F.array("line")), lc.F.lit(0)).alias("h"))
    equal = reduced.groupBy("h").agg(lc.F.collect_list("line").alias("lines")).where("size(lines) > 1").select(
        lc.F.explode("lines").alias("line"))
    n, distinct = equal.select(lc.F.explode(lc.units(lc.F.col("line"), False)).alias("u")).agg(
        lc.F.count(lc.F.lit(1)), lc.F.count_distinct("u.hash")).first()
    assert n == distinct >= 2


@pytest.mark.parametrize("remove", [lc.remove_runs, lc.remove_repeated])
def test_results_do_not_follow_the_file_splits(spark, scratch, remove):
    """Built under one split size, run under another."""
    frame(spark, rows() * 3).repartition(2).write.option("parquet.block.size", 4096).parquet(f"{scratch}/docs")
    docs = spark.read.parquet(f"{scratch}/docs")
    expected = bag(tuple(r) for r in remove(docs).collect())
    cleaned = remove(docs)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert bag(tuple(r) for r in cleaned.collect()) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r.n_removed > 0 for r in cleaned.collect()) > 30


def test_name_clash_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb", 9)], "doc_id long, text string, n_removed int")
    assert lc.remove_repeated(docs).columns == ["doc_id", "text", "n_removed", "n_removed_"]
    assert lc.remove_repeated(frame(spark, [])).collect() == []


def plain_runs(rows):
    """As ``plain``, of :func:`line_chunks.remove_runs`; third, the number of lines removed."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out.append((i, None, 0))
            continue
        lines, at, units = t.split("\n"), 0, []
        for c in plain_chunks(t):
            units += [(at, len(c), True)] * (len(c) >= 2)
            at += len(c)
        units += [(k, 2, False) for k in range(len(lines) - 1)]
        units += [(k, 1, False) for k, x in enumerate(lines) if len(words(x)) >= lc.RUN_WORDS]
        again, of_chunk = set(), set()
        for k, n, chunk in sorted(units):
            key = (chunk, tuple(lines[k:k + n]))
            if key in seen:
                again |= set(range(k, k + n))
                of_chunk |= set(range(k, k + n)) if chunk else set()
            seen.add(key)
        gone, run = set(), []
        for k in range(len(lines) + 1):
            if k in again:
                run.append(k)
                continue
            if of_chunk & set(run) or sum(len(words(lines[x])) for x in run) >= lc.RUN_WORDS:
                gone |= set(run)
            run = []
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def words(line):
    return re.findall("[^\x20\x09-\x0D]+", line)


@pytest.mark.parametrize("broadcast_rows", [lc.BROADCAST_ROWS, 0])
def test_runs_by_brute_force(spark, scratch, broadcast_rows):
    frame(spark, rows()).write.parquet(f"{scratch}/docs")
    docs = spark.read.parquet(f"{scratch}/docs")
    cleaned = lc.remove_runs(docs, broadcast_rows=broadcast_rows)
    assert cleaned.columns == [*docs.columns, "n_removed"]
    expected = plain_runs(rows())
    assert bag((r.doc_id, r.text, r.n_removed) for r in cleaned.collect()) == bag(expected)
    for (_, a, _), (_, b, _) in zip(expected, plain(rows())):
        assert a is None or len(a) <= len(b)            # whatever chunks remove, runs remove
    assert lc.remove_runs(frame(spark, [])).collect() == []


def test_op10_removes_whole_shared_passages(spark, scratch):
    """Passages of six lines, most of them without a whole inner chunk, and a long line alone."""
    docs, own = [], {}
    for p in range(20):
        passage = [f"passage {p} line {k} has a few more words" for k in range(6)]
        for copy in range(2):
            i = 2 * p + copy
            head, tail = f"head {i}", f"tail {i}"
            docs.append((i, "\n".join([head, *passage, tail])))
            own[i] = docs[-1][1] if copy == 0 else f"{head}\n{tail}"
    alone = "one line alone of more than ten words that two texts share"
    docs += [(100, f"before\n{alone}\nafter"), (101, f"other\n{alone}\nrest"), (102, "short line\nx"), (103, "short line\ny")]
    own |= {100: docs[-4][1], 101: "other\nrest", 102: docs[-2][1], 103: docs[-1][1]}
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_chars) for r in op10_line_chunks(spark, scratch).collect()}
    assert got == {i: (t.count("\n") - own[i].count("\n"), len(own[i])) for i, t in docs}
