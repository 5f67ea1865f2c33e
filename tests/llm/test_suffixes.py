import hashlib
import random

import numpy as np
import pytest

from graphtables.llm import catalog, suffixes
from tests.llm.samples import awkward_texts, bag, frame


def plain_spans(rows, depth=100):
    """Each string of ``depth`` bytes against a set of all that start earlier."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data) + 1)
        for s in range(len(data) - depth + 1):
            window = data[s:s + depth]
            if window in seen:
                gone[s:s + depth] = b"\1" * depth
            seen.add(window)
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            spans.append((a, at))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), tuple(spans), kept))
    return out


def ordered(rows, ties=True):
    def tie(text):
        return int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "big", signed=True)

    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie(r[1]) if ties else 0))


def run(spark, rows, **sizes):
    got = suffixes.remove_repeats(frame(spark, rows), **sizes).collect()
    return [(r.id, r.n_bytes, tuple((s.begin, s.end) for s in r.spans), bytes(r.kept)) for r in got]


def shared_rows(seed=1, n=60):
    rng = random.Random(seed)

    def words(k):
        return " ".join("".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(2, 7))) for _ in range(k))

    passages = [words(rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [words(rng.randint(0, 50)) for _ in range(rng.randint(1, 4))]
        parts += rng.choices(passages, k=rng.randint(0, 2))
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    near = rows[3][1] + words(80)
    rows += [(n + k, near[:40 * k] + "#" + near[40 * k:]) for k in range(12)]
    rows += [(200, "ab" * 700), (201, "ab" * 130), (202, "a" * 3000), (203, "b" * 99), (204, "b" * 100), (205, "b" * 100)]
    rng.shuffle(rows)
    return rows


SIZES = [{}, {"run_bytes": 3000}, {"run_bytes": 3000, "large": 1}, {"run_bytes": 1500, "large": 3, "group_digits": 50, "group_strips": 5}]


@pytest.mark.parametrize("sizes", SIZES)
def test_spans_by_brute_force(spark, sizes):
    """One run a task; many runs; every first digit hot; some hot and many groups."""
    rows = shared_rows()
    assert bag(run(spark, rows, **sizes)) == bag(plain_spans(ordered(rows)))


@pytest.mark.parametrize("sizes", SIZES[:1] + SIZES[2:3])
def test_awkward_rows(spark, sizes):
    """Nulls, empty and long texts, repeated rows, and different texts of one id."""
    rows = awkward_texts() + [(9, "q" * 150), (9, "r" * 50 + "q" * 130)]
    assert bag(run(spark, rows, **sizes)) == bag(plain_spans(ordered(rows)))


def test_other_depths(spark):
    rows = [(i, t[:400]) for i, t in shared_rows(2, 20)]
    for depth, gram in ((8, 4), (21, 16), (64, 64)):
        assert bag(run(spark, rows, depth=depth, gram=gram, run_bytes=2000)) == bag(plain_spans(ordered(rows), depth)), depth


def test_long_texts_are_hashed_in_parts(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 300)
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 5000, dtype=np.uint8)
    bounds = np.array([0, 0, 120, 150, 2900, 2900, 3000, 5000])
    start, n, digit = suffixes.strips(data, bounds, 100, 32)
    found = [int(a) + k for a, m in zip(start, n) for k in range(m)]
    expected = [s for a, b in zip(bounds, bounds[1:]) for s in range(a, b - 99)]
    assert found == expected
    whole, _ = suffixes.first_digits(data, 100, 32)
    assert [int(whole[s]) for s in found] == [int(x) for x in np.repeat(digit, n)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_op12_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.op12_suffix_sort(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    expected = [(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
                for i, n, spans, kept in plain_spans(ordered(rows))]
    assert bag(tuple(r) for r in got.collect()) == bag(expected)
