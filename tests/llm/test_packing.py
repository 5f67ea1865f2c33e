import random
import re

import pytest

from graphtables.llm import packing
from graphtables.llm.catalog import op9_best_fit_packing
from tests.llm.samples import awkward_texts, bag, frame


def plain_packed(sizes, lengths, compete):
    """The same rules by looking through all open bins and all remaining pieces."""
    bins, opened = [], []                   # [capacity, used, order of its last filling]
    out = []

    def filled(room, rest):
        total = 0
        for size in rest:                   # descending
            if size <= room:
                total, room = total + size, room - size
        return total

    for step, size in enumerate(sizes):
        fitting = [(b[0] - b[1], -b[2], k) for k, b in enumerate(bins) if b[0] - b[1] >= size]
        if fitting:
            k = min(fitting)[2]
        else:
            k = len(bins)
            holding = [x for x in sorted(lengths) if x >= size]
            best = min(holding, key=lambda x: (packing.bin_cost(x) / (size + filled(x - size, sizes[step + 1:])), x))
            opened.append(best if compete else holding[0])
            bins.append([opened[-1], 0, step])
        out.append((k, bins[k][1]))
        bins[k][1] += size
        bins[k][2] = step
    return out, opened, [min(x for x in lengths if x >= b[1]) for b in bins]


def cost(final):
    return sum(map(packing.bin_cost, final))


@pytest.mark.parametrize("seed", range(10))
def test_best_fit_by_brute_force(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample([8, 16, 24, 32, 64, 100, 300, 700], 3))
    sizes = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randint(1, 200))), reverse=True)
    joint, plain = plain_packed(sizes, lengths, True), plain_packed(sizes, lengths, False)
    bins, offsets, opened, final = packing.best_fit(sizes, lengths)
    assert (list(zip(bins, offsets)), opened, final) == (joint if cost(joint[2]) <= cost(plain[2]) else plain)


def test_a_longer_bin_than_the_smallest_wins():
    bins, _, opened, final = packing.best_fit([600] * 30)
    assert set(opened) == {2048} and cost(final) < cost(plain_packed([600] * 30, packing.LENGTHS, False)[2])
    assert max(bins) == 9


def test_a_bin_shrinks():
    """600 opens 2048 for the two pieces of 500, which then fit the first two bins more tightly."""
    bins, _, opened, final = packing.best_fit([1500, 1500, 600, 500, 500])
    assert (bins, opened, final) == ([0, 1, 2, 1, 0], [2048, 2048, 2048], [2048, 2048, 1024])


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) + 1


@pytest.mark.parametrize("shard_pieces", [packing.SHARD_PIECES, 7])
def test_every_token_is_packed_once(spark, shard_pieces):
    rows = awkward_texts()
    packed = packing.pack(frame(spark, rows), lengths=(64, 256, 1024), shard_pieces=shard_pieces).collect()
    expected = [(i, k, s, min(words(t) - s, 1024)) for i, t in rows for k, s in enumerate(range(0, words(t), 1024))]
    assert bag((r.doc_id, r.piece, r.start, r.n_tokens) for r in packed) == bag(expected)
    bins = {}
    for r in packed:
        assert r.bin_length <= r.opened_length
        bins.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.n_tokens))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), pieces in bins.items():
        end = 0
        for at, n in sorted(pieces):        # neither gaps nor overlaps
            assert at == end
            end += n
        assert length == min(x for x in (64, 256, 1024) if x >= end)


def test_op9_packs_the_tokens_of_the_library(spark, scratch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from graphtables.llm import tokens

    library = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    frame(spark).write.parquet(f"{scratch}/documents.parquet")
    packed = op9_best_fit_packing(spark, scratch).collect()
    expected = []
    for i, t in awkward_texts():
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        expected += [(i, k, s, min(n - s, 8192)) for k, s in enumerate(range(0, n, 8192))]
    assert bag((r.doc_id, r.piece, r.start, r.n_tokens) for r in packed) == bag(expected)
    assert max(r.piece for r in packed) > 0


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).collect() == []
