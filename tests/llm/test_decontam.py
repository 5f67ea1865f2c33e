import random
import re

import numpy as np
import pytest

from graphtables.llm import decontam
from graphtables.llm.fm_index import END, FMIndex, suffix_order
from tests.llm.samples import awkward_texts, bag, frame

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lowered(text))


def case():
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "GAMMA", "é1", "42", "straße", "x"]
    item = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (25, 10, 9, 3, 1, 40)]
    items = [(i, t) for i, t in enumerate(item)] + [(50, None), (51, "..."), (2, item[2]), (None, "null item words here"), (60, item[0])]
    docs = awkward_texts() + [
        (500, "start " + item[0].replace(" ", ", ") + " end"), (501, item[1] + " " + item[1].upper() + "\n" + item[3]),
        (502, " ".join(item[0].split()[3:17])), (503, item[2] + item[2]), (504, "x y x"), (505, "null ITEM words-here!"),
        (506, "lead " * 50 + item[5] + " tail" * 50), (500, "start " + item[0] + " end")]
    return docs, items


def plain(docs, items):
    phrases = {}
    for i, t in items:
        ws = words(t)
        for w in ([tuple(ws[k:k + 10]) for k in range(max(1, len(ws) - 9))] if ws else []):
            phrases.setdefault(w, set()).add(i)
    out = []
    for i, t in docs:
        ws, hit, ids = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k:k + n]) in phrases:
                    hit |= set(range(k, k + n))
                    ids |= phrases[tuple(ws[k:k + n])]
        out.append((i, len(ws), hit, sorted(ids - {None}), t))
    return out


@pytest.mark.parametrize("shard,block", [(decontam.SHARD_WORDS, decontam.BLOCK_WINDOWS), (64, 7)])
def test_spans_by_brute_force(spark, monkeypatch, shard, block):
    """The second case cuts texts into small overlapping shards and phrases into many blocks."""
    monkeypatch.setattr(decontam.spans_of, "__defaults__", (shard,))
    docs, items = case()
    docs = [(i, t if t is None or len(t) < 20_000 else t[:4000]) for i, t in docs]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_spans(frame(spark, docs), table, block_windows=block).collect()
    got = [(r.id, r.n_words, {k for s in r.spans for k in range(s.begin, s.end)}, r["items"]) for r in found]
    expected = plain(docs, items)
    assert bag((i, n, sorted(h), x) for i, n, h, x in got) == bag((i, n, sorted(h), x) for i, n, h, x, _ in expected)
    assert sum(bool(e[2]) for e in expected) > 8
    for r in found:
        assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:]))         # merged


def test_removed_spans(spark):
    docs, items = case()
    table = spark.createDataFrame(items, "item_id long, text string")
    source = frame(spark, docs)
    cut = decontam.remove_spans(source, table)
    assert cut.columns == source.columns

    def without(text, hit):
        spans = [m.span() for m in WORD.finditer(lowered(text))]
        out, k = [], 0
        for w in range(len(spans)):
            if w in hit:
                if w - 1 not in hit:
                    out.append(text[k:spans[w][0]])
                k = spans[w][1]
        return "".join([*out, text[k:]])

    expected = [(i, t if not h else without(t, h)) for i, _, h, _, t in plain(docs, items)]
    assert bag((r.doc_id, r.text) for r in cut.collect()) == bag(expected)


def test_suffix_order_search_and_positions():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 300))
        s = rng.integers(1, rng.integers(2, 9), n)
        if rng.random() < 0.3:
            s = np.tile(s[:20], 12)
            n = len(s)
        whole = np.append(s, END).astype(np.int64)
        assert suffix_order(whole).tolist() == sorted(range(n + 1), key=lambda i: tuple(whole[i:]))
        index = FMIndex(s)
        for size in (1, 2, 5):
            phrases = np.array([s[i:i + size] for i in rng.integers(0, n, 6) if i + size <= n]).reshape(-1, size)
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high):
                expected = [i for i in range(n - size + 1) if (s[i:i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_no_items_and_no_texts(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = awkward_texts()[:8]
    found = decontam.find_spans(frame(spark, rows), none).collect()
    assert bag((r.id, r.n_words, r.spans, r["items"]) for r in found) == bag((i, len(words(t)), [], []) for i, t in rows)
    assert decontam.find_spans(frame(spark, []), none).collect() == []
    assert bag(r.text for r in decontam.remove_spans(frame(spark, rows), none).collect()) == bag(t for _, t in rows)


@pytest.mark.parametrize("block", [1, 7, 40])
def test_removed_spans_are_those_of_one_block(spark, block):
    """However the windows of a passage are dealt to blocks, all its words go."""
    docs, items = case()
    docs = [(i, t if t is None or len(t) < 20_000 else t[:4000]) for i, t in docs]
    items = items if block > 1 else [(1, " ".join(f"w{k}" for k in range(12)))]
    docs = docs + [(600, "before " + " ".join(f"w{k}" for k in range(12)) + " after")]
    table = spark.createDataFrame(items, "item_id long, text string")
    cut = decontam.remove_spans(frame(spark, docs), table, block_windows=block)
    whole = decontam.remove_spans(frame(spark, docs), table)
    got = bag((r.doc_id, r.text) for r in cut.collect())
    assert got == bag((r.doc_id, r.text) for r in whole.collect())
    if block == 1:
        assert (600, "before  after") in got


def test_the_driver_holds_one_block_at_a_time(spark, monkeypatch):
    """Fifty blocks: what is collected and broadcast does not grow with the benchmark."""
    sizes, open_ = [], []
    whole = decontam._sent

    class Watched:
        def __init__(self, block):
            self.block = block
            open_.append(self)

        value = property(lambda self: self.block.value)

        def destroy(self):
            open_.remove(self)
            self.block.destroy()

        def __reduce__(self):
            return (lambda block: block, (self.block,))

    def sent(listed, blocks, k):
        assert not open_
        block = whole(listed, blocks, k)
        sizes.append(len(block.value[0]))
        return Watched(block)

    monkeypatch.setattr(decontam, "_sent", sent)
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(60)) for _ in range(40)]
    items = [(i, t[:150]) for i, t in enumerate(texts)]
    n = len({tuple(words(t)[k:k + 10]) for _, t in items for k in range(len(words(t)) - 9)})
    docs = [(i, f"x {t} y") for i, t in enumerate(texts)]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_spans(frame(spark, docs), table, block_windows=-(-n // 50)).collect()
    assert len(sizes) == 50 and sum(sizes) == n and max(sizes) < n / 5 and not open_
    got = [(r.id, sorted(k for s in r.spans for k in range(s.begin, s.end)), r["items"]) for r in found]
    assert bag(got) == bag((i, sorted(h), x) for i, _, h, x, _ in plain(docs, items))


def test_a_phrase_that_all_items_have(spark):
    """Its items are joined to what was found; none of them travels with the phrase."""
    boiler = " ".join(f"notice{k}" for k in range(10))
    items = [(i, f"{boiler} own{i} words") for i in range(3000)]
    docs = [(1, f"a {boiler} b"), (2, "nothing"), (3, f"{boiler} own7 words")]
    found = decontam.find_spans(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.id: len(r["items"]) for r in found} == {1: 3000, 2: 0, 3: 3000}
