import hashlib
import json
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphtables.llm import alignment, catalog
from tests.llm.samples import awkward_texts, bag, frame

A, B = (public_tokenizers.path(f) for f in (alignment.A_FILE, alignment.B_FILE))


def plain_groups(texts):
    """Whole texts through the libraries, groups by the sets of end offsets."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    spell = alignment.byte_alphabet()
    for text in texts:
        if not text:
            yield None
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        of_a = [bytes(spell[c] for c in one.id_to_token(i)) for i in a]
        of_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in zip(b, map(two.id_to_piece, b))]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            yield None
            continue
        ends = [[sum(map(len, x[:k + 1])) for k in range(len(x))] if len(x) < 300 else None for x in (of_a, of_b)]
        if None in ends:
            ends = []
            for x in (of_a, of_b):
                at, out = 0, []
                for t in x:
                    at += len(t)
                    out.append(at)
                ends.append(out)
        groups, starts = [], (0, 0)
        at_a, at_b = ({e: k + 1 for k, e in enumerate(x)} for x in ends)
        for e in sorted(set(ends[0]) & set(ends[1])):
            groups.append((a[starts[0]:at_a[e]], b[starts[1]:at_b[e]]))
            starts = at_a[e], at_b[e]
        yield groups


def plain_align(rows):
    found = list(plain_groups([t for _, t in rows]))
    documents = defaultdict(set)
    for d, groups in enumerate(found):
        for a, b in groups or []:
            for x in a:
                for y in b:
                    documents[x, y].add(d)
    count = {p: len(d) for p, d in documents.items()}
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), groups in zip(rows, found):
        if groups is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


SPECIAL = ["<|endoftext|> in <s>text</s>", "▁marked ▁▁ text", "a  b   c\n\n d \n e", " leads", "\nleads", "ends ", "ends\n", "tab\t\tx \t y",
           "it's we'll  I'm\n'quoted'", "<0x41> <unk>", "x" * 300 + " " + "y1" * 200, " nb  sp", " line  sep",
           "é ﬁ ½ Ⅳ", "漢字 and 😀😀", "\x00 \x1c \x1f z", "…\n…\n--\n1,234.5\n"]


def rows_():
    return awkward_texts() + [(500 + k, t) for k, t in enumerate(SPECIAL)]


@pytest.mark.parametrize("sizes", [{}, {"run_bytes": 2000, "slice_pairs": 100}, {"run_bytes": 1500, "slice_pairs": 700, "fan_in": 2}])
def test_alignment_by_brute_force(spark, sizes):
    """One run a task; many runs and radixes; slices merged in several passes."""
    got = alignment.align(frame(spark, rows_()), A, B, **sizes)
    assert bag(tuple(r) for r in got.collect()) == bag(plain_align(rows_()))


def test_cut_texts_and_whole_texts_have_the_same_tokens():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        pair = alignment.Pair(f.read(), g.read())
    assert pair.cuts
    numbers = [pair.numbers(t) if t else None for _, t in rows_()]
    pair.learn()
    for (_, text), ids, groups in zip(rows_(), numbers, plain_groups([t for _, t in rows_()])):
        spelled = ids is not None and all(pair.measures[4 * k] >= 0 for k in ids.tolist())
        whole = ";".join(pair.groups[k] for k in ids.tolist()) if spelled else None
        assert whole == (groups and ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)), text[:50]


def test_a_task_forgets_pieces(spark, monkeypatch):
    """Pieces learnt again in a later run, and groups whose links are counted by distinct ids."""
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 3)
    got = alignment.align(frame(spark, rows_(), 1), A, B, run_bytes=3000)
    assert bag(tuple(r) for r in got.collect()) == bag(plain_align(rows_()))


def test_a_tokenizer_whose_texts_stay_whole(spark, scratch):
    definition = json.loads(open(A, encoding="utf-8").read())
    definition["normalizer"] = {"type": "NFC"}
    path = f"{scratch}/a.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(definition, f)
    rows = [(1, "plain text here.\nAnd more"), (2, "plain text"), (3, "café")]
    got = {r.id: r for r in alignment.align(frame(spark, rows), path, B).collect()}
    assert [tuple(got[i])[1:5] for i in (1, 2)] == [tuple(r)[1:5] for r in plain_align(rows[:2])] and got[3].n_a == 0


def test_heap_merge():
    import numpy as np

    slices = [(np.array([1 << 20 | 5, 1 << 20 | 7, 2 << 20 | 1]), np.array([3, 1, 2])),
              (np.array([1 << 20 | 7, 3 << 20]), np.array([2, 9])), (np.zeros(0, int), np.zeros(0, int))]
    assert alignment.contributions(slices) == [[7, 7, 5], [7, 19], []]


def test_empty_table_and_tables_without_tokens(spark):
    assert alignment.align(frame(spark, []), A, B).collect() == []
    got = alignment.align(frame(spark, [(1, None), (1, ""), (None, None)]), A, B).collect()
    assert bag(tuple(r) for r in got) == bag([(1, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")])


def test_op11_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.op11_spill_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert bag(tuple(r) for r in got.collect()) == bag(plain_align(rows))
