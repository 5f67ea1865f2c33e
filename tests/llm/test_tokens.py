import pytest

from graphtables.llm import tokens
from tests.llm.samples import awkward_texts, bag, frame

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["Hello<|endoftext|>world's 12 3rd it's I'LL <|startoftext|><|endoftext|>", "İstanbul Σας  x　y z",
       "don't''s 'S ½ ² Ⅷ ٣", "ﬁ ﬀ Å ́ leading", "日本語 テスト 한국어 😀!!!", "a\x00b \x85 c\x1cd", "<|endoftext", "<|endoftext|>"]


@pytest.mark.parametrize("block_bytes,group_entries", [(tokens.BLOCK_BYTES, tokens.GROUP_ENTRIES), (2000, 50)])
def test_counts_are_the_library_s(spark, block_bytes, group_entries):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.TOKENIZER)
    rows = awkward_texts() + [(300 + i, t) for i, t in enumerate(ODD)]
    reference = Tokenizer.from_file(path)
    expected = [(i, len((t or "").encode()), len(reference.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    got = tokens.count_tokens(frame(spark, rows), path, block_bytes=block_bytes, group_entries=group_entries)
    assert bag(tuple(r) for r in got.collect()) == bag(expected)


def test_empty_and_wordless_tables(spark):
    path = public_tokenizers.path(tokens.TOKENIZER)
    assert tokens.count_tokens(frame(spark, []), path).collect() == []
    assert [tuple(r) for r in tokens.count_tokens(frame(spark, [(1, None)]), path).collect()] == [(1, 0, 0)]


def test_plain_chunks_are_split_together(monkeypatch):
    """Distinct chunks of plain characters take no call each, and have the pre-tokens that a call would give."""
    import pyarrow as pa

    with open(public_tokenizers.path(tokens.TOKENIZER), encoding="utf-8") as f:
        pre = tokens.PreTokens(f.read())
    plain = [f"{a}{k}{b}" for k in range(100) for a in ("", "wo", "É's") for b in ("", "'ll", "-xIÿ", "!?", "<|")]
    odd = ["", "日本語テスト", "İx", "a<|endoftext|>b", "e\u0301", "😀!", "a\x00b", "\x85", "x　y"]
    mixed = sorted({*plain, *odd}, key=hash)
    alone = {c: pre.split(c.encode()) for c in mixed}
    called = []
    monkeypatch.setattr(pre, "split", lambda c: called.append(c) or alone[c.decode()])
    words, flat, starts, sizes = pre.split_all(pa.array(mixed, pa.large_string()))
    assert {c: [words[n] for n in flat[s:s + k]] for c, s, k in zip(mixed, starts, sizes)} == alone
    assert len(called) == len(odd) and len(plain) > 1000

    called.clear()
    documents = [" ".join(plain[:500]).encode(), None, b"", " \n".join(odd + plain[400:]).encode()]
    words, entries, numbers, times = tokens.frequencies(documents, pre)
    assert len(called) <= len(odd) and entries.tolist()[1:3] == [0, 0]
    got = [{words[n]: t for n, t in zip(*x)} for x in zip(*(map(list, _cut(v, entries)) for v in (numbers, times)))]
    for text, counted in zip(documents, got):
        expected = {}
        for c in (text or b"").split():
            for p in alone[c.decode()]:
                expected[p] = expected.get(p, 0) + 1
        assert counted == expected


def _cut(values, sizes):
    ends = sizes.cumsum()
    return [values[e - n:e] for e, n in zip(ends, sizes)]
