import re
from collections import Counter

import pytest

from graphtables.llm import quality
from tests.llm.samples import awkward_texts, bag, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = [(400, "a b c d e " * 3), (401, "x y " * 30), (402, "a " * 40), (403, "\n".join(["one line here now"] * 9)),
         (404, "### $$$ " + " ".join(f"word{i}" for i in range(12))), (405, " ".join(f"w{i} | {i} ." for i in range(20))),
         (406, " ".join(f"ABC{i}" for i in range(30))), (407, " ".join("é" * 14 + str(i) for i in range(20))),
         (408, "p q r s t u v w x y z a1 a2 a3 p q r s t end1 end2")]


def plain(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    covered = {j for i in range(len(ws) - 4) if windows[tuple(ws[i:i + 5])] > 1 for j in range(i, i + 5)}
    n, chars = len(ws), sum(map(len, ws))
    symbols = sum(c in "#*$%&|<>" for c in text)
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    base = n < 10 or 100 * len(covered) > 20 * n
    bare = sum(not any("a" <= c <= "z" or "A" <= c <= "Z" or c >= "\x80" for c in w) for w in ws)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    kept = not (base or 10 * symbols > 3 * n or 2 * dup > len(lines) or n >= 20 and 10 * bare > 4 * n or upper > lower
                or not 2 * n <= chars <= 12 * n)
    return n, chars, symbols, dup, len(covered), base, kept


def rows():
    return [(i, t if t is None or len(t) < 20_000 else t[:8000]) for i, t in awkward_texts()] + EXTRA


def test_measures_and_verdicts_by_brute_force(spark):
    expected = [(i, *plain(t)) for i, t in rows()]
    got = [tuple(r) for r in quality.judge(frame(spark, rows())).collect()]
    assert bag(got) == bag(expected)
    assert {e[-1] for e in expected} == {True, False}


def test_every_rule_rejects_something_and_order_changes_no_verdict(spark):
    rules = quality.default_rules()
    hit = {name for _, t in rows() for name, rejects in rules.items() if rejects(quality.Measures((t or "").encode()))}
    assert hit == set(rules)
    table = frame(spark, rows())
    for order in (list(rules), list(reversed(rules))):
        kept = quality.keep_good(table, order=order)
        assert kept.columns == table.columns
        assert bag((r.doc_id, r.text) for r in kept.collect()) == bag((i, t) for i, t in rows() if plain(t)[-1])


def test_plan_orders_by_rejections_per_second(spark):
    docs = spark.createDataFrame([(i, "short text") for i in range(3000)], "doc_id long, text string")
    order = quality.plan_cascade(docs)
    assert sorted(order) == sorted(quality.default_rules())
    # of all rules only this one (and none that is cheaper) rejects such texts
    assert order[0] == "too_short"


def test_cascade_stops_at_the_first_rejection():
    class Counting(quality.Measures):
        asked = []

        def __getattribute__(self, name):
            if name in quality.METRICS:
                Counting.asked.append(name)
            return super().__getattribute__(name)

    chain = list(quality.default_rules().items())
    assert quality.first_rejection(Counting(b"short"), chain) == "too_short"
    assert "n_repeat_words" not in Counting.asked


@pytest.mark.parametrize("seed", range(5))
def test_repeat_words_on_random_texts(seed):
    import random
    rng = random.Random(seed)
    for _ in range(60):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        assert quality.Measures(text.encode()).n_repeat_words == plain(text)[4]


def test_empty_table(spark):
    assert quality.judge(frame(spark, [])).collect() == []
    assert quality.keep_good(frame(spark, [])).collect() == []
