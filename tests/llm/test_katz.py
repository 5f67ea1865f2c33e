import collections
import math
import zlib

import pytest

from graphtables.llm import katz
from tests.llm.samples import awkward_texts, frame


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.c1, self.c2 = collections.Counter(), collections.defaultdict(collections.Counter)
        for t in texts:
            self.c1.update(t)
            for h, w in zip([None] + t, t):
                self.c2[h][w] += 1
        self.n = sum(self.c1.values())
        self.d1 = self.discounts(self.c1.values())
        self.d2 = self.discounts(c for x in self.c2.values() for c in x.values())
        self.left = sum((1 - self.d1.get(c, 1)) * c for c in self.c1.values())

    def discounts(self, counts):
        n, k = collections.Counter(counts), katz.K
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        d = {}
        for r in range(1, k + 1):
            e = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if common < 1 and n[r] else 1
            d[r] = e if 0 < e < 1 else 1
        return d

    def word(self, w):
        over = self.n + (self.left == 0)
        return self.d1.get(self.c1[w], 1) * self.c1[w] / over if w in self.c1 else (self.left or 1) / over

    def after(self, h):
        seen = self.c2.get(h)
        if not seen:
            return {}, 1.0
        left = sum((1 - self.d2.get(c, 1)) * c for c in seen.values())
        over = sum(seen.values()) + (left == 0)
        return ({w: self.d2.get(c, 1) * c / over for w, c in seen.items()},
                (left or 1) / over / (1 - sum(map(self.word, seen))))


def tokens(text):
    return (text or "").encode().lower().split() + [katz.END]


def check(spark, rows, **sizes):
    trained = [tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    m = Plain(trained)
    for h in m.c2:                                                      # exactly normalised
        p, alpha = m.after(h)
        rest = sum(m.word(w) for w in m.c1 if w not in p) + m.word(b"\n\n")
        assert abs(sum(p.values()) + alpha * rest - 1) < 1e-9
    expected = collections.Counter()
    for i, t in rows:
        ts, s = tokens(t), 0.0
        for h, w in zip([None] + ts, ts):
            p, alpha = m.after(h)
            s += math.log10(p[w] if w in p else alpha * m.word(w))
        base = sum(math.log10((m.c1[w] + 0.5) / (m.n + 0.5 * (len(m.c1) + 1))) for w in ts)
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
        expected[i, held, len(ts), sum(w in m.c1 for w in ts), m.n, f"{base:.5f}", f"{s:.5f}"] += 1
    got = collections.Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.5f}", f"{r.score:.5f}")
                              for r in katz.score(frame(spark, rows), **sizes).collect())
    assert got == expected


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "part_words": 40, "part_tokens": 300}])
def test_scores_by_brute_force(spark, sizes):
    """The second case has many blocks and parts, and words frequent enough to be split over parts."""
    rows = [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in awkward_texts()]
    check(spark, rows, **sizes)


def test_more_texts_than_a_part_has_tokens(spark):
    """The end and the start are then as frequent as words that are split over parts."""
    rows = [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in awkward_texts()]
    check(spark, rows, block_bytes=3000, part_words=40, part_tokens=20)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1)
    check(spark, [(held, "a b"), (held, None)])
    assert katz.score(frame(spark, [])).collect() == []
