"""Quality rules as a short-circuit cascade.

Every rule says why a document is to be rejected; a document is kept if no rule
rejects it, so the verdict does not depend on the order of the rules. The cost
does: :func:`plan_cascade` times each rule on a sample, takes its rejection rate
there, and orders the rules by rejections per second. :func:`judge` runs them in
that order on every whole text and stops at a document's first rejection.

Words are runs of characters other than space and ``\\t \\n \\v \\f \\r``.
Null text counts as a text without words; it and the empty text are rejected
(``too_short``). An empty table gives an empty result. Repeated rows are judged
one by one. Extra columns pass through; a metric whose name clashes with an input
column replaces nothing, because :func:`judge` returns only the id and its own columns.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtables._workers import ship_with_tasks
from graphtables.llm.common import texts

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))     # UTF-8 bytes that start no code point
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
NOT_LETTER = bytes(b for b in range(128) if b not in UPPER + LOWER)

#: the size of the sample on which costs and selectivities are estimated
SAMPLE_ROWS = 400
SAMPLE_FRACTION = 0.05

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measures:
    """The measures of one text, each computed when a rule first asks for it."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, SPACE + CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_letterless(self) -> int:
        return sum(1 for w in self.words if not w.translate(None, NOT_LETTER))

    @cached_property
    def case_counts(self) -> tuple[int, int]:
        n = len(self.text)
        return n - len(self.text.translate(None, UPPER)), n - len(self.text.translate(None, LOWER))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside any 5-word window that the text has at least twice."""
        n = self.n_words
        if n < 6:
            return 0
        code: dict[bytes, int] = {}
        ids = np.fromiter((code.setdefault(w, len(code)) for w in self.words), np.int64, n)
        if len(code) == n:
            return 0
        # a repeated window has repeated word pairs only; few windows pass this test
        _, pair, times = np.unique(ids[:-1] * len(code) + ids[1:],
                                   return_inverse=True, return_counts=True)
        again = times[pair] > 1
        starts = np.flatnonzero(again[:-3] & again[1:-2] & again[2:-1] & again[3:])
        if not len(starts):
            return 0
        windows = list(zip(pair[starts].tolist(), pair[starts + 2].tolist(), ids[starts + 4].tolist()))
        seen = Counter(windows)
        covered = np.zeros(n, bool)
        for i, w in zip(starts.tolist(), windows):
            if seen[w] > 1:
                covered[i:i + 5] = True
        return int(covered.sum())


Rule = Callable[[Measures], bool]


def default_rules() -> dict[str, Rule]:
    """Name -> rejects(measures). The first two are the contract's base rules."""
    return {
        "too_short": lambda m: m.n_words < 10,
        "repeated_windows": lambda m: 100 * m.n_repeat_words > 20 * m.n_words,
        "symbols": lambda m: 10 * m.n_symbols > 3 * m.n_words,
        "repeated_lines": lambda m: 2 * m.n_dup_lines > len(m.lines),
        # numbers of all sorts make up much of a short clean text
        "letterless_words": lambda m: m.n_words >= 20 and 10 * m.n_letterless > 4 * m.n_words,
        "capitals": lambda m: m.case_counts[0] > m.case_counts[1],
        "word_length": lambda m: not 2 * m.n_words <= m.word_chars <= 12 * m.n_words,
    }


def base_failed(m: Measures) -> bool:
    return m.n_words < 10 or 100 * m.n_repeat_words > 20 * m.n_words


def plan_cascade(docs: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None,
                 sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules in the order that rejects most per second.

    Each rule runs by itself on at most ``sample_rows`` rows (fresh measures for
    each rule, so that its cost holds what it needs); only the sums per rule reach
    the driver. The sample decides the order alone, never a verdict.
    """
    rules = rules or default_rules()

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = list(texts(batch.column(0)))
            for name, rejects in rules.items():
                began = time.perf_counter()
                hits = sum(rejects(Measures(t)) for t in column)
                yield pa.RecordBatch.from_pydict({
                    "rule": [name], "seconds": [time.perf_counter() - began], "hits": [hits]})

    sample = docs.select(F.col(text).alias("text")).sample(SAMPLE_FRACTION, seed=8).limit(sample_rows)
    sums = (sample.mapInArrow(trial, "rule string, seconds double, hits long")
            .groupBy("rule").agg(F.sum("hits").alias("hits"), F.sum("seconds").alias("seconds")))
    rate = {r["rule"]: r["hits"] / max(r["seconds"], 1e-9) for r in sums.collect()}
    return sorted(rules, key=lambda name: -rate.get(name, 0.0))     # stable: ties keep the given order


def first_rejection(m: Measures, order: Sequence[tuple[str, Rule]]) -> str | None:
    return next((name for name, rejects in order if rejects(m)), None)


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
          rules: dict[str, Rule] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """One row per input row: the id, METRICS, base_failed and kept."""
    rules = rules or default_rules()
    chain = [(name, rules[name]) for name in (order or plan_cascade(docs, text, rules))]
    source = docs.select(F.col(id_col), F.col(text).alias("text_"))
    names = [id_col, *METRICS, "base_failed", "kept"]
    schema = T.StructType([source.schema[0],
                           *(T.StructField(c, T.LongType(), False) for c in METRICS),
                           T.StructField("base_failed", T.BooleanType(), False),
                           T.StructField("kept", T.BooleanType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in (*METRICS, "base_failed", "kept")}
            for t in texts(batch.column(1)):
                m = Measures(t)
                out["kept"].append(first_rejection(m, chain) is None)
                out["base_failed"].append(base_failed(m))
                for c in METRICS:
                    out[c].append(getattr(m, c))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[c], pa.int64()) for c in METRICS),
                 pa.array(out["base_failed"]), pa.array(out["kept"])],
                names=names)

    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None,
              order: Sequence[str] | None = None) -> DataFrame:
    """The rows that no rule rejects, all columns unchanged. Here the cascade really
    short-circuits: a rejected document's later measures are never computed."""
    rules = rules or default_rules()
    chain = [(name, rules[name]) for name in (order or plan_cascade(docs, text, rules))]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [first_rejection(Measures(t), chain) is None for t in texts(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ship_with_tasks(__name__)
