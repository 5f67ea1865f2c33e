"""Katz backoff scoring with a bigram model that is trained on a part of the texts.

Tokens are the lower-cased (A-Z) words of a text and one end. With the counts c of the
training texts, Good-Turing discounts d (counts up to ``K``; larger ones stay) and the
token w after h (the start, for the first):

    P(w | h) = d(c(h w)) c(h w) / c(h)      if h w was seen, else  alpha(h) P(w)
    P(w)     = d(c(w)) c(w) / N             if w was seen, else the mass left over

alpha(h) is exactly what normalises P(. | h): the mass that discounting leaves at h over the
mass that P gives to words not seen after h. Where nothing was discounted, the
denominator is one more, so that some mass is left; an h never seen has alpha 1.

The model lives in two written tables of one row per part: words by hash, pairs by
hash of h (pairs of an h with more than ``PART_TOKENS`` occurrences by hash of both, and its sums
are added up over parts, so no frequent h meets in one task). Texts stay in blocks of
bounded size: a block sends each part its distinct words or pairs, and gets back their counts. So
each distinct one travels once per block, whatever its frequency, and a token's probability is
looked up in its block.

Null texts are empty texts (an end only). Null ids hash like the empty id. Repeated rows count
each time. Extra columns are ignored; no rows give no rows, and no training rows make every word unseen.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtables._workers import ship_with_tasks
from graphtables.llm.common import pack, texts, unpack, written
from graphtables.llm.tokens import numbering

#: the largest discounted count
K = 5
#: bytes of text of a block, distinct words and tokens that a part gets, about
BLOCK_BYTES = 12 << 20
PART_WORDS = 500_000
PART_TOKENS = 2_000_000
#: the end of a text as a word: no word holds white space
END = b"\n"
#: the id of the start, which only is an h; words count from 1
START_ID = 0

_WORDS = "block long, part long, numbers binary, ids_ binary, counts binary, words array<binary>, hist array<long>"
_PAIRS = ("block long, part long, h binary, runs binary, w binary, counts binary, lower binary, few binary, "
          "hist array<long>")


def is_training(id_col: str = "doc_id", of: int = 5, held: int = 1) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(of)) != held


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts of counts 0 .. len(n) - 1, from n[r - 1] types of count r (the last beyond those
    discounted); 1 where the estimate is no discount."""
    k = len(n) - 1
    d = np.ones(k + 1)
    common = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        if common < 1 and n[r - 1]:
            estimate = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
            if 0 < estimate < 1:
                d[r] = estimate
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


@dataclass(frozen=True)
class Totals:
    """Numbers of the training texts: tokens, distinct words, texts, and discounts of words."""
    tokens: int
    words: int
    texts: int
    d: np.ndarray
    left: float         # the count mass that discounting words leaves

    @property
    def over(self) -> float:
        return self.tokens + (self.left == 0)

    def word(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by count; that of count 0 is all that is left over."""
        return np.where(counts > 0, discounted(counts, self.d), self.left or 1.0) / self.over


def histogram(counts: np.ndarray) -> list[int]:
    """Types of count 1 .. K + 1, then all types and all tokens."""
    seen = counts[counts > 0]
    return [*np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[1:K + 2].tolist(), len(seen), int(seen.sum())]


def _batch(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(list(c), kinds[kind]) for (name, kind), c in zip(fields, columns)})


# ---- blocks of texts -----------------------------------------------------------------------

def blocks(docs: DataFrame, id_col: str, text: str, train: Column, block_bytes: int) -> DataFrame:
    """A row per block: ids, train, lengths (in tokens) of its texts, their words as numbers of
    the block (seq), the words and their number; END is word 0."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), train.alias("train"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("part", T.LongType()),
        T.StructField("ids", T.ArrayType(source.schema[0].dataType)), T.StructField("train", T.ArrayType(T.BooleanType())),
        T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("seq", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("n_words", T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, id_type = TaskContext.get().partitionId() << 32, 0, None
        ids, train_, lengths, seqs, size = [], [], [], [], 0
        number_of = numbering()
        number_of[END]

        def block() -> pa.RecordBatch:
            row = [first + made, -1, ids, train_, lengths, pack(np.concatenate(seqs)), list(number_of), len(number_of)]
            kinds = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(),
                     pa.list_(pa.binary()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for i, t, used in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist()):
                t = (t or b"").lower()
                if ids and size + len(t) > block_bytes:
                    yield block()
                    made, ids, train_, lengths, seqs, size = made + 1, [], [], [], [], 0
                    number_of = numbering()
                    number_of[END]
                words = t.split()
                seq = np.zeros(len(words) + 1, np.int64)
                seq[:-1] = np.fromiter(map(number_of.__getitem__, words), np.int64, len(words))
                ids.append(i), train_.append(bool(used)), lengths.append(len(seq)), seqs.append(seq)
                size += len(t)
        if ids:
            yield block()

    return written(source.mapInArrow(run, schema), "katz-blocks")


class Block:
    """A block as arrays: seq (word numbers), before (the number before each token; the
    number after the last word's stands for the start), trained and text (of each token)."""

    def __init__(self, row: dict):
        self.ids, self.n_words = row["ids"], row["n_words"]
        lengths = np.array(row["lengths"], np.int64)
        self.train = np.array(row["train"], bool)
        self.seq = unpack(row["seq"])
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.trained = self.train[self.text]
        self.before = np.empty_like(self.seq)
        self.before[1:] = self.seq[:-1]
        self.before[np.cumsum(lengths) - lengths] = self.n_words

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(h, w, pair number of each token) of the distinct pairs in ascending order."""
        width = self.n_words
        key, of = np.unique(self.before * width + self.seq, return_inverse=True)
        return key // width, key % width, of


def parts_of_words(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))


def _mixed(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(29))


def parts_of_pairs(h_ids: np.ndarray, w_ids: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    mixed = _mixed(h_ids + 1)
    mixed = np.where(hot, _mixed(mixed.view(np.int64) + w_ids), mixed)
    return ((mixed >> np.uint64(17)) % np.uint64(parts)).astype(np.int64)


# ---- words ------------------------------------------------------------------------------------

def word_table(found: DataFrame, part_words: int) -> DataFrame:
    """Per part a row of its words, ids and counts (block -1), and per block and part the numbers
    (differences), ids and counts of the block's words there."""
    total = found.select(F.sum("n_words")).first()[0] or 0
    parts = max(1, math.ceil(total / part_words))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b, words = Block(row | {"ids": []}), row["words"]
                counts = np.bincount(b.seq[b.trained], minlength=b.n_words)
                part = parts_of_words(words, parts)
                for p in np.unique(part).tolist():
                    at = np.flatnonzero(part == p)
                    table = _batch([(row["block"], p, pack(np.diff(at, prepend=0)), None, pack(counts[at]),
                                     [words[k] for k in at.tolist()], None)], _WORDS)
                    yield from table.to_batches()

    def add_up(group: pa.Table) -> pa.Table:
        rows = group.select(["block", "part", "numbers", "counts", "words"]).to_pylist()
        p, number_of = rows[0]["part"], numbering()
        numbers = [np.fromiter(map(number_of.__getitem__, r["words"]), np.int64, len(r["words"])) for r in rows]
        counts = np.zeros(len(number_of), np.int64)
        for r, n in zip(rows, numbers):
            counts[n] += unpack(r["counts"])
        words = list(number_of)
        order = np.array(sorted(range(len(words)), key=lambda k: (-counts[k], words[k])), np.int64)
        ids = np.empty(len(words), np.int64)            # frequent words have low ids
        ids[order] = 1 + p + parts * np.arange(len(words))
        out = [(r["block"], p, r["numbers"], pack(ids[n]), pack(counts[n]), None, None) for r, n in zip(rows, numbers)]
        out.append((-1, p, None, pack(ids[order]), pack(counts[order]), [words[k] for k in order.tolist()], histogram(counts)))
        return _batch(out, _WORDS)

    dealt = found.select("block", "seq", "lengths", "train", "words", "n_words").mapInArrow(deal, _WORDS)
    return written(dealt.groupBy("part").applyInArrow(add_up, _WORDS), "katz-words")


def _histogram_sum(table: DataFrame) -> list[int]:
    sums = table.where("block = -1").select(*(F.sum(F.get("hist", F.lit(i))) for i in range(K + 3))).first()
    return [int(s or 0) for s in sums]


def totals(words: DataFrame, train_texts: int) -> Totals:
    hist = _histogram_sum(words)
    d = good_turing(hist[:K + 1])
    left = sum((1 - d[r]) * r * hist[r - 1] for r in range(1, K + 1))
    return Totals(hist[K + 2], hist[K + 1], train_texts, d, float(left))


# ---- pairs -------------------------------------------------------------------------------------

class KnownBlock(Block):
    """A block with the id and count of each of its words (and, after those, of the start)."""

    def __init__(self, group: pa.Table, t: Totals):
        rows = group.to_pylist()
        super().__init__(next(r for r in rows if r["seq"] is not None))
        self.number = rows[0]["block"]
        self.id = np.full(self.n_words + 1, START_ID, np.int64)
        self.count = np.full(self.n_words + 1, t.texts, np.int64)
        for r in rows:
            if r["ids_"] is not None:
                at = np.cumsum(unpack(r["numbers"]))
                self.id[at], self.count[at] = unpack(r["ids_"]), unpack(r["counts"])
        self.returned = [r for r in rows if r["lower"] is not None]

    def dealt(self, parts: int, part_tokens: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, pairs there, their distinct h, pairs of each) for every part that gets any."""
        h, w, _ = self.pairs()
        part = parts_of_pairs(self.id[h], self.id[w], self.count[h] > part_tokens, parts)
        order = np.argsort(part, kind="stable")
        keys, first = np.unique(part[order], return_index=True)
        for p, at in zip(keys.tolist(), np.split(order, first[1:])):
            heads, runs = np.unique(h[at], return_counts=True)
            yield p, at, heads, runs


def pair_table(known: DataFrame, t: Totals, part_tokens: int, parts: int) -> DataFrame:
    """Per part a row of its pairs and counts (block -1), per block and part the counts of the
    block's pairs there with the sums of their h, and rows of the sums of frequent h (block -2)."""
    def deal(group: pa.Table) -> pa.Table:
        b = KnownBlock(group, t)
        h, w, of = b.pairs()
        n = np.bincount(of[b.trained], minlength=len(h))
        return _batch([(b.number, p, pack(b.id[heads]), pack(runs), pack(b.id[w[at]]), pack(n[at]), pack(b.count[w[at]]), None, None)
                       for p, at, heads, runs in b.dealt(parts, part_tokens)], _PAIRS)

    def add_up(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        heads = [unpack(r["h"]) for r in rows]
        runs = [unpack(r["runs"]) for r in rows]
        w = np.concatenate([unpack(r["w"]) for r in rows])
        if max(int(w.max(initial=0)), max((int(x.max(initial=0)) for x in heads))) >= 1 << 31:
            raise OverflowError("more distinct words than 31 bits number")
        key, first, of = np.unique(np.repeat(np.concatenate(heads), np.concatenate(runs)) << 32 | w,
                                   return_index=True, return_inverse=True)
        n = np.bincount(of, weights=np.concatenate([unpack(r["counts"]) for r in rows]), minlength=len(key)).astype(np.int64)
        lower = t.word(np.concatenate([unpack(r["lower"]) for r in rows])[first])      # P(w) of each pair
        h, of_h = np.unique(key >> 32, return_inverse=True)
        seen = n > 0
        mass = np.bincount(of_h, weights=lower * seen, minlength=len(h))
        few = np.zeros((len(h), K), np.int64)                       # pairs of count 1 .. K of each h
        small = seen & (n <= K)
        np.add.at(few, (of_h[small], n[small] - 1), 1)
        p, out, at = rows[0]["part"], [], 0
        for r, head, run in zip(rows, heads, runs):
            size = int(run.sum())
            k = np.searchsorted(h, head)
            out.append((r["block"], p, None, None, None, pack(n[of[at:at + size]]), mass[k].tobytes(), pack(few[k].T.ravel()), None))
            at += size
        out.append((-1, p, pack(h), pack(np.bincount(of_h[seen], minlength=len(h))), pack((key & 0xFFFFFFFF)[seen]),
                    pack(n[seen]), mass.tobytes(), pack(few.T.ravel()), histogram(n)))
        return _batch(out, _PAIRS)

    both = known.select("*", F.lit(None).cast("binary").alias("lower"))
    return written(both.groupBy("block").applyInArrow(deal, _PAIRS).groupBy("part").applyInArrow(add_up, _PAIRS), "katz-pairs")


def frequent_sums(pairs: DataFrame, words: DataFrame, t: Totals, part_tokens: int) -> dict[int, tuple[float, np.ndarray]]:
    """id -> (mass, few) over all parts, of each h with more than ``part_tokens`` occurrences; there
    are at most tokens / part_tokens of them."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["ids_"])
                yield pa.RecordBatch.from_pydict({"h": ids[unpack(r["counts"]) > part_tokens]})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h = unpack(r["h"])
                few = unpack(r["few"]).reshape(K, -1)
                at = np.flatnonzero(np.isin(h, wanted))
                yield pa.RecordBatch.from_pydict({"h": h[at], "mass": np.frombuffer(r["lower"])[at],
                                                  **{f"few{i}": few[i][at] for i in range(K)}})

    hot = [r["h"] for r in words.where("block = -1").select("ids_", "counts").mapInArrow(pick, "h long").collect()]
    wanted = np.array(hot + [START_ID] * (t.texts > part_tokens), np.int64)
    if not len(wanted):
        return {}
    fields = ["mass", *(f"few{i}" for i in range(K))]
    rows = (pairs.where("block = -1").select("h", "lower", "few").mapInArrow(sums, "h long, mass double, " + ", ".join(
        f"few{i} long" for i in range(K))).groupBy("h").agg(*(F.sum(f).alias(f) for f in fields))).collect()
    return {r["h"]: (r["mass"], np.array([r[f"few{i}"] for i in range(K)])) for r in rows}


# ---- scores ------------------------------------------------------------------------------------

def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", train: Column | None = None,
          block_bytes: int = BLOCK_BYTES, part_words: int = PART_WORDS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score (add-half words)
    and score (the model's log10 probability of the text)."""
    found = blocks(docs, id_col, text, is_training(id_col) if train is None else train, block_bytes)
    sums = found.select(F.sum(F.size(F.filter("train", lambda x: x))), F.sum(
        F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    train_texts, tokens = int(sums[0] or 0), int(sums[1] or 0)
    words = word_table(found, part_words)
    t = totals(words, train_texts)
    parts = max(1, math.ceil(tokens / part_tokens))
    # the blocks and, by block, what is known of their words; the words themselves travel no more
    known = found.drop("words").unionByName(words.where("block >= 0").drop("words", "hist"), allowMissingColumns=True)
    pairs = pair_table(known, t, part_tokens, parts)
    d = good_turing(_histogram_sum(pairs)[:K + 1])
    frequent = frequent_sums(pairs, words, t, part_tokens)
    id_type = found.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()),
                           *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
                           *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])

    def evaluate(group: pa.Table) -> pa.Table:
        b = KnownBlock(group, t)
        h, w, of = b.pairs()
        n = np.zeros(len(h), np.int64)
        mass = np.zeros(b.n_words + 1)
        few = np.zeros((K, b.n_words + 1), np.int64)
        by_part = {r["part"]: r for r in b.returned}
        for p, at, heads, _ in b.dealt(parts, part_tokens):
            r = by_part[p]
            n[at] = unpack(r["counts"])
            mass[heads] = np.frombuffer(r["lower"])
            few[:, heads] = unpack(r["few"]).reshape(K, -1)
        for k in np.unique(h[b.count[h] > part_tokens]).tolist():       # the end, as frequent as texts, is no h
            mass[k], few[:, k] = frequent[int(b.id[k])]
        left = ((1 - d[1:K + 1]) * np.arange(1, K + 1)) @ few           # the count mass that discounting leaves at h
        known = b.count > 0
        over = b.count + (known & (left == 0))
        alpha = np.where(known, np.where(left == 0, 1.0, left) / np.maximum(over, 1) / (1 - mass), 1.0)
        p1 = t.word(b.count[:-1])
        p = np.where(n > 0, discounted(n, d) / np.maximum(over[h], 1), alpha[h] * p1[w])
        base = np.log10((b.count[:-1] + 0.5) / (t.tokens + 0.5 * (t.words + 1)))
        texts_ = len(b.ids)
        return pa.table({
            "id": pa.array(b.ids, group.schema.field("ids").type.value_type), "held_out": pa.array(~b.train),
            "n_tokens": np.bincount(b.text, minlength=texts_), "n_known": np.bincount(b.text, weights=known[b.seq], minlength=texts_).astype(np.int64),
            "train_tokens": np.full(texts_, t.tokens),
            "base_score": np.bincount(b.text, weights=base[b.seq], minlength=texts_),
            "score": np.bincount(b.text, weights=np.log10(p)[of], minlength=texts_)})

    rows = known.unionByName(pairs.where("block >= 0").select("block", "part", "counts", "lower", "few"), allowMissingColumns=True)
    return rows.groupBy("block").applyInArrow(evaluate, schema)


ship_with_tasks(__name__)
