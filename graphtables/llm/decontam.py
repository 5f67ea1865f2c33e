"""Benchmark decontamination with an FM-index per shard of the training texts.

Texts and items are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
A phrase is a window of ``window`` consecutive words of an item, or the whole of a
shorter item. Tasks gather texts to shards of a bounded number of words, build an
FM-index over a shard's words (:mod:`graphtables.llm.fm_index`), search all phrases
backwards through its wavelet-tree ranks, locate the occurrences by sampled suffix
positions, and merge their spans per text. Texts longer than a shard are cut into
pieces that overlap by the longest phrase less one word.

Phrases are distinct windows, dealt by hash into blocks of a bounded expected number. The driver holds one block at a
time: it goes to the tasks with one pass over the texts, whose hits are written before the next block is
read, so neither the driver's nor the tasks' share grows with the benchmark. The usual benchmark is one block. Only
phrases travel this way; which items have a phrase is joined to what was found, by phrase number.

Null or wordless texts have no words and no hits; null or wordless items have no
phrases; an empty benchmark hits nothing; an empty table gives no rows. Equal windows of several items count for each; repeated rows
are treated one by one. A null item id is not reported, but its windows hit. Extra
columns pass through :func:`remove_spans` and are ignored by :func:`find_spans`.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtables._workers import ship_with_tasks
from graphtables.llm.common import free_name, texts, written
from graphtables.llm.fm_index import FIRST, SEPARATOR, FMIndex

WINDOW = 10
#: words of a shard: what a task indexes at a time
SHARD_WORDS = 1 << 20
#: distinct windows that go to the tasks at a time
BLOCK_WINDOWS = 200_000
SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def folded(text: bytes | None) -> bytes:
    """Of the text's length: its words in lower case, blanks for all else."""
    return (text or b"").translate(_FOLD)


def windows(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    if len(words) <= size:
        return [words] if words else []
    return [words[i:i + size] for i in range(len(words) - size + 1)]


def phrases(items: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, item) per window of each item, each once; a phrase is its words joined by blanks."""
    source = items.select(F.col(id_col).alias("item"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("phrase", T.BinaryType()), source.schema[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, b" ".join(w)) for i, t in enumerate(texts(batch.column(1)))
                     for w in windows(folded(t).split(), window)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for _, w in found], pa.binary()),
                 batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))], names=["phrase", "item"])

    return source.mapInArrow(run, schema).distinct()


def listed_phrases(pairs: DataFrame) -> DataFrame:
    """(number, phrase): the distinct phrases, numbered once and written."""
    return written(pairs.select("phrase").distinct().select(F.monotonically_increasing_id().alias("number"), "phrase"),
                   "decontam-phrases")


class PhraseBlock:
    """A block of phrases as rows of numbers of their own vocabulary, right-aligned."""

    def __init__(self, found: list[bytes]):
        split = [p.split() for p in found]
        self.vocabulary: dict[bytes, int] = {}
        self.longest = max(map(len, split), default=0)
        self.rows = np.full((len(split), self.longest), -1, np.int64)
        for r, words in enumerate(split):
            self.rows[r, self.longest - len(words):] = [
                self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self.sizes = (self.rows >= 0).sum(axis=1)

    def occurrences(self, index: FMIndex, symbol_of: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """(position, phrase) of every occurrence in an indexed shard."""
        known = np.array([symbol_of.get(w, -2) for w in self.vocabulary] + [-1], np.int64)
        rows = known[self.rows]                                  # -1 (no word) stays last
        possible = np.flatnonzero((rows != -2).all(axis=1))
        low, high = index.search(rows[possible])
        times = np.maximum(high - low, 0)
        phrase = np.repeat(possible, times)
        first = np.repeat(low - (np.cumsum(times) - times), times)
        return index.locate(first + np.arange(len(phrase))), phrase


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(documents: list[bytes | None], block: PhraseBlock,
             shard_words: int = SHARD_WORDS) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """Per text: (words, merged word spans [from, to), numbers of the phrases found)."""
    out: list = [[0, [], set()] for _ in documents]
    symbol_of: defaultdict[bytes, int] = defaultdict(count(FIRST).__next__)     # a new word: the next number
    parts: list[np.ndarray] = []
    origin: list[tuple[int, int, int]] = []         # (first symbol in the shard, text, its word there)
    filled = 0

    def search() -> None:
        nonlocal filled
        if parts and len(block.rows):
            index = FMIndex(np.concatenate(parts))
            at, phrase = block.occurrences(index, symbol_of)
            starts = np.array([o[0] for o in origin])
            piece = np.searchsorted(starts, at, side="right") - 1
            for p, a, k in zip(piece.tolist(), at.tolist(), phrase.tolist()):
                first, number, word = origin[p]
                begin = a - first + word
                out[number][1].append((begin, begin + int(block.sizes[k])))
                out[number][2].add(k)
        parts.clear(), origin.clear(), symbol_of.clear()
        symbol_of.default_factory = count(FIRST).__next__
        filled = 0

    for number, text in enumerate(documents):
        words = folded(text).split()
        out[number][0] = len(words)
        step = max(1, shard_words - block.longest)
        for word in range(0, len(words), step):
            piece = words[word:word + step + max(block.longest - 1, 0)]
            if filled and filled + len(piece) > shard_words:
                search()
            origin.append((filled, number, word))
            symbols = np.empty(len(piece) + 1, np.int64)
            symbols[:-1] = np.fromiter(map(symbol_of.__getitem__, piece), np.int64, len(piece))
            symbols[-1] = SEPARATOR
            parts.append(symbols)
            filled += len(symbols)
    search()
    return [(n, merged(spans), found) for n, spans, found in out]


def _span_array(spans: list[list[tuple[int, int]]], kind: pa.DataType) -> pa.Array:
    return pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], kind)


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS),
                      T.StructField("numbers", T.ArrayType(T.LongType()))])


def _pass(docs: DataFrame, block, hits_only: bool) -> DataFrame:
    """One block of phrases against all texts (the last column): the other columns, and FOUND."""
    schema = T.StructType([*docs.schema.fields[:-1], *FOUND.fields])
    kept = len(docs.columns) - 1
    cache: list[tuple[PhraseBlock, list[int]]] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            numbers, found = block.value
            cache.append((PhraseBlock(found), numbers))
        phrases_, numbers = cache[0]
        span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            result = spans_of(list(texts(batch.columns[-1])), phrases_)
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array([n for n, _, _ in result], pa.int64()),
                 _span_array([s for _, s, _ in result], span_type),
                 pa.array([[numbers[k] for k in sorted(hit)] for _, _, hit in result], pa.list_(pa.int64()))],
                names=schema.names)
            yield out.filter(pa.array([bool(s) for _, s, _ in result], pa.bool_())) if hits_only else out

    return docs.mapInArrow(run, schema)


def _blocks(listed: DataFrame, block_windows: int) -> int:
    return max(1, math.ceil(listed.count() / block_windows))


def _sent(listed: DataFrame, blocks: int, k: int):
    """Block ``k`` as a broadcast: at most about ``block_windows`` phrases."""
    rows = listed.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).collect()
    return listed.sparkSession.sparkContext.broadcast(([r["number"] for r in rows], [bytes(r["phrase"]) for r in rows]))


def _hits(rows: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """(row, spans, numbers) of the rows with hits, over all blocks, each with a pass of its own that is written before the
    next begins. ``rows``: row, text, a written table."""
    parts = None
    for k in range(blocks):
        block = _sent(listed, blocks, k)
        part = written(_pass(rows, block, True), "decontam-hits")
        block.destroy()
        parts = part if parts is None else parts.unionAll(part)
    grouped = parts.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                       F.flatten(F.collect_list("numbers")).alias("numbers"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([(s["begin"], s["end"]) for s in one]) for one in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _span_array(spans, batch.column(1).type), batch.column(2)], names=batch.schema.names)

    return grouped.mapInArrow(join, grouped.schema)


def find_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
               block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, spans (merged, in words, end exclusive), items
    (ids of the items with an occurring window, sorted)."""
    pairs = written(phrases(items, item_id, item_text, window), "decontam-pairs")
    listed = listed_phrases(pairs)
    blocks = _blocks(listed, block_windows)
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    if blocks == 1:
        found = written(_pass(source, _sent(listed, 1, 0), False).withColumn("row", F.monotonically_increasing_id()), "decontam-found")
    else:
        rows = written(source.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "decontam-rows")
        hits = _hits(rows.select("row", "text"), listed, blocks)
        counted = _pass(rows, listed.sparkSession.sparkContext.broadcast(([], [])), False).select("row", "id", "n_words")
        found = written(counted.join(hits, "row", "left"), "decontam-found")
    # the items of what was found: many rows may have one phrase, and many items
    of_row = found.select("row", F.explode("numbers").alias("number")).join(listed, "number").join(
        pairs.where("item is not null"), "phrase")
    by_row = of_row.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast(T.ArrayType(pairs.schema["item"].dataType))
    return found.join(by_row, "row", "left").select(
        "id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", none).alias("items"))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less the words of each span and what stands between them."""
    words = list(_WORD.finditer(folded(text)))
    out, kept = [], 0
    for a, b in spans:
        out.append(text[kept:words[a].start()])
        kept = words[b - 1].end()
    return b"".join([*out, text[kept:]])


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with every occurrence of a phrase cut out of its text; all else unchanged.

    All blocks search the whole texts, and their merged spans are cut once, so the number of blocks does not
    change the result."""
    listed = listed_phrases(phrases(items, item_id, item_text, window))
    blocks, at = _blocks(listed, block_windows), docs.columns.index(text)
    if blocks == 1:
        return _cut(docs, at, _sent(listed, 1, 0))
    row, spans = free_name(docs, "row__"), free_name(docs, "spans__")
    rows = written(docs.select("*", F.monotonically_increasing_id().alias(row)), "decontam-rows")
    hits = _hits(rows.select(F.col(row).alias("row"), F.col(text).alias("text")), listed, blocks)
    hits = hits.select(F.col("row").alias(row), F.col("spans").alias(spans))
    return _cut(rows.join(hits, row, "left").select(*docs.columns, spans), at, None).drop(spans)


def _cut(docs: DataFrame, at: int, block) -> DataFrame:
    """The texts (column ``at``) without their spans: those in the last column or, of a block, those that it finds."""
    cache: list[PhraseBlock] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if block is not None and not cache:
            cache.append(PhraseBlock(block.value[1]))
        for batch in batches:
            old = list(texts(batch.column(at)))
            if cache:
                spans = [s for _, s, _ in spans_of(old, cache[0])]
            else:
                spans = [[(s["begin"], s["end"]) for s in one or ()] for one in batch.columns[-1].to_pylist()]
            columns = list(batch.columns)
            if old:
                new = [without_spans(t, s) if s else t for t, s in zip(old, spans)]
                columns[at] = pa.array(new, pa.binary()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


ship_with_tasks(__name__)
