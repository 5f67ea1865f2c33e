"""Best-fit packing of token sequences into bins of several permitted lengths.

Pieces (documents, cut where they exceed the largest length) are dealt round robin to
shards of a bounded number of pieces, and each shard is packed by best-fit decreasing:

* a piece goes to the open bin, of whatever length, that it leaves the least room in;
* if it fits none, the lengths that hold it compete: each is filled, on paper, with the largest of the shard's remaining
  pieces that still fit, again and again, and the length with the least cost (``bin_cost``) per token so filled is opened;
* at the end each bin is downsized to the smallest permitted length that holds its contents;
* the shard is also packed with the smallest length that holds a piece as the one opened, and the cheaper of the
  two packings is taken, so that competing lengths never cost more than that.

A length is dear when it is long (attention) and when it cannot be filled: of pieces of 600 tokens three fill 2048 better
than one fills 1024, whatever longer bins cost.

No piece is dropped or truncated. A text without tokens has its end token only. Null
ids and repeated rows are packed like any other; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtables._workers import ship_with_tasks
from graphtables.llm.common import text_or_empty, written
from graphtables.llm.tokens import count_tokens

LENGTHS = (1024, 2048, 4096, 8192)
#: pieces packed by one task
SHARD_PIECES = 50_000
#: a bin's cost beyond its tokens: for opening one, and for attention over its length
OPEN_COST = 64
ATTENTION = 1 / 32768


def bin_cost(length: int) -> float:
    return OPEN_COST + length + ATTENTION * length * length


def word_tokens(text: str = "text") -> Column:
    """Words of a text and one end token: a token count that needs no vocabulary."""
    trimmed = F.regexp_replace(text_or_empty(text), r"^[ \t-\r]+|[ \t-\r]+$", "")
    return (F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))) + 1).cast("long")


class _Remaining:
    """The sizes that are not packed yet: how often each occurs, and a bit for each that does."""

    def __init__(self, sizes: Sequence[int]):
        self.times = Counter(sizes)
        self.bits = sum(1 << size for size in self.times)

    def take(self, size: int) -> None:
        self.times[size] -= 1
        if not self.times[size]:
            self.bits &= ~(1 << size)

    def fill(self, room: int) -> int:
        """The tokens that the largest fitting pieces, taken one after another, put into ``room``."""
        filled, limit = 0, room
        while room > 0 and (fitting := self.bits & ((1 << (min(limit, room) + 1)) - 1)):
            size = fitting.bit_length() - 1
            n = min(room // size, self.times[size])
            filled, room, limit = filled + n * size, room - n * size, size - 1
        return filled


def _packed(sizes: Sequence[int], lengths: Sequence[int], compete: bool) -> tuple[list[int], list[int], list[int], list[int]]:
    """(bin of each size, offset in its bin, length that each bin was opened with, its final length)."""
    ordered = sorted(lengths)
    remaining = _Remaining(sizes)
    room_of: list[list[int]] = [[] for _ in range(ordered[-1] + 1)]     # open bins by what room they have
    rooms = 0                                                           # bit r: some bin has room r
    used: list[int] = []
    opened: list[int] = []
    bins, offsets = [], []
    for size in sizes:
        remaining.take(size)
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = room_of[room].pop()
            if not room_of[room]:
                rooms &= ~(1 << room)
        else:
            holding = [x for x in ordered if x >= size]
            room = holding[0] if not compete else min(
                holding, key=lambda x: (bin_cost(x) / (size + remaining.fill(x - size)), x))
            b = len(used)
            used.append(0)
            opened.append(room)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if room > size:
            room_of[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, opened, [next(x for x in ordered if x >= u) for u in used]


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int], list[int]]:
    """For sizes in descending order: (bin of each, offset in its bin, length each bin was opened with, its final length)."""
    return min((_packed(sizes, lengths, compete) for compete in (True, False)), key=lambda p: sum(map(bin_cost, p[3])))


def pack_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text: str = "text",
                lengths: Sequence[int] = LENGTHS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """:func:`pack` with the tokens of :func:`graphtables.llm.tokens.count_tokens` and an end token as a text's length."""
    counted = count_tokens(docs, tokenizer_file, id_col, text).select(F.col("id").alias(id_col), "n_tokens")
    return pack(counted, id_col, F.col("n_tokens") + 1, lengths, shard_pieces)


def pack(docs: DataFrame, id_col: str = "doc_id", tokens: Column | None = None,
         lengths: Sequence[int] = LENGTHS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: id, piece (0, 1, ..), start (in the document's tokens), n_tokens,
    bin_id, bin_offset, bin_length, and opened_length, which the bin had before it was downsized. ``tokens``: the number of
    each row's tokens, one at least (default: words and an end token)."""
    top = max(lengths)
    lengths = tuple(lengths)
    counted = docs.select(F.col(id_col), (word_tokens() if tokens is None else tokens).alias("n"))
    pieces = written(
        counted.select(F.col(id_col), "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(top).cast("long"))))
        .select(F.col(id_col), F.col("pos").alias("piece"), F.col("col").alias("start"),
                F.least(F.col("n") - F.col("col"), F.lit(top)).alias("n_tokens")), "pack-pieces")
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    schema = T.StructType([*pieces.schema, T.StructField("bin_id", T.LongType()),
                           T.StructField("bin_offset", T.LongType()), T.StructField("bin_length", T.LongType()),
                           T.StructField("opened_length", T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        shard = pa.Table.from_batches(held)
        shard = shard.sort_by([("n_tokens", "descending"), (names[0], "ascending"), ("piece", "ascending")])
        bins, offsets, opened, final = best_fit(shard["n_tokens"].to_pylist(), lengths)
        first = TaskContext.get().partitionId() << 32
        columns = [*shard.columns, pa.chunked_array([pa.array([first + b for b in bins], pa.int64())]),
                   pa.chunked_array([pa.array(offsets, pa.int64())]),
                   pa.chunked_array([pa.array([final[b] for b in bins], pa.int64())]),
                   pa.chunked_array([pa.array([opened[b] for b in bins], pa.int64())])]
        yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=10_000)

    return pieces.repartition(shards).mapInArrow(run, schema)


ship_with_tasks(__name__)
