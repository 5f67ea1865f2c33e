"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has a bit for each of 64: 1 if over half of the text's shingle hashes
(XXH64, seed 42) have it. Two fingerprints are linked at ``max_distance`` or fewer
differing bits.

Candidates. With D = 4 and 3 segments, two linked fingerprints differ by at most one bit
in some segment (4 < 2 * 3). Each segment is indexed once per bit of it, with that bit
wiped out (its *one-wildcard variants*, 64 in all), so that such a pair meets under an equal
key. The equality join verifies the whole distance and lets a pair pass only under the
first key it shares, so each link comes out once. Equal fingerprints are one row of the
join, whatever number of documents has them; a fingerprint has at most 679,120 others
within 4 bits, so not even a cloud of near copies grows with the corpus beyond that.

Components. Links are contracted by alternating large-star and small-star steps; no
group is ever collected.

Null text and text without words have fingerprint zero and are linked like any other.
Null ids are members of their component but never name it (a component of null ids only
has a null name). Repeated rows stay, each with its component. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtables._workers import ship_with_tasks
from graphtables.llm.common import bounded, free_name, texts, written

SEED = 42
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
BITS = 64
#: shingles hashed at a time
CHUNK = 1 << 16
#: fingerprints under one key beyond which the key is refined
LARGE_BUCKET = 2000
#: rows of a filter that are broadcast; more are joined by shuffle
BROADCAST_ROWS = 1_000_000


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The text's SimHash as a signed 64-bit integer."""
    import xxhash

    words = (text or b"").lower().split()       # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        shifted = [words[at + k:min(at + CHUNK, n) + k] for k in range(min(shingle_words, len(words)))]
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*shifted)), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) per row of ``docs``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([source.schema[0], T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle_words) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return source.mapInArrow(run, schema)


def segments(max_distance: int = MAX_DISTANCE, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of the parts of ``bits`` bits: so many that one of them differs by at most
    one bit; of 32 bits at most."""
    parts = max(-(-bits // 32), max_distance // 2 + 1)
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(value: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def variants(value: Column, parts: list[tuple[int, int]]) -> Column:
    """The keys of all one-wildcard variants of the parts of a value: the wildcard's bit number
    above 32 bits of the part with that bit wiped out."""
    return F.array(*(
        F.lit((at + j) << 32).cast("long").bitwiseOR(
            _segment(value, at, width).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << j)).cast("long")))
        for at, width in parts for j in range(width)))


def first_shared(difference: Column, parts: list[tuple[int, int]]) -> Column:
    """The wildcard's bit number of the first variant under which two values of this XOR meet."""
    out = F.lit(None).cast("long")
    for at, width in reversed(parts):
        d = _segment(difference, at, width)
        lone = F.bit_count(d.bitwiseAND(-d) - 1)        # the position of its only bit
        out = F.when(F.bit_count(d) <= 1, F.when(d == 0, F.lit(at)).otherwise(lone + at).cast("long")).otherwise(out)
    return out


def _without(value: Column, at: int, width: int) -> Column:
    """The other bits of a value, moved together."""
    low = value.bitwiseAND(F.lit((1 << at) - 1).cast("long"))
    if at + width == BITS:
        return low
    return low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, at + width), at))


def _by_part(number: Column, parts: list[tuple[int, int]], value: Callable[[int, int], Column]) -> Column:
    """``value`` of the part that a wildcard's bit number lies in."""
    out = None
    for at, width in parts:
        inside = number < at + width
        out = F.when(inside, value(at, width)) if out is None else out.when(inside, value(at, width))
    return out


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """(a, b), a < b: every pair of different fingerprints of column ``fp`` at ``max_distance`` or less, once.

    Fingerprints under a key with more than ``large_bucket`` of them (many millions fill
    buckets by chance) meet only if the bits outside the key's segment agree in a variant as
    well; those differ by ``max_distance`` at most, so no link is lost.
    """
    parts = segments(max_distance)
    rest = {p: segments(max_distance, BITS - p[1]) for p in parts}
    number = F.shiftright("key", 32)
    # spread before the explode, which makes 64 rows of one: Spark sizes tasks and joins by what goes in. By another
    # expression than ``distinct`` has, which would make it no exchange of its own
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.select("fp").distinct().repartition(tasks, F.xxhash64("fp")).select(
        "fp", F.explode(variants(F.col("fp"), parts)).alias("key"))
    large = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large_bucket).select("key"),
                    "simhash-large")
    if large.isEmpty():
        keyed = keyed.withColumn("sub", F.lit(-1).cast("long"))
    else:
        large = bounded(large, BROADCAST_ROWS)
        within = _by_part(number, parts, lambda at, width: variants(_without(F.col("fp"), at, width), rest[at, width]))
        keyed = keyed.join(large, "key", "left_anti").withColumn("sub", F.lit(-1).cast("long")).unionByName(
            keyed.join(large, "key", "left_semi").select("fp", "key", F.explode(within).alias("sub")))
    a = keyed.select(F.col("fp").alias("a"), "key", "sub").hint("merge")       # never a broadcast of one side
    b = keyed.select(F.col("fp").alias("b"), F.col("key").alias("key_b"), F.col("sub").alias("sub_b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first_sub = _by_part(number, parts, lambda at, width: first_shared(_without(apart, at, width), rest[at, width]))
    return a.join(b.hint("merge"), (F.col("key") == F.col("key_b")) & (F.col("sub") == F.col("sub_b")) & (F.col("a") < F.col("b"))
                  & (F.bit_count(apart) <= max_distance) & (number == first_shared(apart, parts))
                  & ((F.col("sub") < 0) | (F.shiftright("sub", 32) == first_sub))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Large-star links a node's larger neighbours to its smallest neighbour, small-star
    its smaller ones; alternating them leaves a star per component."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u")
        keep = F.col("v") > F.col("u") if large else F.lit(True)
        out = moved.where(keep).select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            out = out.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.where("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    current = edges.checkpoint()
    before = state(current)
    while before[0]:
        current = star(star(current, large=True), large=False).checkpoint()
        after = state(current)
        if after == before:
            break
        before = after
    stars = current.groupBy("b").agg(F.min("a").alias("root"))
    return stars.select(F.col("b").alias("node"), "root").unionAll(
        stars.select("root").distinct().select(F.col("root").alias("node"), "root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fp, component): component is the smallest id among all that links reach."""
    fps = written(fingerprints(docs, id_col, text, shingle_words), "simhash-fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(distinct, max_distance))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = rooted.join(named, "root").select("fp", "component")
    return fps.join(by_fp, "fp").select("id", "fp", "component")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, text: str = "text", order_by: str = "doc_id",
             shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` less all rows of a component but the first by (``order_by``, position); all columns
    unchanged. Rows are numbered once, in a written table: a number that is computed again follows the splits of the files."""
    row = free_name(docs, "row__")
    numbered = written(docs.select("*", F.monotonically_increasing_id().alias(row)), "simhash-rows")
    keyed = numbered.select(F.struct(F.col(order_by).isNull().alias("none"), F.col(order_by).alias("order"),
                                     F.col(row).alias("row")).alias("rank"), F.col(text).alias("text"))
    classes = near_duplicates(keyed, "rank", "text", shingle_words, max_distance)
    drops = written(classes.where("id != component").select(F.col("id.row").alias(row)), "simhash-drops")
    return numbered.join(bounded(drops, BROADCAST_ROWS), row, "left_anti").drop(row)


ship_with_tasks(__name__)
