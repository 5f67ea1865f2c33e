"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every byte that a string of ``depth`` bytes covers which also starts earlier (smaller id, or earlier in the same text)
is removed. Suffixes need to be ordered through their first ``depth`` bytes only: they are dealt by their digits, most
significant first; a group of one suffix is done at once, and those that are together after the last digit are exactly the
occurrences of a repeated string. All but the first occurrence of a group cover bytes that go.

The first digit is the least hash of the ``GRAM``-byte strings in the suffix's first ``depth`` bytes. Equal suffixes have
equal first digits, and neighbours mostly share theirs, so about one number in 35 bytes tells
which suffixes are alone in the corpus. They never travel. The others follow as *strips*, the bytes of
neighbours with one first digit, and are sorted within a task by further digits of eight bytes.

Tasks gather texts to runs of bounded size, each written once. Strips that a run has twice are decided in the run, so
copies combine before they travel. First digits with more than ``large`` strips are spread by a second digit, a 128-bit
digest of the suffix, so that no task gets an unbounded group.

Ids are numbers, null ids come last; texts of one id are ordered by their digests, and equal rows are
interchangeable: one of them comes first. Null texts are empty. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtables._workers import ship_with_tasks
from graphtables.llm.common import pack, unpack, written

DEPTH = 100
#: bytes of the strings whose least hash is the first digit
GRAM = 32
#: bytes of text of a run, and of what is hashed at a time
RUN_BYTES, BLOCK_BYTES = 6 << 20, 1 << 18
#: strips of one first digit beyond which it is spread by a second one
LARGE = 10_000
#: first digits, and strips, that a task gets together, about
GROUP_DIGITS, GROUP_STRIPS = 1_000_000, 30_000
#: the place of null ids
_LAST = np.iinfo(np.int64).max

_rng = np.random.default_rng(2024)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each string of ``gram`` (a power of two) bytes, by doubling."""
    out, width, level = _BYTE[data], 1, 0
    while width < gram:
        out = (out[:-width] ^ (out[:-width] >> np.uint64(29))) * _ODD[level] + out[width:]
        width, level = 2 * width, level + 1
    out = (out ^ (out >> np.uint64(32))) * _ODD[14]
    return out ^ (out >> np.uint64(31))


def first_digits(data: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The first digit of each suffix with ``depth`` bytes, the least hash of its strings of ``gram`` bytes, and whether
    its own first string is the one."""
    hashes, width, whole = gram_hashes(data, gram), 1, depth - gram + 1
    least = hashes
    while 2 * width <= whole:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = whole - width
    least = np.minimum(least[:-rest], least[rest:]) if rest else least
    return least, hashes[:len(least)] == least


def _blocks(bounds: np.ndarray, depth: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(begin, end, parts): stretches of bytes to hash together, and the parts of texts in them; texts longer than a
    block are hashed in overlapping parts."""
    begin, parts = 0, []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if parts and b - begin > BLOCK_BYTES:
            yield begin, parts[-1][1], parts
            parts = []
        if not parts:
            begin = a
        while b - a > BLOCK_BYTES + depth:
            end = a + BLOCK_BYTES + depth - 1
            yield a, end, [(a, end)]
            a = begin = a + BLOCK_BYTES
        parts.append((a, b))
    if parts:
        yield begin, parts[-1][1], parts


def strips(data: np.ndarray, bounds: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first suffix, suffixes, first digit) of the strips of texts that lie between ``bounds``: neighbours whose least
    hash is that of one place, so that no two suffixes of a strip are equal."""
    starts, sizes, digits = [], [], []
    for begin, end, parts in _blocks(bounds, depth):
        if end - begin < depth:
            continue
        digit, leaves = first_digits(data[begin:end], depth, gram)
        inside = np.zeros(end - begin + 1, np.int32)
        for a, b in parts:
            if b - a >= depth:
                inside[a - begin] += 1
                inside[b - begin - depth + 1] -= 1
        at = np.flatnonzero(np.cumsum(inside)[:len(digit)])
        if not len(at):
            continue
        found = digit[at]
        new = np.flatnonzero(np.concatenate(
            [[True], (np.diff(at) != 1) | (found[1:] != found[:-1]) | leaves[at[:-1]]]))
        n = np.diff(new, append=len(at))
        starts.append(at[new] + begin)
        sizes.append(n)
        digits.append(found[new])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(digits)


def repeated_strips(data: bytes, start: np.ndarray, size: np.ndarray, digit: np.ndarray, depth: int) -> np.ndarray:
    """Whether an earlier strip has the same bytes."""
    _, where, n = np.unique(digit, return_inverse=True, return_counts=True)
    again, seen = np.zeros(len(start), bool), set()
    for k in np.flatnonzero(n[where] > 1).tolist():
        strip = data[start[k]:start[k] + size[k] + depth - 1]
        if strip in seen:
            again[k] = True
        else:
            seen.add(strip)
    return again


def sort_suffixes(strips_: list[bytes], digit: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strip, offset, whether an earlier suffix of a strip is equal) of the repeated suffixes. Strips with one first
    digit meet; ``order`` has the strips' places in the corpus."""
    data = np.frombuffer(b"".join(strips_) + bytes(8), np.uint8)
    sizes = np.array([len(s) for s in strips_], np.int64)
    n = sizes - depth + 1
    strip = np.repeat(np.arange(len(strips_)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + offset
    word = data.astype(np.uint64)
    for width in (1, 2, 4):             # eight bytes from each place on, as one digit
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
    group = np.unique(digit, return_inverse=True)[1][strip]
    live = np.arange(len(strip))
    for place in [*range(0, depth - 7, 8), max(0, depth - 8)]:
        key = word[at[live] + place]
        by = np.lexsort((key, group))
        live, key, group = live[by], key[by], group[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]) if len(live) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1 if len(live) else new
        live, group = live[several], number[several]
        if not len(live):
            break
    by = np.lexsort((offset[live], order[strip[live]], group))
    live, group = live[by], group[by]
    later = np.concatenate([[False], group[1:] == group[:-1]]) if len(live) else np.zeros(0, bool)
    return strip[live], offset[live], later


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as disjoint ones in order."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by]) if len(by) else ends
    first = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(by) else np.zeros(0, bool)
    last = np.concatenate([first[1:], [True]]) if len(by) else first
    return starts[first], ends[last]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _struct(fields: str) -> T.StructType:
    return T._parse_datatype_string(fields)


_RUN = "run string, ids binary, nulls binary, ties binary, sizes binary, data binary, digits binary, times binary, n bigint"
_DIGITS = "radix int, run string, digits binary, times binary"
_FLAGS = "radix int, run string, flags binary, small bigint, large bigint"
_STRIPS = "radix int, run string, digits binary, ids binary, ties binary, places binary, sizes binary, data binary"
_GONE = "run string, starts binary, ends binary"


def _digits(run: dict) -> np.ndarray:
    return np.cumsum(unpack(run["digits"]).view(np.uint64), dtype=np.uint64)


def _pack_digits(sorted_: np.ndarray) -> bytes:
    return pack(np.diff(sorted_, prepend=np.uint64(0)).view(np.int64))


def _runs(docs: DataFrame, depth: int, gram: int, ties: bool, run_bytes: int) -> DataFrame:
    """Runs of documents (id, text) in the order of ids, with their first digits."""
    schema = _struct(_RUN)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = number = 0

        def closed() -> pa.RecordBatch:
            nonlocal held, size, number
            held.sort(key=lambda d: d[:3])
            data = b"".join(d[3] for d in held)
            sizes = np.array([len(d[3]) for d in held], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            start, n, digit = strips(np.frombuffer(data, np.uint8), bounds, depth, gram)
            again = repeated_strips(data, start, n, digit, depth)
            digits, times = np.unique(digit[~again], return_counts=True)
            record = {"run": f"{TaskContext.get().partitionId()}.{number}", "ids": pack(np.array([d[1] for d in held], np.int64)),
                      "nulls": pack(np.array([d[0] for d in held], np.int64)), "ties": pack(np.array([d[2] for d in held], np.int64)),
                      "sizes": pack(sizes), "data": zstandard.ZstdCompressor(level=6).compress(data),
                      "digits": _pack_digits(digits), "times": pack(times), "n": len(digits)}
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_pylist([record], schema=arrow)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                text = text.as_py() or b""
                tie = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True) if ties else 0
                held.append((i is None, 0 if i is None else i, tie, text))
                size += len(text) + 100
                if size >= run_bytes:
                    yield closed()
        if held:
            yield closed()

    return docs.mapInArrow(run, schema)


def _dealt(radix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each radix and what has it, in the order there was."""
    order = np.argsort(radix, kind="stable")
    bounds = [*np.flatnonzero(np.diff(radix[order], prepend=-1)), len(order)]
    for a, b in zip(bounds, bounds[1:]):
        yield int(radix[order[a]]), order[a:b]


def _first_pass(runs: DataFrame, radixes: int, large: int) -> DataFrame:
    """Of each run's first digits, in order and by radix: 0 if it is alone in the corpus, 1 if several strips have it, 2 if
    more than ``large``."""
    sliced, flagged = _struct(_DIGITS), _struct(_FLAGS)
    arrow, answer = _arrow(sliced), _arrow(flagged)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                digits, times = _digits(row), unpack(row["times"])
                out = [{"radix": r, "run": row["run"], "digits": _pack_digits(digits[mine]), "times": pack(times[mine])}
                       for r, mine in _dealt((digits % np.uint64(radixes)).astype(np.int64))]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_digits(r) for r in rows]
        _, where = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(where, np.concatenate([unpack(r["times"]) for r in rows])).astype(np.int64)[where]
        flags = np.where(n > large, 2, np.where(n > 1, 1, 0))
        out, at = [], 0
        for row, part in zip(rows, parts):
            mine, at = flags[at:at + len(part)], at + len(part)
            times = unpack(row["times"])
            out.append({"radix": row["radix"], "run": row["run"], "flags": zstandard.compress(mine.astype(np.uint8).tobytes()),
                        "small": int(times[mine == 1].sum()), "large": int(times[mine == 2].sum())})
        return pa.Table.from_pylist(out, schema=answer)

    return runs.select("run", "digits", "times").mapInArrow(deal, sliced).groupBy("radix").applyInArrow(meet, flagged)


def _later_passes(runs: DataFrame, flags: DataFrame, radixes: int, small_groups: int, large_groups: int, depth: int,
                  gram: int) -> DataFrame:
    """(run, starts, ends): ranges of suffixes that have an equal one at an earlier place."""
    shipped, gone = _struct(_STRIPS), _struct(_GONE)
    arrow, answer = _arrow(shipped), _arrow(gone)

    def ship(key: tuple, run: pa.Table, answers: pa.Table) -> pa.Table:
        row = run.to_pylist()[0]
        data, sizes = zstandard.decompress(row["data"]), unpack(row["sizes"])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        start, n, digit = strips(np.frombuffer(data, np.uint8), bounds, depth, gram)
        again = repeated_strips(data, start, n, digit, depth)
        digits = np.unique(digit[~again])           # as the run's row has them, which need not travel again
        flag = np.zeros(len(digits), np.uint8)
        order = np.argsort((digits % np.uint64(radixes)).astype(np.int64), kind="stable")
        answered = sorted(zip(answers["radix"].to_pylist(), answers["flags"].to_pylist()))
        if answered:
            flag[order] = np.concatenate([np.frombuffer(zstandard.decompress(f), np.uint8) for _, f in answered])
        of = flag[np.searchsorted(digits, digit)] if len(digits) else np.zeros(0, np.uint8)
        doc = np.searchsorted(bounds, start, "right") - 1
        ids = np.where(unpack(row["nulls"]) == 1, _LAST, unpack(row["ids"]))
        ties = unpack(row["ties"])
        out = []

        def slice_(radix: int, d: np.ndarray, at: np.ndarray, place: np.ndarray, many: np.ndarray, what: list[bytes]) -> dict:
            return {"radix": radix, "run": row["run"], "digits": pack(d.view(np.int64)), "ids": pack(ids[at]), "ties": pack(ties[at]),
                    "places": pack(np.diff(place, prepend=0)), "sizes": pack(many), "data": zstandard.compress(b"".join(what))}

        some = np.flatnonzero(~again & (of == 1))
        for r, mine in _dealt((digit[some] % np.uint64(small_groups)).astype(np.int64)):
            k = some[mine]
            out.append(slice_(r, digit[k], doc[k], start[k], n[k], [data[a:a + m + depth - 1] for a, m in zip(
                start[k].tolist(), n[k].tolist())]))
        # suffixes of hot first digits, by a digest each; the first in this run goes on
        first: dict[bytes, tuple[int, int]] = {}
        starts, ends = [start[again]], [start[again] + n[again]]
        local: list[int] = []
        for k in np.flatnonzero(~again & (of == 2)).tolist():
            for a in range(int(start[k]), int(start[k] + n[k])):
                digest = hashlib.blake2b(data[a:a + depth], digest_size=16).digest()
                if digest in first:
                    local.append(a)
                else:
                    first[digest] = a, int(doc[k])
        if first:
            second = np.frombuffer(b"".join(first), np.uint64).reshape(-1, 2)
            at = np.array(list(first.values()), np.int64)
            keys = list(first)
            for r, mine in _dealt((second[:, 1] % np.uint64(large_groups)).astype(np.int64)):
                out.append(slice_(small_groups + r, second[mine, 0].copy(), at[mine, 1], at[mine, 0], np.zeros(len(mine), np.int64),
                                  [keys[m] for m in mine.tolist()]))
        starts.append(np.array(local, np.int64))
        ends.append(np.array(local, np.int64) + 1)
        lo, hi = _ranges(np.concatenate(starts), np.concatenate(ends))
        out.append({"radix": -1, "run": row["run"], "places": pack(lo), "sizes": pack(hi)})
        return pa.Table.from_pylist(out, schema=arrow)

    def sort(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        radix = rows[0]["radix"]
        numbers = [unpack(r["sizes"]) for r in rows]
        n = np.concatenate(numbers)
        run = np.repeat(np.arange(len(rows)), [len(x) for x in numbers])
        place = np.concatenate([np.cumsum(unpack(r["places"])) for r in rows])
        order = np.empty(len(n), np.int64)
        order[np.lexsort((place, run, np.concatenate([unpack(r["ties"]) for r in rows]),
                          np.concatenate([unpack(r["ids"]) for r in rows])))] = np.arange(len(n))
        digit = np.concatenate([unpack(r["digits"]) for r in rows])
        strips_: list[bytes] = []
        for row, many in zip(rows, numbers):
            data, at = zstandard.decompress(row["data"]), 0
            for size in (many + depth - 1 if radix < small_groups else np.full(len(many), 16)).tolist():
                strips_.append(data[at:at + size])
                at += size
        # equal strips: only the first is sorted, all suffixes of the others go
        first: dict[bytes, int] = {}
        whole = []
        for k in np.argsort(order).tolist():
            if first.setdefault(strips_[k], k) != k:
                whole.append(k)
        whole_ = np.array(whole, np.int64)
        runs_, lo, hi = [run[whole_]], [place[whole_]], [place[whole_] + np.maximum(1, n[whole_])]
        if radix < small_groups:
            mine = np.sort(np.fromiter(first.values(), np.int64, len(first)))
            _, where, times = np.unique(digit[mine], return_inverse=True, return_counts=True)
            mine = mine[times[where] > 1]
            if len(mine):
                strip, offset, later = sort_suffixes([strips_[k] for k in mine.tolist()], digit[mine], order[mine], depth)
                k = mine[strip[later]]
                runs_.append(run[k])
                lo.append(place[k] + offset[later])
                hi.append(place[k] + offset[later] + 1)
        runs_, lo, hi = (np.concatenate(x) for x in (runs_, lo, hi))
        out = []
        for r, which in _dealt(runs_):
            a, b = _ranges(lo[which], hi[which])
            out.append({"run": rows[r]["run"], "starts": pack(a), "ends": pack(b)})
        return pa.Table.from_pylist(out, schema=answer)

    texts = runs.select("run", "ids", "nulls", "ties", "sizes", "data")
    sent = written(texts.groupBy("run").cogroup(flags.groupBy("run")).applyInArrow(ship, shipped), "suffix-strips", "none")
    own = sent.where("radix = -1").select("run", F.col("places").alias("starts"), F.col("sizes").alias("ends"))
    return own.unionAll(sent.where("radix >= 0").groupBy("radix").applyInArrow(sort, gone))


_RESULT = "id bigint, n_bytes bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary"


def _cut(runs: DataFrame, gone: DataFrame, depth: int) -> DataFrame:
    schema = _struct(_RESULT)
    arrow = _arrow(schema)

    def run(key: tuple, run_: pa.Table, gone_: pa.Table) -> pa.Table:
        row = run_.to_pylist()[0]
        data, sizes = zstandard.decompress(row["data"]), unpack(row["sizes"])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids, nulls = unpack(row["ids"]).tolist(), unpack(row["nulls"]).tolist()
        none = np.zeros(0, np.int64)
        starts = np.concatenate([none, *(unpack(x.as_py()) for x in gone_["starts"])])
        ends = np.concatenate([none, *(unpack(x.as_py()) for x in gone_["ends"])]) + depth - 1
        # ranges never leave a text, but may touch the next one's
        doc = np.searchsorted(bounds, starts, "right") - 1
        lo, hi = _ranges(starts + doc, ends + doc)
        doc = np.searchsorted(bounds + np.arange(len(bounds)), lo, "right") - 1
        lo, hi = lo - doc, hi - doc
        first = np.searchsorted(doc, np.arange(len(sizes) + 1))
        out = []
        for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            spans, kept, at = [], [], a
            for x, y in zip(lo[first[d]:first[d + 1]].tolist(), hi[first[d]:first[d + 1]].tolist()):
                spans.append({"begin": x - a, "end": y - a})
                kept.append(data[at:x])
                at = y
            kept.append(data[at:b])
            out.append({"id": None if nulls[d] else ids[d], "n_bytes": b - a, "spans": spans, "kept": b"".join(kept)})
        return pa.Table.from_pylist(out, schema=arrow)

    texts = runs.select("run", "ids", "nulls", "sizes", "data")
    return texts.groupBy("run").cogroup(gone.groupBy("run")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH, gram: int = GRAM,
                   run_bytes: int = RUN_BYTES, large: int = LARGE, group_digits: int = GROUP_DIGITS,
                   group_strips: int = GROUP_STRIPS) -> DataFrame:
    """(id, n_bytes, spans, kept) per row of ``docs``: the UTF-8 bytes of the text, the maximal removed spans (byte offsets,
    end exclusive) and the bytes that stay. ``gram`` is a power of two below ``depth``, which is 8 at least."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    ties = not source.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    runs = written(_runs(source, depth, gram, ties, run_bytes), "suffix-runs", "none")
    digits = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    radixes = max(8, math.ceil(digits / group_digits))
    flags = written(_first_pass(runs, radixes, large), "suffix-flags")
    met = flags.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("small", "large"))).first()
    small_groups, large_groups = (max(8, math.ceil(n / group_strips)) for n in (met["small"], met["large"]))
    gone = _later_passes(runs, flags, radixes, small_groups, large_groups, depth, gram)
    return _cut(runs, gone, depth)


ship_with_tasks(__name__)
