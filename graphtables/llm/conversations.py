"""Repair of the structure of conversations by Hirschberg's divide and conquer.

The rows of a conversation, by turn (nulls first; rows of one turn by role, then by a hash of
role and text), are edited so that the roles' initials read ``(s?(ua)+)?``. Four states say what
was last: nothing, s, u, a. Edits cost: Keep 0, Rerole (to user or assistant) 3, Delete 4 (the only edit of a blank or
duplicate row), Insert of an empty user or assistant text anywhere 3; an undeleted truncated row adds 3.
Of the cheapest edits, the ones whose letters come first in ASCII are taken.

Method. A row is a *step*: for each state before it the cheapest way (inserts, then one edit)
to each state after it, and the order of those ways' letters. A forward pass over the first half of the
steps gives four costs, and the order of the four best letter strings (no two are a prefix of one
another, so later letters never change their order). A backward pass over the second half gives four
costs. They meet in the middle: of the crossings of least total cost the one whose letters come first is taken,
and both halves recurse. Memory is linear.

Distribution. Rows are range-partitioned by (conversation, turn) into slices of bounded size, so that one
conversation may span many. Conversations that lie inside a slice are repaired there. The others leave the slice as blocks of at
most ``block_rows`` rows and ``block_bytes`` bytes. Of those, duplicates are found by an aggregation over hashed texts;
each block is summed up as one step (costs from each state to each state); the
crossings between blocks are chosen by the same recursion over those steps, and every block is then
repaired between its two states. A task never holds more than one block and the steps of a conversation.

Null conversation ids are one conversation. Null roles and texts are one space: such a text is
blank; such a role, like the empty or any other, is no legal initial. Null turns come first and do not count
in gaps. Equal rows are duplicates of the first. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtables._workers import ship_with_tasks
from graphtables.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: bytes of text of a slice, about
SLICE_BYTES = 32 << 20
#: rows and bytes of text of a block of a conversation that does not fit into one
BLOCK_ROWS, BLOCK_BYTES = 20_000, 4 << 20

_WHITE = " \t\n\x0b\x0c\r"
_ROLES = {2: "user", 3: "assistant"}
#: the state after an insert (or a rerole) in each state: u after nothing, s and a, a after u
_NEXT = (2, 2, 3, 2)
#: (state before, initial) -> state after a kept row
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: cost and inserts from each state to a legal end
_END = (0, 2 * INSERT, INSERT, 0)
_END_INSERTS = (0, 2, 1, 0)
_FAULTS = ("", "truncated", "blank", "duplicate")
_INF = math.inf

Step = list[list[tuple[int, float, int]]]       # state before -> (state after, cost, order among them)


def _ways(initial: str, fault: int) -> list[dict[int, tuple[int, str]]]:
    """For each state before a row: state after it -> (cost, letters) of the best way."""
    out = []
    for before in range(4):
        best: dict[int, tuple[int, str]] = {}

        def offer(after: int | None, cost: int, letters: str) -> None:
            if after is not None and (after not in best or (cost, letters) < best[after]):
                best[after] = (cost, letters)

        state = before
        for n in range(3):              # after two inserts the states repeat
            cost, letters, late = n * INSERT, "I" * n, TRUNCATED if fault == 1 else 0
            offer(state, cost + DELETE, letters + "D")
            if fault < 2:
                offer(_KEPT.get((state, initial)), cost + KEEP + late, letters + "K")
                offer(_NEXT[state], cost + REROLE + late, letters + "R")
            state = _NEXT[state]
        out.append(best)
    return out


def _as_step(ways: list[dict[int, tuple[int, str]]]) -> Step:
    step = []
    for best in ways:
        order = {t: k for k, t in enumerate(sorted(best, key=lambda t: best[t][1]))}
        step.append([(t, cost, order[t]) for t, (cost, _) in best.items()])
    return step


#: a row's kind: its initial (s, u, a or another) and its fault, as a letter
_INITIALS = "sua?"
WAYS = {chr(65 + 4 * i + f): _ways(c, f) for i, c in enumerate(_INITIALS) for f in range(4)}
STEPS = {kind: _as_step(ways) for kind, ways in WAYS.items()}


def kind_of(role: str, fault: int) -> str:
    return chr(65 + 4 * (_INITIALS.index(role[0]) if role[:1] in ("s", "u", "a") else 3) + fault)


def fault_of(text: str, seen: bool) -> int:
    """The first fault of a row, as a place in ``_FAULTS``."""
    bare = text.rstrip(_WHITE)
    return 2 if not bare else 3 if seen else 1 if bare[-1] not in ".!?" else 0


def forward(steps: list[Step], lo: int, hi: int, costs: list[float], order: list[int]) -> tuple[list[float], list[int]]:
    """The costs of reaching each state after steps lo..hi-1, and the order of the best letters."""
    for i in range(lo, hi):
        best: list[tuple[float, int, int] | None] = [None] * 4
        for before, ways in enumerate(steps[i]):
            if costs[before] < _INF:
                base, rank = costs[before], order[before]
                for after, cost, letters in ways:
                    offer = (base + cost, rank, letters)
                    if best[after] is None or offer < best[after]:
                        best[after] = offer
        costs, order = [b[0] if b else _INF for b in best], [0] * 4
        for k, t in enumerate(sorted((t for t in range(4) if best[t]), key=lambda t: best[t][1:])):
            order[t] = k
    return costs, order


def backward(steps: list[Step], lo: int, hi: int, costs: tuple | list) -> list[float]:
    """The costs from each state before step lo to the end, given those after step hi-1."""
    for i in range(hi - 1, lo - 1, -1):
        costs = [min((cost + costs[after] for after, cost, _ in ways), default=_INF) for ways in steps[i]]
    return list(costs)


def crossings(steps: list[Step], state: int, end: tuple | list) -> list[int]:
    """The state after each step on the best way from ``state``; ``end`` has the costs after the last."""
    out = [0] * len(steps)
    todo = [(0, len(steps), state, list(end))]
    while todo:
        lo, hi, start, end = todo.pop()
        if hi <= lo:
            continue
        mid = max(lo + 1, (lo + hi) // 2)
        costs, order = forward(steps, lo, mid, [0 if s == start else _INF for s in range(4)], [0] * 4)
        rest = backward(steps, mid, hi, end)
        cross = min(range(4), key=lambda s: (costs[s] + rest[s], order[s]))
        out[mid - 1] = cross
        if mid - lo > 1:
            todo.append((lo, mid, start, [0 if s == cross else _INF for s in range(4)]))
        todo.append((mid, hi, cross, end))
    return out


def block_step(steps: list[Step]) -> Step:
    """Many steps as one."""
    out = []
    for state in range(4):
        costs, order = forward(steps, 0, len(steps), [0 if s == state else _INF for s in range(4)], [0] * 4)
        out.append([(t, costs[t], order[t]) for t in range(4) if costs[t] < _INF])
    return out


def way(kinds: str, state: int, end: tuple | list = _END) -> tuple[int, list[str]]:
    """(cost without what follows, letters of each row) of the best way through rows of these kinds."""
    cost, letters, before = 0, [], state
    for kind, after in zip(kinds, crossings([STEPS[k] for k in kinds], state, end)):
        one, text = WAYS[kind][before][after]
        cost, before = cost + one, after
        letters.append(text)
    if end is _END:
        cost += _END[before]
        letters.append("I" * _END_INSERTS[before])
    return cost, letters


@lru_cache(maxsize=50_000)
def _whole_way(kinds: str) -> tuple[int, tuple[str, ...]]:
    cost, letters = way(kinds, 0)
    return cost, tuple(letters)


def apply_way(rows: list[tuple], letters, state: int) -> list[dict]:
    """The repaired rows (role, text) of ``rows`` (turn, role, text) from a state."""
    out = []

    def insert(n: int) -> None:
        nonlocal state
        for _ in range(n):
            state = _NEXT[state]
            out.append({"role": _ROLES[state], "text": ""})

    for row, one in zip(rows, letters):
        insert(len(one) - 1)
        _, role, text = row
        if one[-1] == "K":
            state = _KEPT[state, role[0]]
            out.append({"role": role, "text": text})
        elif one[-1] == "R":
            state = _NEXT[state]
            out.append({"role": _ROLES[state], "text": text})
    if len(letters) > len(rows):
        insert(len(letters[-1]))
    return out


def _illegal(a: str, b: str) -> bool:
    return a[:1] + b[:1] not in ("su", "ua", "au")


def _measures(rows: list[tuple], faults: list[int]) -> dict:
    turns = sorted({t for t, _, _ in rows if t is not None})
    return {"turns": [turns[0], turns[-1], len(turns)] if turns else [],
            "blank": faults.count(2), "duplicate": faults.count(3), "truncated": faults.count(1),
            "illegal": sum(_illegal(a[1], b[1]) for a, b in zip(rows, rows[1:]))}


_ROW = "struct<turn: bigint, role: string, text: string>"
_MEASURES = "turns array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_REPAIRED = "audit string, repaired array<struct<role: string, text: string>>"


def _schema(table: DataFrame, fields: str) -> T.StructType:
    """The conversation's column and these fields."""
    return T.StructType([table.schema["conv"], *T._parse_datatype_string(fields).fields])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(records: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema=schema)


def _slices(rows: DataFrame, slice_bytes: int, block_rows: int, block_bytes: int) -> DataFrame:
    """One row per finished conversation, and the rows of those that may span slices as blocks."""
    spark = rows.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 40), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / slice_bytes))
    keys = ["conv", "turn", "role", F.xxhash64("role", "text")]
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = _schema(rows, f"slice int, seq int, {_MEASURES}, cost bigint, parts bigint, {_REPAIRED}, rows array<{_ROW}>")
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seq = TaskContext.get().partitionId(), 0
        out: list[dict] = []
        held = 0
        first = True                    # the first and the last conversation may go on elsewhere
        now: list[tuple] = []
        present, bytes_, broken, current, any_rows = False, 0, False, None, False

        def block() -> dict:
            nonlocal seq, now, bytes_
            record = {"conv": current, "slice": number, "seq": seq,
                      "rows": [dict(zip(("turn", "role", "text"), r)) for r in now]}
            seq, now, bytes_ = seq + 1, [], 0
            return record

        def finished() -> dict:
            nonlocal seq, now, bytes_
            seen: set = set()
            faults = []
            for _, role, text in now:
                faults.append(fault_of(text, (role, text) in seen))
                seen.add((role, text))
            kinds = "".join(kind_of(r[1], f) for r, f in zip(now, faults))
            cost, letters = _whole_way(kinds) if len(kinds) <= 64 else way(kinds, 0)
            record = {"conv": current, "slice": number, "seq": seq, "cost": cost, "parts": 1, "audit": "".join(letters),
                      "repaired": apply_way(now, letters, 0), **_measures(now, faults)}
            seq, now, bytes_ = seq + 1, [], 0
            return record

        for batch in batches:
            for conv, turn, role, text, there in zip(*(c.to_pylist() for c in batch.columns)):
                if not any_rows or conv != current:
                    if any_rows:
                        held += bytes_
                        out.append(block() if first or broken else finished())
                        first, broken = False, False
                        if len(out) >= 1000 or held > block_bytes:
                            yield _batch(out, arrow)
                            out, held = [], 0
                    current, any_rows = conv, True
                if there:
                    size_ = len(text)
                    if now and (len(now) >= block_rows or bytes_ + size_ > block_bytes):
                        held, broken = held + bytes_, True
                        out.append(block())
                        if held > block_bytes:
                            yield _batch(out, arrow)
                            out, held = [], 0
                    now.append((turn, role, text))
                    bytes_ += size_
        if any_rows:
            out.append(block())
        if out:
            yield _batch(out, arrow)

    return placed.select("conv", "turn", "role", "text", "present").mapInArrow(run, schema)


def _first_rows(blocks: DataFrame) -> DataFrame:
    """(slice, seq, firsts): of each block the numbers of the rows whose role and text are new in
    their conversation."""
    flat = blocks.select("conv", "slice", "seq", F.posexplode("rows").alias("i", "row"))
    content = F.sha2(F.concat(F.octet_length("row.role").cast("string"), F.lit(":"), "row.role", "row.text").cast("binary"), 256)
    return flat.groupBy("conv", content.alias("content")).agg(F.min(F.struct("slice", "seq", "i")).alias("at")).groupBy(
        F.col("at.slice").alias("slice"), F.col("at.seq").alias("seq")).agg(F.collect_list("at.i").alias("firsts"))


def _kinds(rows: list[dict], firsts: list[int] | None) -> tuple[list[tuple], list[int], str]:
    new = set(firsts or ())
    plain = [(r["turn"], r["role"], r["text"]) for r in rows]
    faults = [fault_of(r[2], i not in new) for i, r in enumerate(plain)]
    return plain, faults, "".join(kind_of(r[1], f) for r, f in zip(plain, faults))


def _summaries(blocks: DataFrame) -> DataFrame:
    """One step of each block with what its conversation's measures need."""
    schema = _schema(blocks, f"slice int, seq int, {_MEASURES}, step array<bigint>, ends array<string>")
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, number, seq, rows, firsts in zip(*(c.to_pylist() for c in batch.columns)):
                plain, faults, kinds = _kinds(rows, firsts)
                step = block_step([STEPS[k] for k in kinds])
                flat = [x for before, ways in enumerate(step) for after, cost, order in ways
                        for x in (before, after, cost, order)]
                out.append({"conv": conv, "slice": number, "seq": seq, "step": flat,
                            "ends": [plain[0][1], plain[-1][1]] if plain else [], **_measures(plain, faults)})
            if out:
                yield _batch(out, arrow)

    return blocks.select("conv", "slice", "seq", "rows", "firsts").mapInArrow(run, schema)


def _joined(summaries: DataFrame) -> DataFrame:
    """Of each block the states before and after it, whether it is the last one, and its conversation's measures."""
    schema = _schema(summaries, f"slice int, seq int, before int, after int, last boolean, {_MEASURES}, cost bigint, parts bigint")
    arrow = _arrow(schema)

    def run(table: pa.Table) -> pa.Table:
        blocks = sorted(table.to_pylist(), key=lambda b: (b["slice"], b["seq"]))
        steps = []
        for b in blocks:
            step: Step = [[], [], [], []]
            for k in range(0, len(b["step"]), 4):
                before, after, cost, order = b["step"][k:k + 4]
                step[before].append((after, cost, order))
            steps.append(step)
        after = crossings(steps, 0, _END)
        total = {x: sum(b[x] for b in blocks) for x in ("blank", "duplicate", "truncated", "illegal")}
        low = high = end = None
        distinct = 0
        for b in blocks:
            if b["turns"]:
                first, last, n = b["turns"]
                distinct += n - (high is not None and first == high)
                low, high = first if low is None else low, last
            if b["ends"]:
                total["illegal"] += end is not None and _illegal(end, b["ends"][0])
                end = b["ends"][1]
        before = [0, *after[:-1]]
        cost = sum(next(c for t, c, _ in step[s] if t == x) for step, s, x in zip(steps, before, after)) + _END[after[-1]]
        return pa.Table.from_pylist(
            [{"conv": b["conv"], "slice": b["slice"], "seq": b["seq"], "before": s, "after": x, "last": b is blocks[-1],
              "turns": [low, high, distinct] if low is not None else [], **total, "cost": cost, "parts": len(blocks)}
             for b, s, x in zip(blocks, before, after)], schema=arrow)

    return summaries.groupBy("conv").applyInArrow(run, schema)


def _repaired(blocks: DataFrame) -> DataFrame:
    """The audit and rows of each block between its states."""
    schema = _schema(blocks, f"slice int, seq int, {_MEASURES}, cost bigint, parts bigint, {_REPAIRED}")
    arrow = _arrow(schema)
    kept = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                plain, _, kinds = _kinds(b["rows"], b["firsts"])
                end = _END if b["last"] else [0 if s == b["after"] else _INF for s in range(4)]
                _, letters = way(kinds, b["before"], end)
                out.append({**{k: b[k] for k in kept}, "audit": "".join(letters),
                            "repaired": apply_way(plain, letters, b["before"])})
            if out:
                yield _batch(out, arrow)

    return blocks.mapInArrow(run, schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: str | None = None, slice_bytes: int = SLICE_BYTES, block_rows: int = BLOCK_ROWS,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per part of a conversation, most have one: conv, slice, seq (the parts' order), turns (least,
    greatest, distinct; empty without any), blank, duplicate, truncated, illegal and cost of the whole conversation,
    and the part's audit and repaired rows. Rows whose column ``present`` is false only name their conversation."""
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)

    def known(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    source = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), known(role).alias("role"),
                         known(text).alias("text"), there.alias("present"))
    done = written(_slices(source, slice_bytes, block_rows, block_bytes), "conversations")
    blocks = done.where("cost is null").select("conv", "slice", "seq", "rows")
    blocks = blocks.join(_first_rows(blocks), ["slice", "seq"], "left").select("conv", "slice", "seq", "rows", "firsts")
    blocks = written(blocks, "conversation-blocks")
    chosen = written(_joined(_summaries(blocks)), "conversation-states")
    parts = _repaired(blocks.join(chosen.drop("conv"), ["slice", "seq"]))
    return done.where("cost is not null").drop("rows").unionByName(parts)


def _streamed(parts: DataFrame) -> DataFrame:
    """One row per conversation of several parts: a task reads them in order and holds one of them at a time."""
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([parts.schema["conv"], *(T.StructField(f, T.LongType()) for f in fields),
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)
    placed = parts.repartition("conv").sortWithinPartitions("conv", "slice", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, lines = None, hashlib.sha256(), 0

        def closed() -> pa.RecordBatch:
            return _batch([{**now, "audit": "".join(now["audit"]), "repaired_sha256": digest.hexdigest()}], arrow)

        for batch in batches:
            for part in batch.to_pylist():
                if now is None or part["conv"] != now["conv"]:
                    if now is not None:
                        yield closed()
                    now, digest, lines = {"conv": part["conv"], **{f: part[f] for f in fields}, "audit": []}, hashlib.sha256(), 0
                now["audit"].append(part["audit"])
                if part["n"]:
                    digest.update((("\n" if lines else "") + part["text"]).encode())
                    lines += part["n"]
        if now is not None:
            yield closed()

    return placed.mapInArrow(run, schema)


def summaries(parts: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair`: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, and
    ``repaired_sha256`` of its repaired ``role:text`` rows joined by newlines."""
    turn = [F.get("turns", F.lit(k)) for k in range(3)]
    line = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    named = parts.select("conv", "slice", "seq", "parts", F.coalesce(turn[1] - turn[0] + 1 - turn[2], F.lit(0)).cast("long")
                         .alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                         F.array_join(line, "\n").alias("text"), F.size("repaired").alias("n"))
    whole = named.where("parts = 1").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                            F.sha2(F.col("text").cast("binary"), 256).alias("repaired_sha256"))
    return whole.unionByName(_streamed(named.where("parts > 1").drop("parts")))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Test damage by crc32(``conv:turn``) modulo 20: 0 drops a row (``present`` is false), 1 empties its text, 2 removes
    the ``.!?`` of it, 3 repeats it, 4 makes its role user; nulls are one space."""
    def known(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(known(conv), F.lit(":"), known(turn)).cast("binary")) % 20
    return rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.when(case == 4, "user").otherwise(known(role)).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(known(text), "[.!?]", "")).otherwise(known(text)).alias("text"),
        (case != 0).alias("present"),
        F.explode(F.when(case == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))


ship_with_tasks(__name__)
