import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from graphtables.llm import catalog, conversations
from tests.llm.samples import bag

SCHEMA = "conv_id long, turn long, role string, text string, slice int, seq int, parts string, cost string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(name.encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out[conv] += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def plain_repair(rows):
    """Least cost, then least letters, over all edits: a table of the best (cost, letters, rows) by state."""
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    faults, seen = [], set()
    for _, role, text in rows:
        found = BLANK.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen
                      else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))

    def inserted(best):
        for _ in range(3):
            for state, (cost, letters, kept) in list(best.items()):
                for to, name in (("u", "user"), ("a", "assistant")):
                    if (state, to) in grammar:
                        offer = (cost + 3, letters + "I", kept + [name + ":"])
                        if to not in best or offer < best[to]:
                            best[to] = offer
        return best

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, letters, kept) in inserted(best).items():
            offers = [(state, cost + 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                if (state, role[:1]) in grammar:
                    offers.append((role[0], cost + late, "K", [f"{role}:{text}"]))
                offers += [(to, cost + 3 + late, "R", [f"{name}:{text}"]) for to, name in (("u", "user"), ("a", "assistant"))
                           if (state, to) in grammar]
            for to, c, letter, line in offers:
                offer = (c, letters + letter, kept + line)
                if to not in new or offer < new[to]:
                    new[to] = offer
        best = new
    cost, audit, kept = min(v for k, v in inserted(best).items() if k in ("", "a"))
    return cost, audit, "\n".join(kept), faults


def plain_row(conv, rows):
    if not rows:
        return (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    cost, audit, text, faults = plain_repair(rows)
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def sample(seed=3, convs=60, hot=400):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "and then", "", " \n\t", None, "Why?", "漢字。", "ok.\n", "x" * 3000 + "."]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, 14)):
            rows.append((conv, 2 * turn + rng.choice([0, 1]), rng.choice(roles), rng.choice(texts) if rng.random() < .5
                         else f"Number {rng.random()}."))
    rows += [(1000, t, rng.choice(roles[:5]), rng.choice(["Yes.", "Same text", f"Number {t}."])) for t in range(hot)]
    rows += [(None, t, "user", "Null id.") for t in range(4)] + [(2000, None, "user", "All null."), (2001, 7, None, None)]
    rows += [(3000, t, "user", "Hi.") for t in range(30)] + [(3001, 5, "user", "Hi.")] * 3
    return rows


def run(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)
    parts = conversations.repair(conversations.damaged(table), present="present", **sizes)
    return [tuple(r) for r in conversations.summaries(parts).collect()]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 3}, {"block_bytes": 4000, "slice_bytes": 5000}])
def test_repair_by_brute_force(spark, sizes):
    """Whole conversations, blocks of three rows, and conversations over many slices."""
    rows = sample()
    assert bag(run(spark, rows, **sizes)) == bag(plain_row(c, r) for c, r in plain_damage(rows).items())


def test_hirschberg_equals_the_table_for_all_short_rows():
    kinds = [(role, text) for role in ("system", "user", "assistant", "tool") for text in ("a.", "b")]
    for n in range(5):
        for picked in itertools.product(kinds, repeat=n):
            rows = [(k, role, f"{k}{text}") for k, (role, text) in enumerate(picked)]
            if n == 4 and hash(picked) % 7:
                continue
            expected = plain_repair(rows)
            cost, letters = conversations.way("".join(conversations.kind_of(r[1], conversations.fault_of(r[2], False)) for r in rows), 0)
            done = conversations.apply_way(rows, letters, 0)
            assert (cost, "".join(letters)) == expected[:2], rows
            assert "\n".join(f"{r['role']}:{r['text']}" for r in done) == expected[2]


def test_every_original_conversation_comes_back(spark):
    dropped = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = run(spark, [(c, 0, "user", "Hi.") for c in dropped])
    assert bag(got) == bag(plain_row(c, []) for c in dropped)


def test_rows_of_one_turn_have_an_order_of_their_own(spark):
    rows = [(1, t // 4, role, f"{t}.") for t in range(40) for role in ("user", "assistant")]
    there = run(spark, rows)
    assert bag(run(spark, rows[::-1], block_rows=7)) == bag(there)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_op13_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = catalog.op13_conversation_repair(spark, "/root/testdata/sf0.01")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert bag(tuple(r) for r in got.collect()) == bag(plain_row(c, r) for c, r in plain_damage(rows).items())
