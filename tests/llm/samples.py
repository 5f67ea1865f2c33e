"""Small tables of awkward rows that all operator tests share."""

from __future__ import annotations

import random

CLASHING = "doc_id long, text string, id string, row long, n_words long, fp long, block long, part long, spans string, cell int"


def awkward_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = ["the", "of", "Alpha", "beta", "GAMMA", "é", "naïve", "x1", "漢字", "straße", "--", "#", "token"]

    def text(n: int) -> str:
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(n))

    long = text(30_000)
    copy = text(60)
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t\n "), (4, "one"), (5, "one two three"), (6, "one two three four"),
        (7, copy), (8, copy), (9, copy + " more"), (10, long), (11, long + "end"), (None, copy), (None, None),
        (12, "a\x01b\x0cc\x0bd  e"), (12, "a\x01b\x0cc\x0bd  e"), (7, copy), (13, "\n\n\n"),
        (14, "　wide space\u0085x"), (15, "😀 " * 40), (16, "a" * 5000)]
    return rows + [(100 + i, text(rng.randint(1, 120))) for i in range(40)]


def frame(spark, rows=None, partitions: int = 3):
    """The rows with further columns whose names operators use themselves."""
    rows = awkward_texts() if rows is None else rows
    data = [(i, t, "x", 1, -1, 2, 3, 4, "s", 5) for i, t in rows]
    return spark.createDataFrame(data, CLASHING).repartition(partitions) if data else spark.createDataFrame([], CLASHING)


def bag(rows) -> list:
    return sorted(rows, key=repr)
