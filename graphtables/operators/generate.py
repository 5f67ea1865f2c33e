"""Rows from a caller's function (U1): each row of a table may give any number of rows.

The function is a table function that Python workers run over Arrow batches; a lateral join gives it the
columns it asks for and keeps the parent's columns beside every row it returns. A generator that built-in functions can
express (:func:`graphtables.operators.graph.endpoints`) is faster as an ``explode``; this is for those that they cannot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtables._workers import ship_with_tasks

RowFunction = Callable[..., Iterable]


def generate_rows(df: DataFrame, function: RowFunction, inputs: Sequence[str], output: str) -> DataFrame:
    """``df`` with the columns ``output`` (a schema, ``"id bigint"``) of the rows that ``function(*inputs)`` yields.

    A yielded value is a row of one column, a tuple one of several. A row for which nothing is yielded disappears."""
    class Rows:
        def eval(self, *values):
            for row in function(*values):
                yield row if isinstance(row, tuple) else (row,)

    made = F.udtf(Rows, returnType=output, useArrow=True)
    return df.lateralJoin(made(*(F.col(c).outer() for c in inputs)))


def both_ends(src: int, dst: int) -> tuple[int, int]:
    """The row function of the first program: an edge gives its two endpoints."""
    return src, dst


def endpoints_by_function(edges: DataFrame) -> DataFrame:
    """U1 through :func:`generate_rows`: one row per (edge, endpoint), parent columns kept."""
    return generate_rows(edges, both_ends, ["src_id", "dst_id"], "id bigint")


ship_with_tasks(__name__)
