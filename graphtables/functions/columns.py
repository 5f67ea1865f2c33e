"""Column expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``,
so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rank recurrence: rank = RESET + DAMPING * sum(contrib),
# every vertex starts at INITIAL_RANK and every parsed edge weighs EDGE_WEIGHT.
RESET = 0.15
DAMPING = 0.85
INITIAL_RANK = 1.0
EDGE_WEIGHT = 1.0

# Fixed values of the packed routing column: the position (1 = source,
# 2 = destination, 3 = both) sits in the top 2 bits of a 32-bit INT, the
# edge partition in the low 30 bits.
POSITION_SHIFT = 30
PARTITION_MASK = 0x3FFFFFFF
SRC_BIT = 0x1
DST_BIT = 0x2


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def edge_contribution(weight: str | Column = "weight", rank: str | Column = "rank") -> Column:
    """The value an edge carries to its destination, ``weight * rank(src)``."""
    return _col(weight) * _col(rank)


def source_id_contribution(src: str | Column = "src_id", weight: str | Column = "weight") -> Column:
    """The literal second-program contribution, ``src_id * weight`` (BIGINT x DOUBLE)."""
    return _col(src).cast("double") * _col(weight)


def damp(total: str | Column = "total_contrib", reset: float = RESET,
         damping: float = DAMPING) -> Column:
    """P5: ``reset + damping * total``."""
    return F.lit(float(reset)) + F.lit(float(damping)) * _col(total)


def position(is_src: str | Column = "is_src", is_dst: str | Column = "is_dst") -> Column:
    """Position code of a vertex inside an edge partition: 1 src, 2 dst, 3 both, 0 neither."""
    return (F.when(_col(is_src), F.lit(SRC_BIT)).otherwise(F.lit(0))
            .bitwiseOR(F.when(_col(is_dst), F.lit(DST_BIT)).otherwise(F.lit(0))))


def pack_message(edge_partition: str | Column, pos: str | Column) -> Column:
    """Position in the top 2 bits, partition in the low 30 bits of one INT.

    The shift is done on INT, so position 2 and 3 set the sign bit exactly
    like a 32-bit integer shift does. A partition beyond 30 bits raises an error
    instead of being masked to another one.
    """
    upper = F.shiftleft(_col(pos).cast("int"), POSITION_SHIFT)
    number = _col(edge_partition).cast("int")
    lower = F.when(number.between(0, PARTITION_MASK), number).otherwise(
        F.raise_error(F.concat(F.lit("edge partition beyond 30 bits: "), number.cast("string"))).cast("int"))
    return upper.bitwiseOR(lower).cast("int")


def message_partition(message: str | Column = "message") -> Column:
    """Edge partition stored in a packed message."""
    return _col(message).bitwiseAND(F.lit(PARTITION_MASK)).cast("int")


def message_position(message: str | Column = "message") -> Column:
    """Position stored in a packed message; arithmetic shift, so 2 -> -2 and 3 -> -1.

    The low two bits of the signed value are still the flags (see
    :func:`position_is_src` / :func:`position_is_dst`).
    """
    return F.shiftright(_col(message), POSITION_SHIFT).cast("int")


def position_is_src(pos: str | Column) -> Column:
    return _col(pos).bitwiseAND(F.lit(SRC_BIT)) != 0


def position_is_dst(pos: str | Column) -> Column:
    return _col(pos).bitwiseAND(F.lit(DST_BIT)) != 0


def modulo_partition(key: str | Column, n: int) -> Column:
    """Reproducible edge-partition id ``pmod(key, n)`` as INT."""
    return F.pmod(_col(key), F.lit(int(n))).cast("int")


def partition_grid(n: int) -> tuple[int, int]:
    """(source rows, destination columns) of at most ``n`` edge partitions: about sqrt(n) each."""
    rows = math.isqrt(int(n))
    return rows, int(n) // rows


def edge_partition_of(src: str | Column = "src_id", dst: str | Column = "dst_id",
                      n: int = 1) -> Column:
    """Reproducible two-dimensional edge-partition id as INT, ``0 .. n-1``.

    ``pmod(src, r) * c + pmod(dst, c)`` with an ``r`` by ``c`` grid of about sqrt(n) each:
    a vertex is a source in at most ``c`` partitions and a destination in at most ``r``,
    so the routing table has at most about ``2 sqrt(n)`` rows a vertex, and a hot source
    is still spread over ``c`` partitions.
    """
    rows, columns = partition_grid(n)
    return (F.pmod(_col(src), F.lit(rows)) * F.lit(columns)
            + F.pmod(_col(dst), F.lit(columns))).cast("int")
