"""Column-level helpers (scalar expressions, constants)."""

from graphtables.functions.columns import (  # noqa: F401
    DAMPING,
    EDGE_WEIGHT,
    INITIAL_RANK,
    RESET,
    damp,
    edge_contribution,
    edge_partition_of,
    message_partition,
    message_position,
    modulo_partition,
    pack_message,
    position,
    position_is_dst,
    position_is_src,
    source_id_contribution,
)
