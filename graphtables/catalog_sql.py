"""DuckDB SQL text for the registered queries (the correctness oracle).

The same graphs and rank rounds as the Spark operators, spelled out as CTEs:
each round of the recurrence is one CTE. Literals are typed ``::DOUBLE``
(bare decimals are DECIMAL in DuckDB) and every double is rounded to 6
decimals, like the Spark queries.
"""

from __future__ import annotations

from graphtables.functions.columns import partition_grid

# ---- graphs -----------------------------------------------------------------

TG1 = ("SELECT l_partkey AS src_id, l_suppkey AS dst_id, 1.0::DOUBLE AS weight FROM lineitem "
       "WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL")

TG2 = ("SELECT CAST(s.s_nationkey AS BIGINT) AS src_id, CAST(c.c_nationkey AS BIGINT) AS dst_id, "
       "1.0::DOUBLE AS weight FROM lineitem l "
       "JOIN orders o ON l.l_orderkey = o.o_orderkey "
       "JOIN customer c ON o.o_custkey = c.c_custkey "
       "JOIN supplier s ON l.l_suppkey = s.s_suppkey "
       "WHERE s.s_nationkey IS NOT NULL AND c.c_nationkey IS NOT NULL")

TG3 = ("SELECT user_id AS src_id, next_user AS dst_id, 1.0::DOUBLE AS weight FROM ("
       "SELECT user_id, lead(user_id) OVER (PARTITION BY event_type "
       "ORDER BY ts ASC NULLS FIRST, event_id ASC NULLS FIRST) "
       "AS next_user FROM events) t WHERE user_id IS NOT NULL AND next_user IS NOT NULL")

TG4 = ("SELECT c_custkey + 1000 AS src_id, CAST(c_nationkey AS BIGINT) + 100 AS dst_id, "
       "1.0::DOUBLE AS weight FROM customer WHERE c_custkey IS NOT NULL AND c_nationkey IS NOT NULL "
       "UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 100 AS src_id, "
       "CAST(n_regionkey AS BIGINT) AS dst_id, 1.0::DOUBLE AS weight FROM nation "
       "WHERE n_nationkey IS NOT NULL AND n_regionkey IS NOT NULL")

TG4R = f"SELECT dst_id AS src_id, src_id AS dst_id, weight FROM ({TG4}) g"

TG4B = f"{TG4} UNION ALL {TG4R}"

GRAPH_SQL = {"TG4B": TG4B, "TG1": TG1, "TG2": TG2, "TG3": TG3, "TG4": TG4, "TG4R": TG4R}

VERTICES = "SELECT src_id AS id FROM e UNION SELECT dst_id AS id FROM e"
ENDPOINTS = ("SELECT src_id, dst_id, weight, src_id AS id FROM e "
             "UNION ALL SELECT src_id, dst_id, weight, dst_id AS id FROM e")
INCIDENCE_ROWS = f"SELECT id, 1.0::DOUBLE AS rank FROM (SELECT DISTINCT * FROM ({ENDPOINTS}) x) y"


def ep(n: int = 4) -> str:
    """The reproducible edge partition: ``pmod(src_id, r) * c + pmod(dst_id, c)``."""
    r, c = partition_grid(n)
    return f"CAST(((src_id % {r}) + {r}) % {r} * {c} + ((dst_id % {c}) + {c}) % {c} AS INTEGER)"


# ---- rank rounds ------------------------------------------------------------

def _sum_round(prev: str) -> str:
    return (f"SELECT e.dst_id AS id, SUM(e.weight * r.rank) AS s FROM e "
            f"JOIN {prev} r ON e.src_id = r.id GROUP BY e.dst_id")


def _round_cte(prev: str, missing: str) -> str:
    if missing == "drop":
        return f"SELECT id, 0.15::DOUBLE + 0.85::DOUBLE * s AS rank FROM ({_sum_round(prev)}) t"
    return (f"SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * COALESCE(t.s, 0.0::DOUBLE) AS rank "
            f"FROM v LEFT JOIN ({_sum_round(prev)}) t ON v.id = t.id")


def rank_ctes(graph_sql: str, k: int, init: str = "unique", missing: str = "drop",
              contribution: str = "rank") -> tuple[str, str]:
    """(WITH-clause body, name of the CTE holding ranks after ``k`` rounds)."""
    ctes = [f"e AS ({graph_sql})", f"v AS ({VERTICES})"]
    if init == "unique":
        ctes.append("r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM v)")
    else:
        ctes.append(f"r0 AS ({INCIDENCE_ROWS})")
    if k <= 0:
        return ", ".join(ctes), "r0"
    if contribution == "source_id":
        s = ("SELECT dst_id AS id, SUM(CAST(src_id AS DOUBLE) * weight) AS s FROM e GROUP BY dst_id")
        if missing == "retain":
            body = (f"SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * COALESCE(t.s, 0.0::DOUBLE) AS rank "
                    f"FROM v LEFT JOIN ({s}) t ON v.id = t.id")
        else:
            body = f"SELECT id, 0.15::DOUBLE + 0.85::DOUBLE * s AS rank FROM ({s}) t"
        ctes.append(f"r1 AS ({body})")
        return ", ".join(ctes), "r1"
    for i in range(1, k + 1):
        ctes.append(f"r{i} AS ({_round_cte(f'r{i - 1}', missing)})")
    return ", ".join(ctes), f"r{k}"


def rank_sql(graph: str, k: int, init: str = "unique", missing: str = "drop",
             contribution: str = "rank") -> str:
    body, last = rank_ctes(GRAPH_SQL[graph], k, init, missing, contribution)
    return f"WITH {body} SELECT id, round(rank, 6) AS rank FROM {last}"


# ---- routing ----------------------------------------------------------------

def routing_ctes(n: int = 4) -> str:
    return (f"e AS (SELECT src_id, dst_id, weight, {ep(n)} AS edge_partition FROM ({TG1}) g), "
            "rt AS (SELECT edge_partition, vertex_id, bool_or(is_src) AS is_src, "
            "bool_or(is_dst) AS is_dst FROM ("
            "SELECT edge_partition, src_id AS vertex_id, true AS is_src, false AS is_dst FROM e "
            "UNION ALL SELECT edge_partition, dst_id AS vertex_id, false AS is_src, true AS is_dst "
            "FROM e) x GROUP BY edge_partition, vertex_id)")


# ---- the oracle text per registered query -------------------------------------

def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _e(graph: str) -> str:
    return f"e AS ({GRAPH_SQL[graph]})"


_R1_TG1 = ("r1 AS (SELECT e.dst_id AS id, 0.15::DOUBLE + 0.85::DOUBLE * SUM(e.weight * 1.0::DOUBLE) "
           "AS rank FROM e GROUP BY e.dst_id)")
_R8_TG1 = ("r8 AS (SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * COALESCE(t.s, 0.0::DOUBLE) AS rank "
           f"FROM ({VERTICES}) v LEFT JOIN (SELECT dst_id AS id, SUM(weight * 1.0::DOUBLE) AS s "
           "FROM e GROUP BY dst_id) t ON v.id = t.id)")
_CONTRIB_TG1 = ("c AS (SELECT e.dst_id AS id, e.weight * r.rank AS contrib, "
                f"{ep()} AS edge_partition FROM e JOIN r1 r ON e.src_id = r.id)")
_SHIP = ("s AS (SELECT rt.edge_partition, r.id, r.rank FROM rt JOIN r8 r ON rt.vertex_id = r.id "
         "WHERE rt.is_src)")
_KEYED = "SELECT user_id AS key, {agg} AS value FROM events GROUP BY user_id"
_POS = "(CASE WHEN is_src THEN 1 ELSE 0 END + CASE WHEN is_dst THEN 2 ELSE 0 END)"

_SLOTS = ("SELECT id, row_number() OVER (ORDER BY ((id % 200) + 200) % 200, id) - 1 AS slot "
          f"FROM ({VERTICES}) v")

ORACLE: dict[str, str] = {
    "edge_parse": f"SELECT src_id, dst_id, weight FROM ({TG1}) g",
    "edge_file_roundtrip": f"SELECT src_id, dst_id, weight FROM ({TG1}) g",
    "edge_stream_roundtrip": f"SELECT src_id, dst_id, weight FROM ({TG1}) g",
    "edge_parse_permissive": f"SELECT src_id, dst_id, weight FROM ({TG1}) g",
    "edge_rejects": ("SELECT CAST(o_orderkey AS VARCHAR) || ' ' || CAST(o_custkey AS VARCHAR) "
                     "AS line FROM orders"),
    "successor_edges": TG3,
    "edge_collapse": _with(_e("TG2")) + (
        "SELECT src_id, dst_id, round(SUM(weight), 6) AS weight FROM e GROUP BY src_id, dst_id"),
    "edge_reverse": _with(_e("TG4")) + "SELECT dst_id AS src_id, src_id AS dst_id, weight FROM e",
    "edge_endpoints": _with(_e("TG3")) + ENDPOINTS,
    "vertex_set": _with(_e("TG1")) + f"SELECT id, 1.0::DOUBLE AS rank FROM ({VERTICES}) v",
    "vertex_incidence": _with(_e("TG3")) + (
        f"SELECT id, count(*) AS n FROM (SELECT DISTINCT * FROM ({ENDPOINTS}) x) y GROUP BY id"),
    "edge_rank_join": _with(_e("TG1"), _R1_TG1, _CONTRIB_TG1) + (
        "SELECT id, round(contrib, 6) AS contrib FROM c"),
    "contrib_sum": _with(_e("TG1"), _R1_TG1, _CONTRIB_TG1) + (
        "SELECT id, round(SUM(contrib), 6) AS total_contrib FROM c GROUP BY id"),
    "contrib_partial": _with(_e("TG1"), _R1_TG1, _CONTRIB_TG1) + (
        "SELECT edge_partition, id, round(SUM(contrib), 6) AS partial FROM c "
        "GROUP BY edge_partition, id"),
    "contrib_final": _with(_e("TG1"), _R1_TG1, _CONTRIB_TG1) + (
        "SELECT id, round(SUM(p), 6) AS total_contrib FROM (SELECT edge_partition, id, "
        "SUM(contrib) AS p FROM c GROUP BY edge_partition, id) x GROUP BY id"),
    "rank_damping": rank_sql("TG1", 2),
    "rank_step_drop": rank_sql("TG3", 1),
    "rank_step_retain": rank_sql("TG1", 1, missing="retain"),
    "source_id_mass": rank_sql("TG1", 1, missing="retain", contribution="source_id"),
    "rank_incidence_drop": rank_sql("TG3", 3, init="incidence"),
    "rank_unique_drop": rank_sql("TG1", 3),
    "rank_source_id": rank_sql("TG1", 3, missing="retain", contribution="source_id"),
    "rank_unique_retain": rank_sql("TG1", 3, missing="retain"),
    "rank_dag_drop": rank_sql("TG4", 2),
    "rank_dag_retain": rank_sql("TG4", 3, missing="retain"),
    "rank_zero_rounds": rank_sql("TG3", 0),
    "rank_incidence_zero": rank_sql("TG4", 0, init="incidence"),
    "rank_dense_drop": rank_sql("TG2", 2),
    "rank_hot_sources": rank_sql("TG4R", 3, missing="retain"),
    "rank_loop_hot_sources": rank_sql("TG4R", 3, missing="retain"),
    "routing_table": _with(routing_ctes()) + "SELECT * FROM rt",
    "routing_pack": _with(routing_ctes()) + (
        "SELECT vertex_id, CAST(CASE " + _POS + " WHEN 3 THEN -1073741824 + edge_partition "
        "WHEN 2 THEN -2147483648 + edge_partition WHEN 1 THEN 1073741824 + edge_partition "
        "ELSE edge_partition END AS INTEGER) AS message, edge_partition, "
        "CAST(CASE " + _POS + " WHEN 3 THEN -1 WHEN 2 THEN -2 ELSE " + _POS + " END AS INTEGER) "
        "AS position FROM rt"),
    "routing_vertices": _with(routing_ctes()) + (
        "SELECT vertex_id, count(*) AS n FROM rt GROUP BY vertex_id"),
    "routing_filter_src": _with(routing_ctes()) + "SELECT edge_partition, vertex_id FROM rt WHERE is_src",
    "routing_filter_dst": _with(routing_ctes()) + "SELECT edge_partition, vertex_id FROM rt WHERE is_dst",
    "routing_filter_both": _with(routing_ctes()) + "SELECT edge_partition, vertex_id FROM rt",
    "routing_filter_flags": _with(routing_ctes()) + (
        "SELECT edge_partition, f.src, f.dst, count(*) AS n FROM rt, (SELECT true AS src, true AS dst "
        "UNION ALL SELECT true, false UNION ALL SELECT false, true) f "
        "WHERE (f.src AND f.dst) OR (f.src AND is_src) OR (f.dst AND is_dst) GROUP BY ALL"),
    "edge_partitions": _with(routing_ctes()) + "SELECT CAST(max(edge_partition) + 1 AS INTEGER) AS n FROM rt",
    "routing_reverse": _with(routing_ctes()) + (
        "SELECT edge_partition, vertex_id, is_dst AS is_src, is_src AS is_dst FROM rt"),
    "routing_sizes": _with(routing_ctes()) + (
        "SELECT g.edge_partition, COALESCE(c.n, 0) AS n FROM "
        "(SELECT CAST(range AS INTEGER) AS edge_partition FROM range(6)) g LEFT JOIN "
        "(SELECT edge_partition, count(*) AS n FROM rt GROUP BY edge_partition) c "
        "ON g.edge_partition = c.edge_partition"),
    "routing_ship": _with(routing_ctes(), _R8_TG1, _SHIP) + (
        "SELECT edge_partition, id, round(rank, 6) AS rank FROM s"),
    "routing_triplets": _with(routing_ctes(), _R8_TG1, _SHIP) + (
        "SELECT e.edge_partition, e.src_id, e.dst_id, round(e.weight * s.rank, 6) AS contrib "
        "FROM e JOIN s ON e.edge_partition = s.edge_partition AND e.src_id = s.id"),
    "rank_routed": rank_sql("TG1", 3, missing="retain"),
    "id_union": _with(_e("TG1")) + VERTICES,
    "id_membership": _with(_e("TG1")) + (
        "SELECT DISTINCT src_id AS id FROM e WHERE src_id IN (SELECT dst_id FROM e)"),
    "lookup_default": _with(_e("TG1"), _R1_TG1, _CONTRIB_TG1) + (
        f"SELECT v.id, round(COALESCE(t.value, 0.0::DOUBLE), 6) AS value FROM ({VERTICES}) v "
        "LEFT JOIN (SELECT id, SUM(contrib) AS value FROM c GROUP BY id) t ON v.id = t.id"),
    "keyed_merge_sum": _KEYED.format(agg="CAST(SUM(event_id % 16) AS BIGINT)"),
    "keyed_merge_max": _KEYED.format(agg="MAX(event_id % 16)"),
    "keyed_merge_min": _KEYED.format(agg="MIN(event_id % 16)"),
    "keyed_merge_bit_or": _KEYED.format(agg="BIT_OR(event_id % 16)"),
    "keyed_merge_last": _KEYED.format(agg="ARG_MAX(event_id % 16, event_id)"),
    "layout_edges": _with(_e("TG1")) + (
        "SELECT src_id, dst_id, count(*) AS n_rows FROM e GROUP BY src_id, dst_id"),
    "layout_by_source": _with(_e("TG1")) + "SELECT count(*) AS rows, true AS ordered, true AS placed FROM e",
    "layout_edge_order": _with(_e("TG1")) + "SELECT count(*) AS rows, true AS ordered, true AS placed FROM e",
    "layout_vertices": _with(_e("TG1")) + (
        f"SELECT count(*) AS rows, true AS ordered, true AS placed FROM ({VERTICES}) v"),
    "split_partition_counts": _with(_e("TG1")) + (
        "SELECT src_id, dst_id, count(*) AS n, true AS in_range FROM e GROUP BY src_id, dst_id"),
    "rank_two_way_hub": rank_sql("TG4B", 3, missing="retain"),
    "rank_first_round_literal": rank_sql("TG1", 1, init="incidence"),
    "stage_metrics": _with(routing_ctes()) + (
        "SELECT 'build edges' AS stage, CAST(count(*) AS BIGINT) AS rows, true AS timed FROM "
        "(SELECT DISTINCT src_id, dst_id FROM e) x "
        "UNION ALL SELECT 'build routing tables', CAST(count(*) AS BIGINT), true FROM rt "
        f"UNION ALL SELECT s, CAST(count(*) AS BIGINT), true FROM ({VERTICES}) v, "
        "(SELECT unnest(['build vertices', 'iteration 1', 'iteration 2', 'iteration 3']) AS s) t GROUP BY s"),
    "stage_rows": _with(_e("TG1"), f"v AS ({VERTICES})",
                        "c AS (SELECT DISTINCT src_id, dst_id FROM e)",
                        "deg AS (SELECT src_id, count(*) AS n FROM c GROUP BY src_id)",
                        "hot AS (SELECT src_id FROM deg WHERE n > ceil((SELECT count(*) FROM c) / 8.0))",
                        "r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM v)",
                        "r1 AS (" + _round_cte("r0", "drop") + ")",
                        "r2 AS (" + _round_cte("r1", "drop") + ")",
                        "r3 AS (" + _round_cte("r2", "drop") + ")") + (
        "SELECT 'collapse edges' AS stage, CAST(count(*) AS BIGINT) AS rows FROM c "
        "UNION ALL SELECT 'find hot sources', CAST(count(*) AS BIGINT) FROM hot "
        "UNION ALL SELECT 'build edges', CAST(count(*) AS BIGINT) FROM c "
        "WHERE src_id NOT IN (SELECT src_id FROM hot) "
        "UNION ALL SELECT 'build edges (hot sources)', CAST(count(*) AS BIGINT) FROM c "
        "WHERE src_id IN (SELECT src_id FROM hot) HAVING count(*) > 0 "
        "UNION ALL SELECT 'build vertices', CAST(count(*) AS BIGINT) FROM v "
        "UNION ALL SELECT 'iteration 1', CAST(count(*) AS BIGINT) FROM r1 "
        "UNION ALL SELECT 'iteration 2', CAST(count(*) AS BIGINT) FROM r2 "
        "UNION ALL SELECT 'iteration 3', CAST(count(*) AS BIGINT) FROM r3"),
    "rank_loop_retain": rank_sql("TG1", 3, missing="retain"),
    "rank_loop_split": rank_sql("TG2", 2),
    "rank_loop_incidence": rank_sql("TG3", 3, init="incidence"),
    "rank_loop_checkpointed": rank_sql("TG1", 3, missing="retain"),
    "rank_loop_source_id": rank_sql("TG1", 3, missing="retain", contribution="source_id"),
    "rank_routed_blocks": rank_sql("TG1", 3, missing="retain"),
    "block_groups": _with(_e("TG1"),
                          "l AS (SELECT src_id % 8 AS part, src_id, dst_id, "
                          "length(src_id::VARCHAR || chr(9) || dst_id::VARCHAR) + 1 AS len FROM e)",
                          "o AS (SELECT part, src_id, sum(len) OVER (PARTITION BY part ORDER BY src_id, dst_id "
                          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len AS pos FROM l)",
                          "f AS (SELECT part, sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first "
                          "FROM (SELECT part, greatest(1, ceil(sum(len) / 16384.0)) AS n FROM l GROUP BY part))") + (
        # a line belongs to the split in which the line break before it lies
        "SELECT CAST(coalesce(first, 0) + CASE WHEN pos = 0 THEN 0 ELSE (pos - 1) // 16384 END AS INTEGER) AS edge_partition, "
        "count(*) AS n, count(DISTINCT src_id) AS sources FROM o JOIN f USING (part) GROUP BY 1"),
    "rank_resumed": rank_sql("TG1", 3, missing="retain"),
    "rank_resumed_hot": rank_sql("TG4R", 3, missing="retain"),
    "rank_resumed_incidence": rank_sql("TG3", 3, init="incidence"),
    "resumed_rounds": _with(rank_ctes(TG3, 3)[0]) + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS round, CAST(count(*) AS BIGINT) AS rows, CAST(1 AS INTEGER) AS started_at FROM r{i}"
        for i in (1, 2, 3)),
    "stored_edge_join": _with(_e("TG1")) + (
        "SELECT dst_id AS id, round(SUM(weight * 1.0::DOUBLE), 6) AS total_contrib FROM e GROUP BY dst_id"),
    "stored_placement": _with(_e("TG1")) + (
        "SELECT 'edges' AS stored, count(*) AS rows, true AS placed, true AS bounded FROM (SELECT DISTINCT src_id, dst_id FROM e) c "
        f"UNION ALL SELECT 'vertices', count(*), true, true FROM ({VERTICES}) v"),
    "vertex_slots": _with(_e("TG1")) + _SLOTS,
    "slot_edges": _with(_e("TG3"), f"s AS ({_SLOTS})") + (
        "SELECT a.slot AS src_id, b.slot AS dst_id, round(SUM(weight), 6) AS weight FROM e "
        "JOIN s a ON e.src_id = a.id JOIN s b ON e.dst_id = b.id GROUP BY ALL"),
    "bitmap_sizes": _with(_e("TG1")) + (
        "SELECT 'sources' AS ids, count(DISTINCT src_id) AS n FROM e UNION ALL SELECT 'destinations', count(DISTINCT dst_id) FROM e "
        f"UNION ALL SELECT 'either', count(*) FROM ({VERTICES}) v "
        "UNION ALL SELECT 'both', count(DISTINCT src_id) FROM e WHERE src_id IN (SELECT dst_id FROM e)"),
    "bitmap_union": _with(_e("TG1")) + VERTICES,
    "bitmap_membership": _with(_e("TG1")) + (
        "SELECT DISTINCT src_id AS id FROM e WHERE src_id IN (SELECT dst_id FROM e)"),
    "keyed_upsert_sum": _KEYED.format(agg="CAST(SUM(event_id % 16) AS BIGINT)"),
    "keyed_upsert_last": _KEYED.format(agg="ARG_MAX(event_id % 16, event_id)"),
    "routing_by_messages": _with(routing_ctes()) + "SELECT * FROM rt",
    "edge_endpoints_function": _with(_e("TG3")) + ENDPOINTS,
}

ORACLE["stage_rows_observed"] = ORACLE["stage_rows"]
