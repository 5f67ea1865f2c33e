"""Graph tables on Spark: iterative ranking over edge tables with DataFrame operators.

Subpackages:

* ``sources``   edge-list text ingest and sink, graphs derived from tables
* ``functions`` column expressions and the fixed constants of the recurrence
* ``operators`` vertices, incidences, rank steps, routing tables, keyed tables, layout
* ``plans``     the materialising round loop, stage metrics, plan inspection
* ``streaming`` the edge-list source as a stream
"""

from graphtables.operators.graph import (  # noqa: F401
    collapse_edges,
    endpoints,
    incidence_counts,
    incidence_vertices,
    incidences,
    reverse_edges,
    vertex_ids,
    vertices,
)
from graphtables.operators.rank import rank, rank_step_drop, rank_step_retain  # noqa: F401
from graphtables.sources.edges import edges_from, parse_edges, read_edges  # noqa: F401
from graphtables.plans.loop import RankLoop  # noqa: F401,E402
from graphtables.plans.durable import DurableRankLoop  # noqa: F401,E402
