"""Plain-Python evaluation of the rank variants (the test oracle for toy graphs)."""

from collections import Counter, defaultdict

RESET, DAMPING = 0.15, 0.85


def vertex_set(edges):
    return {v for s, d in edges for v in (s, d)}


def incidence_counts(edges):
    n = Counter()
    for s, d in set(edges):
        for v in {s, d}:
            n[v] += 1
    return n


def rank(edges, k, init="unique", missing="drop", contribution="rank"):
    """dict id -> rank after k rounds (k = 0: the summed round-0 table)."""
    verts = vertex_set(edges)
    if init == "unique":
        ranks = {v: 1.0 for v in verts}
    else:
        ranks = {v: float(c) for v, c in incidence_counts(edges).items()}
    for _ in range(k):
        total = defaultdict(float)
        got = set()
        for s, d in edges:
            if contribution == "source_id":
                total[d] += float(s)
                got.add(d)
            elif s in ranks:
                total[d] += ranks[s]
                got.add(d)
        keep = verts if missing == "retain" else got
        ranks = {v: RESET + DAMPING * total.get(v, 0.0) for v in keep}
    return ranks


def rank_weighted(edges, k, missing="drop", reset=RESET, damping=DAMPING):
    """Unique start, weighted edges ``(src, dst, w)``: contribution ``w * rank(src)``."""
    verts = {v for s, d, _ in edges for v in (s, d)}
    ranks = {v: 1.0 for v in verts}
    for _ in range(k):
        total = defaultdict(float)
        got = set()
        for s, d, w in edges:
            if s in ranks:
                total[d] += w * ranks[s]
                got.add(d)
        keep = verts if missing == "retain" else got
        ranks = {v: reset + damping * total.get(v, 0.0) for v in keep}
    return ranks
