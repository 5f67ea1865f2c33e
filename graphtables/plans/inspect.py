"""Plan checks on the physical plan that ran.

``exchanges(df)`` lists the Exchange operators of ``df``'s own plan: for a
persisted DataFrame, the plan that filled the cache; reads of other cached
tables are leaves (their exchanges ran in an earlier job). The tree is read
from the JVM plan objects; ``plan_text`` gives what ``explain`` prints.
"""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "simple") -> str:
    """The text ``df.explain(mode)`` prints (after an action, AQE's final plan)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def _children(node):
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _unwrap(node):
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _unwrap(node.executedPlan())
    if name == "InMemoryTableScan":
        return _unwrap(node.relation().cachedPlan())
    return node


def _walk(node, out: list[str]) -> None:
    name = node.nodeName()
    if name in ("InMemoryTableScan", "ReusedExchange") or name.startswith("TableCacheQueryStage"):
        return
    if name == "AdaptiveSparkPlan":
        return _walk(node.executedPlan(), out)
    if "QueryStage" in name:
        return _walk(node.plan(), out)
    if name in ("Exchange", "BroadcastExchange", "ShuffleExchange"):
        out.append(node.simpleString(8))
    for child in _children(node):
        _walk(child, out)


def exchanges(df: DataFrame) -> list[str]:
    """Exchange operators of ``df``'s own plan (reused exchanges and cache reads excluded)."""
    out: list[str] = []
    _walk(_unwrap(df._jdf.queryExecution().executedPlan()), out)
    return out


def shuffle_exchanges(df: DataFrame) -> list[str]:
    """Exchanges that move rows between tasks by key (broadcasts excluded)."""
    return [e for e in exchanges(df) if not e.startswith("BroadcastExchange")]
