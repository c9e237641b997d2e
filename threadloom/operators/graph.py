"""Depth, main path and nearest tool call of the nodes of a conversation.

A conversation's graph is one row, so one narrow pass in Arrow batches suffices: linear in the nodes, no join,
no shuffle, and safe against cycles. depth_by_sql does the same for chains and trees in a recursive query.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "array<struct<id:string,depth:int,main_path_index:int,call_node:string>>"


def walk(nodes: list[dict], current: str | None) -> list[dict]:
    """nodes: id, parent, children, call_as (the id by which a tool call is found, or null). A parent cycle ends the main path where it would repeat."""
    parent = {n["id"]: n["parent"] for n in nodes}
    children = {n["id"]: n["children"] or [] for n in nodes}
    calls = {n["call_as"] for n in nodes if n.get("call_as")}
    depth = {n["id"]: 0 for n in nodes if n["parent"] is None}
    queue = deque(depth)
    while queue:
        at = queue.popleft()
        for child in children.get(at, ()):
            if child not in depth:
                depth[child] = depth[at] + 1
                queue.append(child)
    path, seen, at = [], set(), current
    while at and at in parent and at not in seen:
        seen.add(at)
        path.append(at)
        at = parent[at]
    index = {n: i for i, n in enumerate(reversed(path))}

    nearest: dict[str, str | None] = {}

    def call_above(node: str) -> str | None:
        trail, met, at = [], set(), parent.get(node)
        while at and at not in met:
            if at in calls:
                found = at
                break
            if at in nearest:
                found = nearest[at]
                break
            met.add(at)
            trail.append(at)
            at = parent.get(at)
        else:
            found = None
        for t in trail:
            nearest[t] = found
        return found

    return [{"id": n["id"], "depth": depth.get(n["id"]), "main_path_index": index.get(n["id"]), "call_node": call_above(n["id"])} for n in nodes]


def has_cycle(parent: dict[str, str | None]) -> bool:
    done: set[str] = set()
    for start in parent:
        trail, at = set(), start
        while at is not None and at in parent and at not in done:
            if at in trail:
                return True
            trail.add(at)
            at = parent[at]
        done |= trail
    return False


def with_graph(rows: DataFrame, nodes: str = "nodes", current: str = "current_node", name: str = "graph") -> DataFrame:
    """rows with the walked graph of `nodes` (array of struct id, parent, children, call_as) added."""

    @F.arrow_udf(GRAPH)
    def walked(nodes: pa.Array, current: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("id", pa.string()), ("depth", pa.int32()), ("main_path_index", pa.int32()), ("call_node", pa.string())]))
        return pa.array([walk(n or [], c) for n, c in zip(nodes.to_pylist(), current.to_pylist())], kind)

    return rows.withColumn(name, walked(F.col(nodes), F.col(current)))


def depth_by_sql(spark: SparkSession, nodes: DataFrame, levels: int = 100_000) -> DataFrame:
    """(conversation_id, node_id, depth) by a recursive query over parent pointers."""
    return spark.sql(
        f"""WITH RECURSIVE r MAX RECURSION LEVEL {int(levels)} AS (
          SELECT conversation_id, node_id, 0L AS depth FROM {{nodes}} WHERE parent_id IS NULL
          UNION ALL SELECT n.conversation_id, n.node_id, r.depth + 1 FROM r JOIN {{nodes}} n ON n.conversation_id = r.conversation_id AND n.parent_id = r.node_id)
        SELECT * FROM r""",
        nodes=nodes,
    )
