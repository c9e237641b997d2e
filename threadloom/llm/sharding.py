"""Resharding by minimum-cost flow.

The rows lie in old shards; new shards have capacities. A flow from old sizes to capacities, where bytes that
stay cost nothing and bytes that move cost 1, says how much goes from which shard to which. Rows are dealt
into blocks, BLOCKS a shard, whose sizes the driver knows (a bounded table); whole blocks are given to the
flow's arcs, largest first, so that new shards fill to within about one block. Then the affected shards are
rewritten: every new shard that gains or loses a row, and every old one that is no more.

Capacities are equal shares of the bytes (law `bytes`). Null text has no bytes. Rows with equal doc_id, and
equal rows, are rows each by itself; blocks are dealt by place in the input, not by value, so that no value
can fill one. A row larger than a share makes its shard larger. Other columns ride along; `size`, `old_shard`,
`shard` and `slot` take the place of columns of those names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, written

SHARDS, OLD_SHARDS, BLOCKS = 24, 16, 1024
ROW_BYTES = 8


def min_cost_flow(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Units sent from each old to each new shard: all of sizes, within capacities, moving the fewest.

    Successive shortest paths with potentials on the bipartite net; an arc i -> i costs 0, any other 1.
    """
    n, m = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards cannot hold all")
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # [to, room, cost, index of the reverse]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, x in enumerate(sizes):
        arc(source, i, x, 0)
        for j in range(m):
            arc(i, n + j, x, int(i != j))
    for j, x in enumerate(capacities):
        arc(n + j, sink, x, 0)
    potential = [0] * len(graph)
    while True:
        cost, via = [None] * len(graph), [None] * len(graph)
        cost[source] = 0
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > cost[a]:
                continue
            for k, (b, room, c, _) in enumerate(graph[a]):
                if room and (cost[b] is None or d + c + potential[a] - potential[b] < cost[b]):
                    cost[b], via[b] = d + c + potential[a] - potential[b], (a, k)
                    heapq.heappush(queue, (cost[b], b))
        if cost[sink] is None:
            break
        potential = [p + (c if c is not None else cost[sink]) for p, c in zip(potential, cost)]
        at, room = sink, None
        while at != source:
            a, k = via[at]
            room = graph[a][k][1] if room is None else min(room, graph[a][k][1])
            at = a
        at = sink
        while at != source:
            a, k = via[at]
            graph[a][k][1] -= room
            graph[at][graph[a][k][3]][1] += room
            at = a
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1]}


def transfers(blocks: list[tuple[int, int, int]], capacities: list[int]) -> dict[tuple[int, int], int]:
    """(old shard, block) to new shard, for blocks of (old shard, block, bytes).

    Largest first, a block goes to its own shard while that arc's flow has room for it, else to the arc of
    its shard with the most room; when no arc can take it, to the shard that is furthest below its capacity.
    """
    olds = sorted({x[0] for x in blocks})
    sizes = [0] * (max(olds, default=-1) + 1)
    for old, _, n in blocks:
        sizes[old] += n
    flow = min_cost_flow(sizes, capacities)
    room = list(capacities)
    arcs: dict[int, dict[int, int]] = {}
    for (i, j), x in flow.items():
        arcs.setdefault(i, {})[j] = x
    out, rest = {}, []
    for old, block, n in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        mine = arcs.get(old, {})
        to = old if mine.get(old, 0) >= n else max(mine, key=lambda j: (mine[j], -j), default=None)
        if to is None or mine[to] < n or room[to] < n:
            rest.append((old, block, n))
            continue
        mine[to] -= n
        room[to] -= n
        out[old, block] = to
    for old, block, n in rest:
        stays = old < len(room) and room[old] >= n
        to = old if stays else max(range(len(room)), key=lambda j: (room[j], -j))
        room[to] -= n
        out[old, block] = to
    return out


def sizes_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + ROW_BYTES


def old_layout(shards: int = OLD_SHARDS) -> Column:
    """The layout that is to be changed: doc_id's hash; rows without doc_id lie in shard 0."""
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(shards))).cast("int")


def reshard(docs: DataFrame, old_shard: Column, shards: int = SHARDS, blocks: int = BLOCKS, text: str = "text") -> DataFrame:
    """docs with size, old_shard, shard and slot (gapless from 0 in each shard).

    The place of a row in the input is written with its numbers before anything is decided, so that a task
    that runs again cannot deal it to another block.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in {"size", "old_shard", "shard", "slot", "_block", "_row"}]
    row = F.monotonically_increasing_id()
    rows = docs.select(*kept, sizes_of(F.col(text)).alias("size"), old_shard.alias("old_shard"), row.alias("_row"))
    rows = written(spark, rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")), "rows", "zstd")
    by_block = rows.groupBy("old_shard", "_block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # old shards x blocks at most
    total = sum(r["bytes"] for r in by_block)
    capacities = [total // shards + (j < total % shards) for j in range(shards)]
    to = transfers([(r["old_shard"], r["_block"], r["bytes"]) for r in by_block], capacities)
    first, plan = [0] * shards, []
    for r in sorted(by_block, key=lambda r: (r["old_shard"], r["_block"])):
        j = to[r["old_shard"], r["_block"]]
        plan.append((r["old_shard"], r["_block"], j, first[j]))
        first[j] += r["rows"]
    plan = spark.createDataFrame(plan, "old_shard int, _block int, shard int, first long")
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("old_shard", "_block").orderBy("_row")) - 1)
    return ranked.join(F.broadcast(plan), ["old_shard", "_block"]).withColumn("slot", F.col("first") + F.col("_n")).select(*kept, "size", "old_shard", "shard", "slot")


def rewrite(spark: SparkSession, rows: DataFrame, path: str, affected: list[int] | None = None) -> DataFrame:
    """Writes the shards to path/shard=N and reads them; affected: only these, the others are left as they are.

    reshard() has brought the rows of a block together, so each task writes whole blocks; text is shuffled once.
    """
    if affected is not None:
        rows = rows.where(F.col("shard").isin(affected))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def affected_shards(rows: DataFrame) -> list[int]:
    """The new shards whose rows changed: at most as many as there are shards."""
    changed = rows.where(F.col("shard") != F.col("old_shard"))
    return sorted(r[0] for r in changed.select("shard").union(changed.select("old_shard")).distinct().collect())


def assignments(docs: DataFrame) -> DataFrame:
    """The digest columns, from the rewritten shards as they are read again."""
    spark = docs.sparkSession
    moved = reshard(docs.select("doc_id", "text"), old_layout())
    there = rewrite(spark, moved.select("doc_id", "text", "shard", "slot"), fresh_path(spark, "shards"))
    return there.select(
        "doc_id",
        sizes_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
