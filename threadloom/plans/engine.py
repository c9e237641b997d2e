"""Queries through the archive's own operators: decode, normalise, merge two runs, check; each with independent SQL.

The conversations table becomes exports with branches and tool calls: turn t hangs below t - 2 where t % 3 is 2,
else below t - 1; an assistant's turn with t % 5 = 3 is a tool call, a turn with t % 5 = 4 a tool's result. Times
are not in the order of turns. Run r1 has every conversation; run r2 has it again: without its last turn and newer
where the id divides by 3 (it replaces), without it and older at remainder 1 (it loses), unchanged at remainder 2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, normalize
from ..operators.check import integrity_errors
from ..sources.export import SCHEMA
from ..storage import staged

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def _typed(fields, given: dict[str, Column]) -> list[Column]:
    return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]


def decoded(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    """The rows that the export reader gives for the conversations of a run."""
    fields = {f.name: f for f in spark.createDataFrame([], SCHEMA).schema.fields}
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    whole = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    key, node_id = F.col("conv_id").cast("string"), lambda n: F.concat(F.lit("n"), n.cast("string"))
    cut = (F.col("conv_id") % 3 != 2) & F.lit(run == 1)
    whole = whole.withColumn("t", F.when(cut, F.slice("t", F.lit(1), F.size("t") - 1)).otherwise(F.col("t")))
    above = lambda n: F.when(n == 0, F.lit(None)).when(n % 3 == 2, n - 2).otherwise(n - 1)

    def node(x: Column) -> Column:
        n = x["turn"]
        call = (n % 5 == 3) & (x["role"] == "assistant")
        message = F.concat(F.lit("m"), key, F.lit("_"), n.cast("string"))
        said = F.concat(x["text"], F.lit(" https://x.example/p/"), key)
        file = F.struct(*_typed(fields["nodes"].dataType.elementType["files"].dataType.elementType.fields, {"idx": F.lit(0), "name": F.lit("a.txt"), "filename": F.lit("a.txt"), "source_ref": message, "metadata": F.lit("{}")}))
        given = {
            "ord": n, "id": node_id(n), "own_id": node_id(n), "parent": node_id(above(n)), "children": F.transform(F.filter("t", lambda y: above(y["turn"]) == n), lambda y: node_id(y["turn"])), "is_object": F.lit(True), "has_message": F.lit(True),
            "message_id": message, "role": F.when(n % 5 == 4, "tool").otherwise(x["role"]), "recipient": F.when(call, "python").otherwise("all"), "content_type": F.when(call, "code").otherwise("text"), "text": said, "raw_content": said,
            "create_time": 1_700_000_000 + n * 37 % 10, "is_hidden": F.lit(False), "metadata": F.lit("{}"), "raw_arguments": said, "arguments_json": F.lit("{}"), "raw_result": said, "result_json": F.lit("{}"),
            "refs": F.array(), "files": F.when(n == 0, F.array(file)).otherwise(F.array()),
        }
        return F.struct(*_typed(fields["nodes"].dataType.elementType.fields, given))

    time = F.when(F.lit(run == 0), 1_700_001_000).when(F.col("conv_id") % 3 == 0, 1_700_002_000).otherwise(1_700_000_500)
    given = {
        "source_label": F.lit(f"run{run}.json"), "source_seq": F.lit(0), "ordinal": F.col("conv_id"), "id": key, "source_id": key, "create_time": F.lit(1_700_000_000), "update_time": time, "is_archived": F.lit(False), "is_starred": F.lit(False),
        "current_node": node_id(F.try_element_at("t", F.lit(-1))["turn"]), "safe_urls": F.array(F.concat(F.lit("https://safe.example/"), key)), "blocked_url_count": F.lit(2),
        "source_fingerprint": F.concat(key, F.when(cut, "-b").otherwise("-a")), "nodes": F.transform("t", node),
    }
    return whole.select(*_typed(fields.values(), given))


def merged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The archive's tables after both runs."""
    runs = [normalize.entities(staged(spark, normalize.snapshots(staged(spark, decoded(spark, sf_dir, i)), f"r{i + 1}"))) for i in range(2)]
    return merge.merge(merge.merge({}, runs[0], "r1", "2024-01-01"), runs[1], "r2", "2024-01-02")


_T = """t AS (SELECT conv_id, turn, role AS r, CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END AS role, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END AS p,
  count(*) OVER (PARTITION BY conv_id) AS k, text FROM conversations),
s AS (SELECT *, conv_id::VARCHAR AS c, 'n' || turn AS node, 'm' || conv_id || '_' || turn AS msg, CASE WHEN conv_id % 3 = 0 THEN 'r2' ELSE 'r1' END AS run FROM t WHERE NOT (conv_id % 3 = 0 AND turn = k - 1)),
ends AS (SELECT conv_id, max(turn) AS last FROM s GROUP BY conv_id),
up AS (SELECT s.conv_id, s.turn, s.p, 0 AS i FROM s JOIN ends ON ends.conv_id = s.conv_id AND ends.last = s.turn
  UNION ALL SELECT s.conv_id, s.turn, s.p, up.i + 1 FROM up JOIN s ON s.conv_id = up.conv_id AND s.turn = up.p),
main AS (SELECT conv_id, turn, max(i) OVER (PARTITION BY conv_id) - i AS main_path_index FROM up),
down AS (SELECT conv_id, turn, 0 AS depth FROM s WHERE p IS NULL UNION ALL SELECT s.conv_id, s.turn, down.depth + 1 FROM down JOIN s ON s.conv_id = down.conv_id AND s.p = down.turn),
m AS (SELECT s.*, main_path_index, depth, main.turn IS NOT NULL AS on_main, CASE WHEN s.role = 'tool' THEN 'tool_result' WHEN s.role = 'user' THEN 'user_visible_user' WHEN s.role = 'system' THEN 'system_context'
  WHEN s.turn % 5 = 3 THEN 'tool_call' ELSE 'user_visible_assistant' END AS kind, strftime(make_timestamp((1700000000 + s.turn * 37 % 10) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created
  FROM s LEFT JOIN main USING (conv_id, turn) JOIN down USING (conv_id, turn))"""
_WITH = f"WITH RECURSIVE {_T}"


@_query(f"{_WITH} SELECT c AS conversation_id, node AS id, 'n' || p AS parent_id, p IS NULL AS is_root, msg AS message_id, on_main AS is_in_main_path, depth::BIGINT AS depth, main_path_index::BIGINT AS main_path_index, run AS run_id FROM m")
def archive_nodes(spark, sf_dir):
    """Nodes with depth, root mark and main path, after both runs."""
    return merged(spark, sf_dir)["nodes"].select("conversation_id", "id", "parent_id", "is_root", "message_id", "is_in_main_path", F.col("depth").cast("long").alias("depth"), F.col("main_path_index").cast("long").alias("main_path_index"), "run_id")


@_query(f"{_WITH} SELECT c AS conversation_id, 'n' || p AS parent_node_id, row_number() OVER (PARTITION BY conv_id, p ORDER BY turn) - 1 AS child_index, node AS child_node_id FROM m WHERE p IS NOT NULL")
def archive_edges(spark, sf_dir):
    """Edges to the children of branching nodes, in their order."""
    return merged(spark, sf_dir)["node_children"].select("conversation_id", "parent_node_id", F.col("child_index").cast("long").alias("child_index"), "child_node_id")


@_query(
    f"""{_WITH} SELECT c AS conversation_id, msg AS id, node AS node_id, role, kind AS message_kind, row_number() OVER (PARTITION BY conv_id ORDER BY created, node) - 1 AS time_index, created AS created_at,
  on_main AS is_in_main_path, main_path_index::BIGINT AS main_path_index, depth::BIGINT AS depth, run AS run_id FROM m"""
)
def archive_messages(spark, sf_dir):
    """Messages in time order, pruned of those that the newer snapshot lacks."""
    long = lambda c: F.col(c).cast("long").alias(c)
    return merged(spark, sf_dir)["messages"].select("conversation_id", "id", "node_id", "role", "message_kind", long("time_index"), "created_at", "is_in_main_path", long("main_path_index"), long("depth"), "run_id")


@_query(
    f"""{_WITH} SELECT c AS id, run AS run_id, count(*) AS message_count, count(*) FILTER (on_main) AS message_count_main_path, count(*) FILTER (on_main AND role = 'user') AS user_message_count,
  count(*) FILTER (on_main AND role = 'assistant') AS assistant_message_count, count(*) FILTER (on_main AND role = 'system') AS system_message_count, count(*) FILTER (on_main AND role = 'tool') AS tool_message_count,
  min(created) AS earliest_message_at, max(created) AS latest_message_at, CASE WHEN conv_id % 3 = 0 THEN '2023-11-14T22:46:40Z' ELSE '2023-11-14T22:30:00Z' END AS updated_at, 2::BIGINT AS blocked_url_count, 1::BIGINT AS safe_url_count,
  '{{"async_status": null, "conversation_origin": null, "is_do_not_remember": null, "is_read_only": null, ' || CASE WHEN conv_id % 3 = 0 THEN '"removed_message_ids": ["m' || c || '_' || max(k - 1) || '"], ' ELSE '' END
  || '"source_fingerprint": "' || c || CASE WHEN conv_id % 3 = 0 THEN '-b' ELSE '-a' END || '"}}' AS metadata FROM m GROUP BY c, conv_id, run"""
)
def archive_conversations(spark, sf_dir):
    """Conversations with their counts, times and the messages that the newer snapshot has removed."""
    counts = [F.col(f"{c}_count").cast("long").alias(f"{c}_count") for c in ("message", "user_message", "assistant_message", "system_message", "tool_message", "blocked_url", "safe_url")]
    return merged(spark, sf_dir)["conversations"].where("message_count > 0").select("id", "run_id", *counts, F.col("message_count_main_path").cast("long").alias("message_count_main_path"), "earliest_message_at", "latest_message_at", "updated_at", "metadata")


@_query("SELECT DISTINCT conv_id::VARCHAR AS conversation_id, r AS run_id, (r = 'r2') = (conv_id % 3 = 0) AS is_canonical_snapshot FROM conversations, (VALUES ('r1'), ('r2')) x(r)")
def archive_runs(spark, sf_dir):
    """Which run's snapshot of a conversation stands."""
    return merged(spark, sf_dir)["conversation_runs"].select("conversation_id", "run_id", "is_canonical_snapshot")


@_query(
    f"""{_WITH} SELECT 'r1' AS run_id, conv_id::VARCHAR AS conversation_id, 'm' || conv_id || '_' || turn AS message_id FROM t WHERE NOT (conv_id % 3 = 0 AND turn = k - 1)
UNION ALL SELECT 'r2', conv_id::VARCHAR, 'm' || conv_id || '_' || turn FROM t WHERE conv_id % 3 = 2 OR turn < k - 1"""
)
def archive_message_runs(spark, sf_dir):
    """Which runs brought a message; removed messages are in none."""
    return merged(spark, sf_dir)["message_runs"].select("run_id", "conversation_id", "message_id")


@_query(
    f"""{_WITH} SELECT DISTINCT c AS conversation_id, 'safe_' || c || '_0' AS id, NULL::VARCHAR AS message_id, 'safe_url' AS source, 'https://safe.example/' || c AS url FROM m
UNION ALL SELECT c, 'msg_' || msg || '_0', msg, 'message_text', 'https://x.example/p/' || c FROM m"""
)
def archive_links(spark, sf_dir):
    """Safe urls and urls in message texts."""
    t = merged(spark, sf_dir)
    return t["links"].join(t["messages"].select("conversation_id").distinct(), "conversation_id", "left_semi").select("conversation_id", "id", "message_id", "source", "url")


@_query(f"{_WITH} SELECT c AS conversation_id, sha1(c || '||' || msg || '||attachment||0||' || msg || '||a.txt') AS id, msg AS message_id, msg AS source_ref, CASE WHEN conv_id % 3 = 2 THEN 'r1' ELSE 'r2' END AS run_id FROM m WHERE turn = 0")
def archive_attachments(spark, sf_dir):
    return merged(spark, sf_dir)["attachments"].select("conversation_id", "id", "message_id", "source_ref", "run_id")


@_query(f"{_WITH} SELECT a.c AS conversation_id, a.msg AS message_id, b.msg AS call_message_id FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.turn = a.p AND b.kind = 'tool_call' WHERE a.role = 'tool'")
def archive_tool_results(spark, sf_dir):
    """Results with the message of the nearest call above them."""
    t = merged(spark, sf_dir)
    calls = t["tool_calls"].select("conversation_id", F.col("id").alias("tool_call_id"), F.col("message_id").alias("call_message_id"))
    return t["tool_results"].join(calls, ["conversation_id", "tool_call_id"], "left").select("conversation_id", "message_id", "call_message_id")


@_query(
    f"""{_WITH} SELECT 'orphan_message_node' AS type, c AS conversation_id, msg AS entity_id FROM m WHERE turn = 3
UNION ALL SELECT 'orphan_node_message', c, node FROM m WHERE turn = 2
UNION ALL SELECT 'current_node_missing', conv_id::VARCHAR, 'n3' FROM ends WHERE last = 3
UNION ALL SELECT 'node_child_parent_missing', c, 'n3' FROM m WHERE p = 3
UNION ALL SELECT 'node_child_missing', c, 'n3' FROM m WHERE turn = 3
UNION ALL SELECT 'conversation_message_count_mismatch', c, NULL FROM m WHERE turn = 2
UNION ALL SELECT 'conversation_main_path_count_mismatch', c, NULL FROM m WHERE turn = 2 AND on_main
UNION ALL SELECT 'missing_message_fts_row', c, msg FROM m WHERE turn = 0
UNION ALL SELECT 'orphan_message_fts_row', c, msg FROM m WHERE turn = 2
UNION ALL SELECT DISTINCT 'canonical_snapshot_marker_mismatch', c, NULL FROM m WHERE conv_id % 4 = 1"""
)
def archive_integrity(spark, sf_dir):
    """All ten checks, on tables from which rows and marks were taken."""
    t = merged(spark, sf_dir)
    turn = lambda c: F.split_part(c, F.lit("_"), F.lit(2))
    t["nodes"] = t["nodes"].where("id <> 'n3'")
    t["messages"] = t["messages"].where(turn(F.col("id")) != "2")
    t["message_index"] = t["message_index"].where(turn(F.col("message_id")) != "0")
    t["conversation_runs"] = t["conversation_runs"].withColumn("is_canonical_snapshot", F.col("is_canonical_snapshot") & (F.col("conversation_id").cast("long") % 4 != 1))
    held = t["conversations"].where("message_count > 0")
    return integrity_errors({**t, "conversations": held}).select("type", "conversation_id", "entity_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
