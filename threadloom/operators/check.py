"""Integrity of an archive: ten classes of errors, one lazy frame each, with one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "type string, conversation_id string, entity_id string, details map<string,string>"


def _errors(df: DataFrame, kind: str, conversation: str = "conversation_id", entity: Column | None = None, **details: Column) -> DataFrame:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(F.lit(kind).alias("type"), F.col(conversation).alias("conversation_id"), (entity if entity is not None else F.lit(None)).cast("string").alias("entity_id"), (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,string>").alias("details"))


def integrity_errors(t: dict[str, DataFrame]) -> DataFrame:
    """All errors; only key columns are read. t: tables by name."""
    convs = t["conversations"].select("id", "run_id", "current_node_id", "message_count", "message_count_main_path")
    nodes = t["nodes"].select("conversation_id", "id", "message_id")
    messages = t["messages"].select("conversation_id", "id", "node_id", "is_in_main_path", (F.coalesce("text", F.lit("")) != "").alias("said"))
    edges = t["node_children"].select("conversation_id", "parent_node_id", "child_node_id", "child_index")
    keys = t["message_index"].select("conversation_id", "message_id").distinct()
    runs = t["conversation_runs"].select("conversation_id", "run_id", "is_canonical_snapshot")
    key = lambda name: nodes.select("conversation_id", F.col("id").alias(name))
    message_keys = messages.select("conversation_id", F.col("id").alias("message_id"))

    counted = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("actual"), F.count_if("is_in_main_path").alias("actual_main"))
    sized = convs.join(counted, "id", "left").fillna(0, ["actual", "actual_main"])
    marked = runs.groupBy(F.col("conversation_id").alias("id")).agg(F.count_if("is_canonical_snapshot").alias("markers"), F.max(F.when(F.col("is_canonical_snapshot"), F.col("run_id"))).alias("marked_run"))
    marks = convs.join(marked, "id", "left").where((F.coalesce("markers", F.lit(0)) != 1) | ~F.col("marked_run").eqNullSafe(F.col("run_id")))
    currents = convs.where("current_node_id is not null and current_node_id <> ''").select(F.col("id").alias("conversation_id"), "current_node_id")
    found = [
        _errors(messages.where("node_id is not null").join(key("node_id"), ["conversation_id", "node_id"], "left_anti"), "orphan_message_node", entity=F.col("id"), node_id=F.col("node_id")),
        _errors(nodes.where("message_id is not null").join(message_keys, ["conversation_id", "message_id"], "left_anti"), "orphan_node_message", entity=F.col("id"), message_id=F.col("message_id")),
        _errors(currents.join(key("current_node_id"), ["conversation_id", "current_node_id"], "left_anti"), "current_node_missing", entity=F.col("current_node_id")),
        _errors(edges.join(key("parent_node_id"), ["conversation_id", "parent_node_id"], "left_anti"), "node_child_parent_missing", entity=F.col("parent_node_id"), child_index=F.col("child_index")),
        _errors(edges.join(key("child_node_id"), ["conversation_id", "child_node_id"], "left_anti"), "node_child_missing", entity=F.col("child_node_id"), parent_node_id=F.col("parent_node_id")),
        _errors(sized.where("message_count <> actual"), "conversation_message_count_mismatch", "id", stored=F.col("message_count"), actual=F.col("actual")),
        _errors(sized.where("message_count_main_path <> actual_main"), "conversation_main_path_count_mismatch", "id", stored=F.col("message_count_main_path"), actual=F.col("actual_main")),
        _errors(messages.where("said").withColumnRenamed("id", "message_id").join(keys, ["conversation_id", "message_id"], "left_anti"), "missing_message_fts_row", entity=F.col("message_id")),
        _errors(keys.join(message_keys, ["conversation_id", "message_id"], "left_anti"), "orphan_message_fts_row", entity=F.col("message_id")),
        _errors(marks, "canonical_snapshot_marker_mismatch", "id", markers=F.coalesce("markers", F.lit(0)), marked_run=F.coalesce("marked_run", F.lit("")), run_id=F.col("run_id")),
    ]
    return reduce(DataFrame.unionByName, found)
