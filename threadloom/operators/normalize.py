"""Decoded conversations to relational entities, in narrow steps.

A conversation is one row, so order, counts, keywords and the graph are found in the row; nothing is shuffled
before the merge. Every entity carries `seq`, the place of its snapshot in the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract_urls, first_truthy, iso_time, message_kind, split_url, stable_id, summary, tokens
from .graph import with_graph

CONVERSATION = (
    "id", "run_id", "source_id", "title", "created_at", "updated_at", "earliest_message_at", "latest_message_at", "default_model", "models_used", "is_archived", "is_starred",
    "current_node_id", "message_count", "message_count_main_path", "user_message_count", "assistant_message_count", "system_message_count", "tool_message_count", "safe_url_count",
    "blocked_url_count", "keyword_text", "summary_text", "metadata", "source_file", "source_fingerprint",
)


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def keywords(texts: Column, limit: int = 6) -> Column:
    """The most frequent tokens of an array of texts, ties by first use: found by sorting, in one row."""

    def best(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda x, k: F.struct(x["w"].alias("w"), x["i"].alias("i"), k.alias("k"))), lambda y: (y["k"] == 0) | (F.get(s, y["k"] - 1)["w"] != y["w"]))
        counted = let(firsts, lambda b: F.transform(b, lambda y, j: F.struct((y["k"] - F.coalesce(F.get(b, j + 1)["k"], F.size(s))).alias("n"), y["i"].alias("i"), y["w"].alias("w"))))
        return F.array_join(F.transform(F.slice(F.sort_array(counted), 1, limit), lambda x: x["w"]), ", ")

    words = F.flatten(F.transform(texts, lambda t: tokens(F.coalesce(t, F.lit("")))))
    return let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), best)


def snapshots(decoded: DataFrame, run_id: str) -> DataFrame:
    """One row a snapshot: the conversation's columns, its messages in time order, its graph."""
    rows = decoded.where("error is null and id is not null").withColumn("seq", F.col("source_seq").cast("long") * F.lit(1 << 40) + F.col("ordinal")).withColumn("run_id", F.lit(run_id))
    kind = lambda n: message_kind(n["role"], n["content_type"], n["recipient"])
    call = lambda n: F.when(n["has_message"] & (kind(n) == "tool_call"), n["own_id"])
    shape = F.transform(F.filter("nodes", lambda n: n["is_object"]), lambda n: F.struct(n["id"].alias("id"), n["parent"].alias("parent"), n["children"].alias("children"), call(n).alias("call_as")))
    rows = rows.withColumn("shape", shape)
    rows = with_graph(rows, "shape", "current_node").drop("shape")
    # nodes and graph run side by side
    whole = F.transform(F.filter("nodes", lambda n: n["is_object"]), lambda n, i: F.struct(n.alias("n"), F.get(F.col("graph"), i).alias("g")))
    rows = rows.withColumn("whole", whole)
    model = lambda n: first_truthy(n["model_slug"], n["default_model_slug"])
    message = lambda x: F.struct(
        F.coalesce(iso_time(x["n"]["create_time"]), F.lit("")).alias("_created"),
        x["n"]["id"].alias("node_id"),
        x["n"]["message_id"].alias("id"),
        x["n"]["role"].alias("role"),
        x["n"]["author_name"].alias("author_name"),
        x["n"]["recipient"].alias("recipient"),
        x["n"]["channel"].alias("channel"),
        x["n"]["content_type"].alias("content_type"),
        x["n"]["text"].alias("text"),
        x["n"]["raw_content"].alias("raw_content"),
        iso_time(x["n"]["create_time"]).alias("created_at"),
        iso_time(x["n"]["update_time"]).alias("updated_at"),
        x["n"]["is_hidden"].alias("is_hidden"),
        F.when(x["n"]["is_hidden"], "visually_hidden").alias("hidden_reason"),
        x["g"]["main_path_index"].isNotNull().alias("is_in_main_path"),
        x["g"]["main_path_index"].alias("main_path_index"),
        x["g"]["depth"].alias("depth"),
        model(x["n"]).alias("model"),
        x["n"]["metadata"].alias("metadata"),
        kind(x["n"]).alias("message_kind"),
        x["n"]["refs"].alias("refs"),
    )
    said = F.filter("whole", lambda x: x["n"]["has_message"] & (F.coalesce(x["n"]["message_id"], F.lit("")) != ""))
    rows = rows.withColumn("messages", F.sort_array(F.transform(said, message)))
    spoken = F.filter("messages", lambda m: m["is_in_main_path"])
    rows = rows.withColumn("ordered", F.when(F.size(spoken) > 0, spoken).otherwise(F.col("messages")))
    of = lambda role: F.filter("ordered", lambda m: (m["role"] == role) & (F.coalesce(m["text"], F.lit("")) != ""))
    count = lambda role: F.size(F.filter("ordered", lambda m: m["role"] == role)).alias(f"{role}_message_count")
    models = F.flatten(F.transform(F.filter("whole", lambda x: x["n"]["has_message"]), lambda x: F.array(x["n"]["model_slug"], x["n"]["default_model_slug"])))
    rows = rows.withColumn("keyword_text", keywords(F.transform("ordered", lambda m: m["text"])))
    nothing = lambda c: F.coalesce(F.col(c), F.lit("null"))
    return rows.select(
        "seq",
        "id",
        "run_id",
        "source_id",
        "title",
        iso_time(F.col("create_time")).alias("created_at"),
        iso_time(F.col("update_time")).alias("updated_at"),
        F.array_min(F.transform("messages", lambda m: m["created_at"])).alias("earliest_message_at"),
        F.array_max(F.transform("messages", lambda m: m["created_at"])).alias("latest_message_at"),
        "default_model",
        F.array_sort(F.array_distinct(F.filter(models, lambda m: F.coalesce(m, F.lit("")) != ""))).alias("models_used"),
        "is_archived",
        "is_starred",
        F.col("current_node").alias("current_node_id"),
        F.size("messages").alias("message_count"),
        F.size(spoken).alias("message_count_main_path"),
        *(count(r) for r in ("user", "assistant", "system", "tool")),
        F.coalesce(F.size("safe_urls"), F.lit(0)).alias("safe_url_count"),
        F.coalesce("blocked_url_count", F.lit(0)).alias("blocked_url_count"),
        "keyword_text",
        summary(F.col("title"), F.get(of("user"), F.lit(0))["text"], F.try_element_at(of("user"), F.lit(-1))["text"], F.try_element_at(of("assistant"), F.lit(-1))["text"], F.col("keyword_text")).alias("summary_text"),
        F.struct(*(nothing(c).alias(c) for c in ("async_status", "conversation_origin", "is_do_not_remember", "is_read_only"))).alias("notes"),
        F.col("source_label").alias("source_file"),
        "source_fingerprint",
        "messages",
        "whole",
        "safe_urls",
    )


def metadata_json(removed: Column) -> Column:
    """The conversation's metadata as JSON with sorted keys; removed: array of message ids, left out where empty."""
    note = lambda k: F.concat(F.lit(f'"{k}": '), F.col(f"notes.{k}"))
    gone = F.when(F.size(removed) > 0, F.concat(F.lit('"removed_message_ids": ['), F.array_join(F.transform(removed, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ", "), F.lit("]")))
    return F.concat(F.lit("{"), F.concat_ws(", ", *(note(k) for k in ("async_status", "conversation_origin", "is_do_not_remember", "is_read_only")), gone, F.concat(F.lit('"source_fingerprint": "'), F.col("source_fingerprint"), F.lit('"'))), F.lit("}"))


def conversations(snaps: DataFrame) -> DataFrame:
    return snaps.withColumn("metadata", metadata_json(F.array().cast("array<string>"))).select("seq", "notes", *CONVERSATION)


def messages(snaps: DataFrame) -> DataFrame:
    out = snaps.select("seq", "run_id", F.col("id").alias("conversation_id"), F.posexplode("messages").alias("time_index", "m"))
    return out.select("seq", "conversation_id", "run_id", "time_index", "m.*").drop("_created", "refs")


def nodes(snaps: DataFrame) -> DataFrame:
    out = snaps.select("seq", "run_id", F.col("id").alias("conversation_id"), F.explode("whole").alias("x"))
    return out.select(
        "seq", "conversation_id", F.col("x.n.id").alias("id"), "run_id", F.col("x.n.parent").alias("parent_id"), F.col("x.n.children").alias("children_ids"), F.when(F.col("x.n.has_message"), F.col("x.n.message_id")).alias("message_id"),
        F.col("x.n.parent").isNull().alias("is_root"), F.col("x.g.main_path_index").isNotNull().alias("is_in_main_path"), F.col("x.g.depth").alias("depth"), F.col("x.g.main_path_index").alias("main_path_index"),
    )


def edges(snaps: DataFrame) -> DataFrame:
    out = snaps.select("seq", "run_id", F.col("id").alias("conversation_id"), F.explode("whole").alias("x"))
    return out.select("seq", "run_id", "conversation_id", F.col("x.n.id").alias("parent_node_id"), F.posexplode("x.n.children").alias("child_index", "child_node_id"))


def links(snaps: DataFrame) -> DataFrame:
    """Safe urls, urls in message text, references and citations."""
    none = lambda t: F.lit(None).cast(t)
    base = snaps.select("seq", "run_id", F.col("id").alias("conversation_id"), "safe_urls", "messages")
    safe = base.select("seq", "run_id", "conversation_id", F.posexplode("safe_urls").alias("i", "url"))
    safe = safe.select("seq", "conversation_id", F.concat_ws("_", F.lit("safe"), "conversation_id", "i").alias("id"), "run_id", none("string").alias("message_id"), F.lit("safe_url").alias("source"), "url", F.col("url").alias("display_text"), none("long").alias("position_start"), none("long").alias("position_end"), none("string").alias("kind"), F.lit("{}").alias("metadata"))
    each = base.select("seq", "run_id", "conversation_id", F.explode("messages").alias("m"))
    text = each.select("seq", "run_id", "conversation_id", F.col("m.id").alias("mid"), F.posexplode(extract_urls(F.coalesce("m.text", F.lit("")))).alias("i", "u"))
    text = text.select("seq", "conversation_id", F.concat_ws("_", F.lit("msg"), "mid", "i").alias("id"), "run_id", F.col("mid").alias("message_id"), F.lit("message_text").alias("source"), F.col("u.url").alias("url"), F.col("u.url").alias("display_text"), F.col("u.start").cast("long").alias("position_start"), F.col("u.end").cast("long").alias("position_end"), none("string").alias("kind"), F.lit("{}").alias("metadata"))
    refs = each.select("seq", "run_id", "conversation_id", F.col("m.id").alias("mid"), F.explode("m.refs").alias("r"))
    refs = refs.select("seq", "conversation_id", stable_id(F.col("conversation_id"), F.col("mid"), F.col("r.source"), F.col("r.idx"), F.col("r.url")).alias("id"), "run_id", F.col("mid").alias("message_id"), F.col("r.source").alias("source"), F.col("r.url").alias("url"), F.col("r.title").alias("display_text"), F.col("r.position_start").alias("position_start"), F.col("r.position_end").alias("position_end"), F.col("r.kind").alias("kind"), F.col("r.metadata").alias("metadata"))
    return safe.unionByName(text).unionByName(refs).withColumn("_u", split_url(F.col("url"))).select("*", "_u.*").drop("_u")


def _with_messages(snaps: DataFrame) -> DataFrame:
    """All messages, those without an id too, in the order of the export."""
    out = snaps.select("seq", "run_id", F.col("id").alias("conversation_id"), F.posexplode("whole").alias("ord", "x"))
    return out.where("x.n.has_message").withColumn("kind", message_kind(F.col("x.n.role"), F.col("x.n.content_type"), F.col("x.n.recipient")))


def attachments(snaps: DataFrame) -> DataFrame:
    out = _with_messages(snaps).select("seq", "ord", "conversation_id", "run_id", F.col("x.n.message_id").alias("message_id"), F.explode("x.n.files").alias("f"))
    made = stable_id(F.col("conversation_id"), F.col("message_id"), F.lit("attachment"), F.col("f.idx"), F.col("f.source_ref"), F.col("f.name"))
    return out.select("seq", "ord", "conversation_id", made.alias("id"), "run_id", "message_id", *(F.col(f"f.{c}").alias(c) for c in ("type", "filename", "mime_type", "filesize_bytes", "source_ref", "metadata")))


def _call_id(conversation: Column, n: Column) -> Column:
    return stable_id(conversation, n["message_id"], F.lit("tool_call"), n["recipient"], n["raw_arguments"])


def tool_calls(snaps: DataFrame) -> DataFrame:
    n = F.col("x.n")
    out = _with_messages(snaps).where("kind = 'tool_call'")
    return out.select("seq", "ord", "conversation_id", _call_id(F.col("conversation_id"), n).alias("id"), "run_id", n["message_id"].alias("message_id"), n["recipient"].alias("tool_name"), F.lit(0).alias("call_index"), n["arguments_json"].alias("arguments_json"), n["raw_arguments"].alias("raw_arguments"), n["metadata"].alias("metadata"))


def tool_results(snaps: DataFrame) -> DataFrame:
    """Each result with the call above it, which is found within the conversation's row; only results are exploded."""
    kind = lambda y: message_kind(y["n"]["role"], y["n"]["content_type"], y["n"]["recipient"])
    calls = F.transform(F.filter("whole", lambda y: y["n"]["has_message"] & (kind(y) == "tool_call")), lambda y: F.struct(y["n"]["own_id"].alias("own_id"), _call_id(F.col("id"), y["n"]).alias("call_id")))
    placed = F.transform("whole", lambda y, i: F.struct(i.alias("ord"), y.alias("x")))
    called = lambda y: F.try_element_at(F.filter("calls", lambda c: c["own_id"] == y["x"]["g"]["call_node"]), F.lit(-1))["call_id"]
    kept = lambda y: F.struct(*(y["x"]["n"][c].alias(c) for c in ("message_id", "raw_result", "result_json", "metadata")))
    results = F.transform(F.filter(placed, lambda y: y["x"]["n"]["has_message"] & (kind(y["x"]) == "tool_result")), lambda y: F.struct(y["ord"].alias("ord"), kept(y).alias("n"), called(y).alias("call")))
    out = snaps.withColumn("calls", calls).select("seq", "run_id", F.col("id").alias("conversation_id"), F.explode(results).alias("r"))
    out = out.select("seq", "run_id", "conversation_id", "r.*")
    n, linked = F.col("n"), F.col("call")
    return out.select("seq", "ord", "conversation_id", stable_id(F.col("conversation_id"), n["message_id"], F.lit("tool_result"), n["raw_result"]).alias("id"), "run_id", n["message_id"].alias("message_id"), linked.alias("tool_call_id"), n["result_json"].alias("result_json"), n["raw_result"].alias("raw_result"), n["metadata"].alias("metadata"))


def entities(snaps: DataFrame) -> dict[str, DataFrame]:
    return {"conversations": conversations(snaps), "nodes": nodes(snaps), "node_children": edges(snaps), "messages": messages(snaps), "links": links(snaps), "attachments": attachments(snaps), "tool_calls": tool_calls(snaps), "tool_results": tool_results(snaps)}


