"""Conversations as markdown, text and bundles: one row a conversation, rendered where its messages meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import first_truthy

NL = "\n"


def visible(messages: DataFrame, include_hidden: bool = False) -> DataFrame:
    return messages if include_hidden else messages.where("is_hidden is null or not is_hidden")


def _numbered(messages: DataFrame) -> DataFrame:
    return messages.withColumn("_i", F.row_number().over(Window.partitionBy("conversation_id").orderBy("time_index")))


def _lines(*parts: Column) -> Column:
    """The lines that are not null, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), NL)


def _if_set(c: str, form: Column) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", form)


def _header(prefix: str) -> Column:
    role = first_truthy(F.col("role"), F.lit("unknown"))
    at = F.when(F.coalesce(F.col("created_at"), F.lit("")) != "", F.concat(F.lit(" @ "), F.col("created_at"))).otherwise("")
    return F.concat(F.lit(prefix), F.col("_i").cast("string"), F.lit(". "), role, at)


def _joined(conversations: DataFrame, blocks: DataFrame, head: Column, tail: Column | None = None) -> DataFrame:
    body = blocks.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "block"))), lambda x: x["block"]), NL).alias("_body"))
    both = conversations.join(body.withColumnRenamed("conversation_id", "id"), "id", "left")
    return both.withColumn("content", _lines(head, F.col("_body"), *([tail] if tail is not None else [])))


def render_markdown(conversations: DataFrame, messages: DataFrame, frontmatter: bool = False, anchor: bool = False) -> DataFrame:
    """conversations (id, title, created_at, ...) with their markdown as `content`."""
    title = first_truthy(F.col("title"), F.col("id"))
    made = lambda form: F.when(F.coalesce(F.col("created_at"), F.lit("")) != "", form)
    front = [
        F.lit("---"),
        F.concat(F.lit('title: "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"')),
        F.concat(F.lit('conversation_id: "'), F.col("id"), F.lit('"')),
        made(F.concat(F.lit('created_at: "'), F.col("created_at"), F.lit('"'))),
        F.lit("tags: [chatgpt_export]"),
        F.lit("---"),
        F.lit(""),
    ]
    head = _lines(
        *(front if frontmatter else []),
        *([F.concat(F.lit('<a id="'), F.col("id"), F.lit('"></a>'))] if anchor else []),
        F.concat(F.lit("# "), title),
        F.lit(""),
        F.concat(F.lit("- Conversation ID: `"), F.col("id"), F.lit("`")),
        made(F.concat(F.lit("- Created at: "), F.col("created_at"))),
        F.lit(""),
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    block = _lines(_header("## "), _if_set("message_kind", F.concat(F.lit("*kind:* `"), F.col("message_kind"), F.lit("`"))), _if_set("model", F.concat(F.lit("*model:* `"), F.col("model"), F.lit("`"))), F.lit(""), F.lit("```"), text, F.lit("```"), F.lit(""), F.lit("---"), F.lit(""))
    return _joined(conversations, _numbered(messages).withColumn("block", block), head).drop("_body")


def render_text(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversations with their plain text as `content`, ending in one line end."""
    title = first_truthy(F.col("title"), F.col("id"))
    head = _lines(F.concat(F.lit("Title: "), title), F.concat(F.lit("Conversation ID: "), F.col("id")), F.when(F.coalesce(F.col("created_at"), F.lit("")) != "", F.concat(F.lit("Created at: "), F.col("created_at"))), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    block = _lines(_header(""), _if_set("message_kind", F.concat(F.lit("kind: "), F.col("message_kind"))), _if_set("model", F.concat(F.lit("model: "), F.col("model"))), text, F.lit(""), F.lit("-" * 40), F.lit(""))
    out = _joined(conversations, _numbered(messages).withColumn("block", block), head).drop("_body")
    return out.withColumn("content", F.concat(F.regexp_replace("content", r"(?U)\s+\z", ""), F.lit(NL)))


def bundle(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, content) of a bundle's pieces in order: latest first, ties by id."""
    latest = first_truthy(F.col("updated_at"), F.col("latest_message_at"), F.col("created_at"))
    return render_markdown(conversations, messages, anchor=True).orderBy(F.desc_nulls_last(latest), "id").select("id", "content")
