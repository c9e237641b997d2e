"""The archive's operators over flat tables, each with SQL that gives the same rows.

A flat table of turns is a chain: turn n's parent is turn n - 1, and all turns lie on the main path. Other
tables stand in where an operator needs branches, timestamps, urls or snapshots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean_text, extract_urls, iso_time, message_kind, split_url, stable_id, summary, top_keywords
from ..functions.text import STOP_WORDS, TOKEN
from ..operators.search import matches

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as messages of the archive."""
    t = _table(spark, sf_dir, "conversations")
    kind = message_kind(F.col("role"), F.lit("text"), F.lit("all"))
    return t.select(
        F.col("conv_id").alias("conversation_id"),
        F.concat_ws("_", F.lit("msg"), "conv_id", "turn").alias("message_id"),
        F.concat_ws("_", F.lit("node"), "conv_id", "turn").alias("node_id"),
        F.when(F.col("turn") > 0, F.concat_ws("_", F.lit("node"), "conv_id", F.col("turn") - 1)).alias("parent_id"),
        F.col("turn"),
        "role",
        "text",
        kind.alias("message_kind"),
    )


_KIND = "CASE role WHEN 'user' THEN 'user_visible_user' WHEN 'system' THEN 'system_context' WHEN 'tool' THEN 'tool_result' WHEN 'assistant' THEN 'user_visible_assistant' ELSE 'unknown' END"
_M = f"""m AS (SELECT conv_id AS conversation_id, 'msg_' || conv_id || '_' || turn AS message_id, 'node_' || conv_id || '_' || turn AS node_id,
  CASE WHEN turn > 0 THEN 'node_' || conv_id || '_' || (turn - 1) END AS parent_id, turn, role, text, {_KIND} AS message_kind FROM conversations)"""


def _clean(x: str, n: int) -> str:
    flat = f"nullif(trim(regexp_replace({x}, '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+', ' ', 'g')), '')"
    cut = f"substr({flat}, 1, {n - 1})"
    return f"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE coalesce(nullif(trim(regexp_replace({cut}, ' [^ ]*$', '')), ''), {cut}) || '…' END"


@_query(f"WITH {_M} SELECT message_kind, count(*) AS n FROM m GROUP BY message_kind")
def message_kinds(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("message_kind").agg(F.count("*").alias("n"))


@_query(f"WITH {_M} SELECT conversation_id, message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn, node_id, message_id) - 1 AS time_index FROM m")
def message_time_index(spark, sf_dir):
    w = Window.partitionBy("conversation_id").orderBy("turn", "node_id", "message_id")
    return messages(spark, sf_dir).select("conversation_id", "message_id", (F.row_number().over(w) - 1).cast("long").alias("time_index"))


@_query(
    f"""WITH RECURSIVE {_M}, r AS (SELECT conversation_id, node_id, 0 AS depth FROM m WHERE parent_id IS NULL
  UNION ALL SELECT m.conversation_id, m.node_id, r.depth + 1 FROM r JOIN m ON m.conversation_id = r.conversation_id AND m.parent_id = r.node_id)
SELECT conversation_id, node_id, depth::BIGINT AS depth FROM r"""
)
def graph_depth(spark, sf_dir):
    """Breadth-first depth, one task a conversation's row; deep chains cost no joins."""
    from ..operators.graph import with_graph

    nodes = messages(spark, sf_dir).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn", "node_id", "parent_id"))).alias("n"))
    child = lambda n: F.transform(F.col("n"), lambda x, i: F.struct(x["node_id"].alias("id"), x["parent_id"].alias("parent"), F.when(F.get(F.col("n"), i + 1).isNotNull(), F.array(F.get(F.col("n"), i + 1)["node_id"])).otherwise(F.array().cast("array<string>")).alias("children"), F.lit(None).cast("string").alias("call_as")))
    rows = nodes.select("conversation_id", child("n").alias("nodes"), F.element_at("n", -1)["node_id"].alias("current_node"))
    out = with_graph(rows).select("conversation_id", F.explode("graph").alias("g"))
    return out.select("conversation_id", F.col("g.id").alias("node_id"), F.col("g.depth").cast("long").alias("depth"))


@_query(_SQL["graph_depth"].replace("SELECT conversation_id, node_id, depth::BIGINT AS depth FROM r", "SELECT conversation_id, node_id, depth::BIGINT AS main_path_index FROM r"))
def main_path_index(spark, sf_dir):
    from ..operators.graph import depth_by_sql

    return depth_by_sql(spark, messages(spark, sf_dir)).withColumnRenamed("depth", "main_path_index")


@_query(f"WITH {_M} SELECT a.conversation_id, a.node_id AS parent_node_id, b.node_id AS child_node_id, 0::BIGINT AS child_index FROM m a JOIN m b ON b.conversation_id = a.conversation_id AND b.parent_id = a.node_id")
def node_edges(spark, sf_dir):
    w = Window.partitionBy("conversation_id").orderBy("turn")
    m = messages(spark, sf_dir).withColumn("child_node_id", F.lead("node_id").over(w))
    return m.where("child_node_id is not null").select("conversation_id", F.col("node_id").alias("parent_node_id"), "child_node_id", F.lit(0).cast("long").alias("child_index"))


@_query("SELECT user_id, event_type, count(*) AS children FROM events GROUP BY user_id, event_type HAVING count(*) > 1")
def branch_points(spark, sf_dir):
    """Nodes with more than one child; an event hangs below its user's node of its type."""
    return _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("children")).where("children > 1")


@_query(
    f"""WITH {_M} SELECT conversation_id, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_message_count, count(*) FILTER (role = 'assistant') AS assistant_message_count,
  count(*) FILTER (role = 'system') AS system_message_count, count(*) FILTER (role = 'tool') AS tool_message_count FROM m GROUP BY conversation_id"""
)
def conversation_role_counts(spark, sf_dir):
    return role_counts(messages(spark, sf_dir))


def role_counts(m: DataFrame) -> DataFrame:
    of = lambda r: F.count_if(F.coalesce(F.col("role"), F.lit("")) == r).alias(f"{r}_message_count")
    return m.groupBy("conversation_id").agg(F.count("*").alias("message_count"), *(of(r) for r in ("user", "assistant", "system", "tool")))


def first_and_last_texts(m: DataFrame, order: str = "turn") -> DataFrame:
    """First and last non-empty user text and last assistant text of each conversation."""
    said = lambda role: F.when((F.col("role") == role) & (F.col("text") != ""), F.struct(F.col(order).alias("o"), F.col("text").alias("t")))
    return m.groupBy("conversation_id").agg(F.min(said("user"))["t"].alias("first_user"), F.max(said("user"))["t"].alias("last_user"), F.max(said("assistant"))["t"].alias("last_assistant"))


_TEXTS = "SELECT conversation_id, arg_min(text, turn) FILTER (role = 'user' AND text <> '') AS first_user, arg_max(text, turn) FILTER (role = 'user' AND text <> '') AS last_user, arg_max(text, turn) FILTER (role = 'assistant' AND text <> '') AS last_assistant FROM m GROUP BY conversation_id"


@_query(f"WITH {_M} {_TEXTS}")
def first_last_texts(spark, sf_dir):
    return first_and_last_texts(messages(spark, sf_dir))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KEYWORDS = f"""kw0 AS (SELECT conversation_id, turn, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word, generate_subscripts(regexp_extract_all(lower(text), '{TOKEN}'), 1) AS p FROM m),
kw1 AS (SELECT conversation_id, word, count(*) AS n, min({{'t': turn, 'p': p}}) AS f FROM kw0 WHERE word NOT IN ({_STOP}) GROUP BY ALL),
kw AS (SELECT conversation_id, string_agg(word, ', ' ORDER BY r) AS keyword_text FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY n DESC, f) AS r FROM kw1) WHERE r <= 6 GROUP BY ALL)"""


@_query(f"WITH {_M}, {_KEYWORDS} SELECT * FROM kw")
def conversation_keywords(spark, sf_dir):
    return top_keywords(messages(spark, sf_dir), "conversation_id", "turn", "text")


@_query(f"SELECT doc_id, {_clean('text', 400)} AS clean FROM documents")
def clean_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("clean"))


@_query(
    f"""WITH {_M}, {_KEYWORDS}, t AS ({_TEXTS}), c AS (SELECT t.conversation_id, keyword_text, {_clean('first_user', 180)} AS a, {_clean('last_user', 180)} AS b, {_clean('last_assistant', 180)} AS c FROM t LEFT JOIN kw USING (conversation_id))
SELECT conversation_id, concat_ws(' ', CASE WHEN coalesce(keyword_text, '') <> '' THEN 'Conversation focused on ' || array_to_string(string_split(keyword_text, ', ')[1:3], ', ') || '.' ELSE 'General conversation.' END,
  'It starts with the user asking about ' || a || '.', CASE WHEN c IS NOT NULL THEN 'The latest assistant response covers ' || c || '.' WHEN b IS NOT NULL AND b IS DISTINCT FROM a THEN 'Later the user returns to ' || b || '.' END,
  CASE WHEN coalesce(keyword_text, '') <> '' THEN 'Keywords: ' || array_to_string(string_split(keyword_text, ', ')[1:5], ', ') || '.' END) AS summary_text FROM c"""
)
def conversation_summary(spark, sf_dir):
    m = messages(spark, sf_dir)
    both = first_and_last_texts(m).join(top_keywords(m, "conversation_id", "turn", "text"), "conversation_id", "left")
    return both.select("conversation_id", summary(F.lit(None).cast("string"), F.col("first_user"), F.col("last_user"), F.col("last_assistant"), F.col("keyword_text")).alias("summary_text"))


_STRIP = "string_split_regex(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def _tok(c: str) -> str:
    return "list_filter(" + _STRIP.format(c) + ", lambda x: x <> '')"


@_query(f"SELECT doc_id FROM documents WHERE list_contains({_tok('text')}, 'license')")
def search_term(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(matches("license", {"text": F.col("text")})).select("doc_id")


@_query(f"SELECT doc_id FROM documents WHERE len(list_filter({_tok('text')}, lambda x: starts_with(x, 'licens'))) > 0")
def search_prefix(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(matches("licens*", {"text": F.col("text")})).select("doc_id")


@_query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_tok('text')}, ' ') || ' ', ' licensed under the ')")
def search_phrase(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(matches('"licensed under the"', {"text": F.col("text")})).select("doc_id")


@_query(
    f"""SELECT conv_id, turn FROM (SELECT *, {_tok('text')} AS t, {_tok('role')} AS r FROM conversations)
WHERE (list_contains(r, 'user') OR list_contains(t, 'user')) AND (list_contains(t, 'the') OR list_contains(t, 'der')) AND NOT list_contains(t, 'of')"""
)
def search_boolean(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations")
    return t.where(matches("user AND (text:the OR text:der) NOT text:of", {"role": F.col("role"), "text": F.col("text")})).select("conv_id", "turn")


@_query(
    f"""WITH {_M} SELECT conversation_id, message_id, turn FROM m WHERE list_contains({_tok('text')}, 'the') AND role = 'assistant' AND message_kind = 'user_visible_assistant'
ORDER BY turn DESC, message_id LIMIT 20 OFFSET 5"""
)
def search_filtered_page(spark, sf_dir):
    """A page of hits: the limit is the feature."""
    m = messages(spark, sf_dir).where(matches("text:the", {"role": F.col("role"), "text": F.col("text")}) & (F.col("role") == "assistant") & (F.col("message_kind") == "user_visible_assistant"))
    return m.orderBy(F.desc("turn"), "message_id").offset(5).limit(20).select("conversation_id", "message_id", "turn")


@_query(
    r"""SELECT page_id, nullif(lower(regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?', 1)), '') AS scheme, nullif(regexp_extract(url, '^[^/]*//([^/?#]*)', 1), '') AS domain,
  nullif(regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1), '') AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM pages"""
)
def url_parts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", split_url(F.col("url")).alias("u")).select("page_id", "u.*")


@_query("SELECT page_id, url, 4::BIGINT AS s, (4 + length(url))::BIGINT AS e FROM pages UNION ALL SELECT page_id, url, (11 + length(url))::BIGINT, (11 + 2 * length(url))::BIGINT FROM pages")
def url_extract(spark, sf_dir):
    text = F.concat(F.lit("see "), F.col("url"), F.lit("). and "), F.col("url"), F.lit("."))
    found = _table(spark, sf_dir, "pages").select("page_id", F.explode(extract_urls(text)).alias("u"))
    return found.select("page_id", "u.url", F.col("u.start").cast("long").alias("s"), F.col("u.end").cast("long").alias("e"))


@_query(f"WITH {_M} SELECT message_id, sha1(conversation_id || '||' || message_id || '||tool_call||||' || text) AS id FROM m")
def stable_ids(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", stable_id(F.col("conversation_id"), F.col("message_id"), F.lit("tool_call"), F.lit(None), F.col("text")).alias("id"))


@_query("SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS iso FROM events")
def iso_timestamps(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", iso_time(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("iso"))


@_query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_query("SELECT user_id, arg_max(event_id, {'t': ts, 'v': value, 'e': event_id}) AS event_id FROM events GROUP BY user_id")
def latest_snapshot(spark, sf_dir):
    """The snapshot that stands where each has a time: the latest, then the larger."""
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "value", "event_id"))["event_id"].alias("event_id"))


@_query(
    """SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS removed FROM (SELECT DISTINCT user_id, event_type FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events)
EXCEPT SELECT DISTINCT user_id, event_type FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events)) GROUP BY user_id"""
)
def snapshot_removed_ids(spark, sf_dir):
    """What the last day's snapshot of a user no longer has."""
    e = _table(spark, sf_dir, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.date_trunc("day", F.max("ts")).alias("cut"))))  # one row
    old, new = (e.where(c).select("user_id", "event_type").distinct() for c in ("ts < cut", "ts >= cut"))
    return old.join(new, ["user_id", "event_type"], "left_anti").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("removed"))


@_query("SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def unchanged_fingerprint(spark, sf_dir):
    f = _table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("fingerprint"), "doc_id")
    return f.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@_query("SELECT event_id FROM events WHERE ts::DATE >= DATE '2024-01-24' - INTERVAL 9 DAY")
def recent_bundle(spark, sf_dir):
    """Nine days back from a fixed day, by date."""
    return _table(spark, sf_dir, "events").where(F.to_date("ts") >= F.date_sub(F.lit("2024-01-24").cast("date"), 9)).select("event_id")


@_query(f"WITH {_M}, c AS (SELECT conversation_id, max(turn) AS last_turn, count(*) AS message_count FROM m GROUP BY ALL) SELECT * FROM c ORDER BY last_turn DESC NULLS LAST, conversation_id LIMIT 10")
def conversations_ordered(spark, sf_dir):
    """A page of conversations: the limit is the feature."""
    c = messages(spark, sf_dir).groupBy("conversation_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("message_count"))
    return c.orderBy(F.desc_nulls_last("last_turn"), "conversation_id").limit(10)


@_query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL OR l.toxic = 0")
def hidden_filter(spark, sf_dir):
    return _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").where("toxic is null or toxic = 0").select("doc_id")


@_query("SELECT 'missing_label' AS type, doc_id AS id FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'orphan_order', l_orderkey FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey")
def check_orphans(spark, sf_dir):
    d, l = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    li, o = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    return d.join(l, "doc_id", "left_anti").select(F.lit("missing_label").alias("type"), F.col("doc_id").alias("id")).union(li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_anti").select(F.lit("orphan_order"), "l_orderkey"))


@_query(f"WITH {_M} SELECT conversation_id, count(*) AS actual, max(turn) + 2 AS stored FROM m GROUP BY conversation_id HAVING count(*) <> max(turn) + 2")
def check_counts(spark, sf_dir):
    """Conversations whose stored count, off by one here, is not the actual one."""
    c = messages(spark, sf_dir).groupBy("conversation_id").agg(F.count("*").alias("actual"), (F.max("turn") + 2).alias("stored"))
    return c.where("actual <> stored")


@_query("SELECT '$.' || k AS path, count(*) AS observations, count(DISTINCT v) AS types, string_agg(DISTINCT v, ',') AS type FROM (SELECT unnest(json_keys(props)) AS k, 'number' AS v FROM events) GROUP BY k")
def profile_paths(spark, sf_dir):
    """Structural paths of a JSON column: how often each is met and with which types."""
    from ..operators.profile import walk_column

    walked = walk_column(_table(spark, sf_dir, "events").select("props"), "props").where("path <> '$'")
    return walked.groupBy("path").agg(F.count("*").alias("observations"), F.count_distinct("type").alias("types"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("type"))


@_query(
    f"""WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS i FROM m)
SELECT conversation_id, 'Title: ' || conversation_id || chr(10) || 'Conversation ID: ' || conversation_id || chr(10) || chr(10) ||
  string_agg(i || '. ' || role || chr(10) || 'kind: ' || message_kind || chr(10) || text || chr(10) || chr(10) || repeat('-', 40) || chr(10), chr(10) ORDER BY i) AS content FROM r GROUP BY conversation_id"""
)
def export_text(spark, sf_dir):
    from ..operators.export import render_text

    m = messages(spark, sf_dir).select("conversation_id", F.col("turn").alias("time_index"), "role", F.lit(None).cast("string").alias("created_at"), "message_kind", F.lit(None).cast("string").alias("model"), "text", F.lit(False).alias("is_hidden"))
    c = m.select(F.col("conversation_id").cast("string").alias("id")).distinct().select("id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("created_at"))
    return render_text(c, m.withColumn("conversation_id", F.col("conversation_id").cast("string"))).select(F.col("id").cast("long").alias("conversation_id"), "content")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
