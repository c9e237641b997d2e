"""Quality rules: measures of one text, and lines that too many documents of a host share.

Native: DataFrame functions only. A line is normalised (lower case, runs of digits to 0, runs of white space
to one space, trimmed) and hashed with its host. Its count is the number of distinct texts of that host that
hold it, so copies of one text count once. A line is over the limit when more than LINE_DOCS texts hold it,
however many texts the host has; it is removed from all of these but the one with the smallest doc_id. A text
that loses more than DEPLETED hundredths of its characters that way is rejected. keep() works so; verdicts()
gives the rows of SQL, which asks besides that more than LINE_PERCENT hundredths of the host's texts hold it.

Null texts are empty: all measures 0, base_failed. A null host is a host of its own. Rows with equal doc_id
are judged each by its own text. Ties for the smallest doc_id go to the smaller text digest. Other columns
pass through `keep` untouched; columns whose names clash with ours do not disturb it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, text_or_empty, written

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
LINE_DOCS, LINE_PERCENT, DEPLETED = 20, 10, 50
#: The table of texts that lose lines is broadcast up to this size; bytes of one of its rows besides host and lines.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 64


def _host(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("host")


def _key(text: Column) -> Column:
    """A text's digest: 16 bytes."""
    return F.unhex(F.md5(text)).alias("key")


def let(value: Column, body) -> Column:
    """body(value), with value computed once even where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), f"{SPACE_CLASS}+", " "))


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash is met twice or more; hashes: by position."""

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - a, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda n, x: n + x))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0).cast("long")).otherwise(let(pairs, covered))


def measures(docs: DataFrame, text: str = "text", host: str = "source", keep: bool = False) -> DataFrame:
    """doc_id, host, key (text digest) and the measures of each row; keep: the row itself besides, as _row."""
    t = F.col("_t")
    more = ["_row"] * keep
    rows = docs.select(F.col("doc_id"), _host(host), text_or_empty(text).alias("_t"), *([F.struct(*docs.columns).alias("_row")] * keep))
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    words = F.filter(F.split(t, f"{SPACE_CLASS}+"), lambda x: x != "")
    windows = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).alias("h")))
    rows = rows.select(
        "doc_id",
        "host",
        *more,
        _key(F.col("_t")),
        F.length(F.regexp_replace(t, f"{SPACE_CLASS}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        let(windows, lambda w: F.struct(w["n"].alias("n_words"), F.when(w["h"].isNull(), F.lit(0).cast("long")).otherwise(_repeated(w["h"])).alias("n_repeat_words"))).alias("_w"),
    )
    rows = rows.select("doc_id", "host", *more, "key", "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def line_table(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(host, key, h, chars, doc_id): the distinct lines of each distinct text, how many characters they have in it, its smallest doc_id."""
    t = text_or_empty(text)
    lines = F.transform(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS)), normal_line)

    def counted(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda x, i: F.struct(x["h"].alias("h"), x["n"].alias("n"), i.alias("i"))), lambda y: (y["i"] == 0) | (F.get(s, y["i"] - 1)["h"] != y["h"]))
        return let(firsts, lambda b: F.transform(b, lambda y, k: F.struct(y["h"].alias("h"), (y["n"] * (F.coalesce(F.get(b, k + 1)["i"], F.size(s)) - y["i"])).cast("long").alias("chars"))))

    own = let(F.sort_array(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))), counted)
    rows = docs.select(F.col("doc_id"), _host(host), _key(t), F.explode(own).alias("x"))
    # a text that a host has more than once is one document
    return rows.groupBy("host", "key", F.col("x.h").alias("h")).agg(F.max("x.chars").alias("chars"), F.min("doc_id").alias("doc_id"))


def removed_lines(docs: DataFrame, text: str = "text", host: str = "source", percent: int | None = None) -> DataFrame:
    """(host, key, lost, removed): texts that lose lines, the characters lost and the hashes of the lines.

    With percent, a line must also be in more than that many hundredths of the host's texts. The line table is
    written once; it is counted and then joined with the lines over the limit.
    """
    lines = written(docs.sparkSession, line_table(docs, text, host), "lines")
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key")).alias("first"))
    over = counts.where(F.col("n") > LINE_DOCS)
    if percent is not None:
        texts = docs.select(_host(host), _key(text_or_empty(text))).distinct().groupBy("host").agg(F.count("*").alias("texts"))
        over = over.join(texts, "host").where(100 * F.col("n") > percent * F.col("texts"))
    over = over.select("host", "h", F.col("first.key").alias("first"))
    lost = lines.join(over, ["host", "h"]).where(F.col("key") != F.col("first"))
    return lost.groupBy("host", "key").agg(F.sum("chars").alias("lost"), F.collect_set("h").alias("removed"))


def verdicts(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The measures of every row, base_failed, kept, and the characters lost to common lines."""
    lost = removed_lines(docs, text, host, LINE_PERCENT).select("host", "key", F.col("lost").alias("lost_chars"))
    out = measures(docs, text, host).join(lost, ["host", "key"], "left").withColumn("lost_chars", F.coalesce("lost_chars", F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= DEPLETED * F.col("word_chars"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lost_chars")


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows that stay, with their lines over the limit removed; the columns of docs.

    Texts that fail by themselves go in the task that reads them. The texts that lose lines are written; while
    that table is known to be small it is sent to the texts, else both are shuffled by (host, digest).
    """
    spark = docs.sparkSession
    lost = written(spark, removed_lines(docs, text, host).select(F.col("host").alias("_host"), F.col("key").alias("_key"), F.col("lost").alias("_lost"), F.col("removed").alias("_removed")), "lost")
    size = lost.agg(F.coalesce(F.sum(F.octet_length("_host") + 8 * F.size("_removed") + ROW_BYTES), F.lit(0))).first()[0]
    t = text_or_empty(text)
    # rows go by an empty array, as a filter would be pushed down and measure every text again
    own = measures(docs, text, host, keep=True).select("*", F.explode(F.when(~F.col("base_failed"), F.array(F.lit(0)))).alias("_one"))
    joined = own.join(F.broadcast(lost) if size <= BROADCAST_BYTES else lost, (F.col("host") == F.col("_host")) & (F.col("key") == F.col("_key")), "left")
    stays = joined.where(100 * F.coalesce("_lost", F.lit(0)) <= DEPLETED * F.col("word_chars")).select("_row.*", "_removed")
    left = let(F.col("_removed"), lambda r: F.array_join(F.filter(F.split(t, "\n"), lambda x: ~(x.rlike(WORD_CLASS) & F.array_contains(r, F.xxhash64(normal_line(x))))), "\n"))
    return stays.withColumn(text, F.when(F.col("_removed").isNull(), F.col(text)).otherwise(left)).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), n AS (SELECT *, row_number() OVER () AS rid, len(w) AS n_words FROM w),
g AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, n_words - 6)) AS i FROM n WHERE n_words >= 8)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1
), rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, range(8) r(k) GROUP BY rid),
lines AS (
  SELECT host, t, x AS line, sum(length(x)) AS chars, min(doc_id) AS doc_id FROM (
    SELECT DISTINCT host, t, i, trim(regexp_replace(regexp_replace(lower(l[i]), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS x,
      min(doc_id) OVER (PARTITION BY host, t) AS doc_id
    FROM (SELECT doc_id, host, t, l, unnest(range(1, len(l) + 1)) AS i FROM n)
  ) GROUP BY host, t, x
), texts AS (SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY host),
counts AS (SELECT host, line, count(*) AS n, min({'doc_id': doc_id, 'key': md5(t)}) AS first FROM lines GROUP BY host, line),
over AS (SELECT c.host, c.line, c.first.key AS first FROM counts c JOIN texts USING (host) WHERE n > 20 AND 100 * n > 10 * texts),
lost AS (SELECT l.host, l.t, sum(l.chars) AS lost FROM lines l JOIN over o ON l.host = o.host AND l.line = o.line WHERE md5(l.t) <> o.first GROUP BY l.host, l.t),
m AS (
  SELECT n.doc_id, n_words::BIGINT AS n_words, length(regexp_replace(n.t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(n.t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM n LEFT JOIN rep USING (rid) LEFT JOIN lost ON lost.host = n.host AND lost.t = n.t
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept, lost_chars
FROM m
"""
