"""Secret scans: fixed patterns, and candidates judged by who owns copies of them in the corpus.

Native: DataFrame functions only. The base kinds are assign, access and hex. Other long mixed tokens are
candidates: values met with at most LIVE_OWNERS owners and LIVE_REPOS repositories look live and give a span
of kind `live`; those met with more are copied examples and give none. Base spans stay whatever the count, and
their values are counted in the same way (n_live, n_example).

Places are code points, end exclusive. Null texts are empty, null owners and repositories count as one each.
Rows with equal doc_id are scanned each by itself; equal texts share their result. Other columns are not read
by scan(); redact() passes them through. A text without candidates has empty spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .quality import let

KINDS = ("assign", "access", "hex", "live")
_KEY = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run of AKIA[A-Z0-9]+ that is long enough holds no shorter match before it
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_-]{24,}"
LIVE_OWNERS, LIVE_REPOS = 2, 3
_SPAN = "array<struct<s:int,e:int,v:string>>"


def _found(text: Column, pattern: str, group: int, test) -> Column:
    """The matches that pass, with their places, from the matches and the text between them."""

    def fold(both: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            m = F.get(both["m"], i)
            s = acc["at"] + F.length(F.get(both["p"], i))
            e = s + F.length(m)
            value = m if group == 0 else F.regexp_extract(m, pattern, group)
            one = F.array(F.struct(s.alias("s"), e.alias("e"), value.alias("v")))
            return F.struct(e.alias("at"), F.when(test(value), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(both["m"]) - 1), start, step, lambda acc: acc["out"])

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return let(both, lambda b: F.when(F.size(b["m"]) == 0, F.array().cast(_SPAN)).otherwise(fold(b)))


def found(docs: DataFrame, text: str = "text", owner: str = "source", repo: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, key (text digest), owner, repo, and the spans of each kind and of candidates."""
    t = F.col("_t")
    none = F.array().cast(_SPAN)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), name(owner).alias("owner"), F.concat_ws("/", *(name(c) for c in repo)).alias("repo"), text_or_empty(text).alias("_t"))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    always = lambda v: F.lit(True)
    return rows.select(
        "doc_id",
        "owner",
        "repo",
        F.md5("_t").alias("key"),
        F.when(F.contains(t, F.lit(":")) | F.contains(t, F.lit("=")), _found(t, ASSIGN, 2, lambda v: F.length(v) >= 8)).otherwise(none).alias("assign"),
        F.when(F.contains(t, F.lit("AKIA")), _found(t, ACCESS, 0, always)).otherwise(none).alias("access"),
        F.when(t.rlike(HEX), _found(t, HEX, 0, always)).otherwise(none).alias("hex"),
        F.when(t.rlike(CANDIDATE), _found(t, CANDIDATE, 0, mixed)).otherwise(none).alias("other"),
    )


def ownership(values: DataFrame, live_owners: int = LIVE_OWNERS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """(h, owners, repos, live) of (h, owner, repo) rows; repeats fall away before the counts are shuffled."""
    return values.select("h", "owner", "repo").distinct().groupBy("h").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos")).withColumn("live", (F.col("owners") <= live_owners) & (F.col("repos") <= live_repos))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, key, all_spans (array of start, end, kind number, value, live) and base_spans of every row."""
    rows = written(docs.sparkSession, found(docs, text, owner, repo), "secrets")
    values = rows.select("key", "owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("assign", "access", "hex", "other"), lambda x: F.xxhash64(x["v"])))).alias("h"))
    judged = values.select("key", "h").distinct().join(ownership(values).where("live"), "h")  # a widely copied value meets none of its texts
    by_text = judged.groupBy("key").agg(F.collect_set("h").alias("lives"))
    out = rows.join(by_text, "key", "left").withColumn("lives", F.coalesce("lives", F.array().cast("array<long>")))
    live = lambda x: F.array_contains(F.col("lives"), F.xxhash64(x["v"]))
    of = lambda column, kind: F.transform(column, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k"), live(x).alias("live")))
    out = out.withColumn("base_spans", F.array_sort(F.concat(*(of(F.col(c), i) for i, c in enumerate(KINDS[:3]))), lambda a, b: _order(a, b)))
    more = F.filter(of(F.col("other"), 3), lambda x: x["live"] & ~F.exists("base_spans", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    return out.withColumn("all_spans", F.array_sort(F.concat("base_spans", more), lambda a, b: _order(a, b)))


def _order(a: Column, b: Column) -> Column:
    """By start, then kind as listed."""
    return F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"])


def joined(spans: Column) -> Column:
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def verdicts(docs: DataFrame) -> DataFrame:
    """The digest columns of scan()."""
    count = lambda f: F.size(F.filter("all_spans", f)).cast("long")
    return scan(docs).select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("all_spans")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_example"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """docs with every span replaced by `mark`; spans that overlap are replaced once. No row goes."""

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        alone = F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(F.size(acc) == 0, alone).when(F.get(acc, F.size(acc) - 1)["e"] >= x["s"], longer).otherwise(alone)

    merged = F.aggregate("all_spans", F.array().cast("array<struct<s:int,e:int>>"), merge)
    spans = scan(docs, text).where(F.size("all_spans") > 0).select(F.col("key").alias("_key"), merged.alias("_spans")).dropDuplicates(["_key"])
    t = F.col(text)
    pieces = let(F.col("_spans"), lambda s: F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.substring(t, F.coalesce(F.get(s, i - 1)["e"], F.lit(0)) + 1, F.coalesce(F.get(s, i)["s"], F.length(t)) - F.coalesce(F.get(s, i - 1)["e"], F.lit(0)))))
    out = docs.withColumn("_key", F.md5(text_or_empty(text))).join(spans, "_key", "left")
    return out.withColumn(text, F.when(F.col("_spans").isNull(), t).otherwise(F.array_join(pieces, mark))).select(*docs.columns)


def _sql_spans(name: str, pattern: str, group: int, test: str) -> str:
    p = pattern.replace("'", "''")
    value = "m[i]" if group == 0 else f"regexp_extract(m[i], '{p}', {group})"
    return f"""{name} AS (
  SELECT rid, list_sum([length(x) FOR x IN p[1:i]])::BIGINT + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0)::BIGINT AS s, length(m[i]) AS n, {value} AS v
  FROM (SELECT rid, m, string_split_regex(t, '{p}') AS p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, t, regexp_extract_all(t, '{p}') AS m FROM d))
  WHERE {test.format(value)}
)"""


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo, coalesce(text, '') AS t FROM documents
), {_sql_spans("assign", ASSIGN, 2, "length({0}) >= 8")}, {_sql_spans("access", ACCESS, 0, "true")}, {_sql_spans("hex", HEX, 0, "true")},
{_sql_spans("other", CANDIDATE, 0, "regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[A-Z]') AND regexp_matches({0}, '[a-z]')")},
base AS (
  SELECT rid, s, s + n AS e, 0 AS k, v FROM assign UNION ALL SELECT rid, s, s + n, 1, v FROM access UNION ALL SELECT rid, s, s + n, 2, v FROM hex
), every AS (SELECT * FROM base UNION ALL SELECT rid, s, s + n, 3, v FROM other),
owned AS (SELECT v, count(DISTINCT owner) <= {LIVE_OWNERS} AND count(DISTINCT repo) <= {LIVE_REPOS} AS live FROM every JOIN d USING (rid) GROUP BY v),
spans AS (
  SELECT x.*, live FROM every x JOIN owned USING (v)
  WHERE k < 3 OR (live AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.s < x.e AND b.e > x.s))
), joined AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    coalesce(string_agg(['assign', 'access', 'hex', 'live'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
    string_agg(['assign', 'access', 'hex', 'live'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN joined USING (rid)
"""
