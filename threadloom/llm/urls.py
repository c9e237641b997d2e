"""URL filters: rules, then a tree of path templates for each host.

Native: DataFrame functions only. A path's numbers and long hexadecimal runs are generalised, equal templates
are counted with their labels (a rule's verdict is the label of the urls that it fits), and the tree is walked
from the root: a node with more than CHILDREN distinct children has them replaced by a wildcard. Siblings with
equal tenths of smoothed purity are then merged into one branch, from the deepest level up to LEVELS. Templates
in a branch, at any of these levels, of at least LABELLED labelled urls whose smoothed share of blocked labels
reaches PURE hundredths are rejected. Purity is smoothed towards the share of all labels with the weight of
SMOOTH labels.

The tree is as deep as the paths; it takes a round more for each level below LEVELS at which templates part.
Empty segments at a path's end do not count. SQL has the first LEVELS segments only and compares the rest as
text: its rows are the same where no path is longer. Null urls and
urls without :// have empty host and path and no rule. Repeated rows count each. Other columns are not read.
An empty table gives an empty result. With no labels at all nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LEVELS, CHILDREN, SMOOTH, LABELLED, PURE = 3, 16, 4, 5, 80
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def split_url(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its verdict."""
    out = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, h + p) if out is None else out.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (out, verdict) if out is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def general(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-f]{12,}", "x"), "[0-9]+", "0")


def _purity(k: int) -> Column:
    """Smoothed purity in whole k-ths: (bad * all_n + SMOOTH * all_bad) / ((n + SMOOTH) * all_n)."""
    return F.when(F.col("all_n") == 0, F.lit(0)).otherwise(F.expr(f"({k} * (bad * all_n + {SMOOTH} * all_bad)) div greatest((n + {SMOOTH}) * all_n, 1)"))


def _above(level: int) -> Column:
    """The first level - 1 steps; where there are fewer, the rest are empty."""
    return F.concat(F.slice("steps", 1, level - 1), F.array_repeat(F.lit(""), F.greatest(F.lit(level - 1) - F.size("steps"), F.lit(0))))


def _deeper(tree: DataFrame, levels: int) -> tuple[DataFrame, int]:
    """tree with wildcards below the first levels too, and the last level at which templates part.

    A round for each level, as far down as different templates share all the steps above it.
    """
    level = levels
    while True:
        at = tree.select("host", "steps", _above(level + 1).alias("above"), F.coalesce(F.get("steps", F.lit(level)), F.lit("")).alias("child"))
        shared = at.groupBy("host", "above").agg(F.max(F.size("steps")).alias("deep"), F.min("steps").alias("a"), F.max("steps").alias("b"))
        if shared.where((F.col("deep") > level) & (F.col("a") != F.col("b"))).isEmpty():
            return tree, level
        level += 1
        wild = at.groupBy("host", "above", "child").agg(F.count("*").alias("c")).groupBy("host", "above").agg(F.count("*").alias("c")).where(F.col("c") > CHILDREN).select("host", "above", F.lit(True).alias("wild"))
        starred = F.concat("above", F.array(F.lit("*")), F.slice("steps", level + 1, 1 << 30))
        tree = tree.withColumn("above", _above(level)).join(wild, ["host", "above"], "left").withColumn("steps", F.when(F.col("wild"), starred).otherwise(F.col("steps"))).drop("above", "wild")
        tree = written(tree.sparkSession, tree, f"urls-{level}")


def judged_templates(urls: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(host, shape) of rejected templates; urls: host, shape (generalised path), label (1 blocked, 0 allowed, null)."""
    spark = urls.sparkSession
    leaves = written(spark, urls.groupBy("host", "shape").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")), "urls")
    totals = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("all_bad"))
    parts = F.split(F.regexp_replace("shape", "/+$", ""), "/")
    tree = leaves.select("*", *(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(f"s{i}") for i in range(1, levels + 1)), F.slice(parts, levels + 2, 1 << 30).alias("rest"))
    for i in range(1, levels + 1):
        above = ["host", *(f"s{j}" for j in range(1, i))]
        wild = tree.groupBy(*above, f"s{i}").agg(F.count("*").alias("c")).groupBy(*above).agg(F.count("*").alias("c")).where(F.col("c") > CHILDREN).select(*above, F.lit("*").alias("wild"))
        tree = tree.join(wild, above, "left").withColumn(f"s{i}", F.coalesce("wild", f"s{i}")).drop("wild")
    tree = tree.select("host", "shape", "n", "bad", F.concat(F.array(*(f"s{j}" for j in range(1, levels + 1))), "rest").alias("steps"))
    tree, level = _deeper(written(spark, tree, "urls-tree"), levels)
    templates = tree.groupBy("host", "steps").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(totals))  # one row of totals
    templates = templates.select("*", F.col("n").alias("own_n"), F.col("bad").alias("own_bad"), F.lit(False).alias("rejected"))
    while level >= levels:  # siblings of equal tenths, from the leaves up; own labels of a branch's templates sum to the branch's
        inner = F.size("steps") >= level
        templates = templates.withColumn("above", F.when(inner, F.slice("steps", 1, level - 1))).withColumn("tenth", F.when(inner, _purity(10)))
        branch = ["host", "above", "tenth"]
        merged = templates.where("above is not null").groupBy(*branch).agg(F.sum("own_n").alias("_n"), F.sum("own_bad").alias("_bad"))
        templates = templates.join(merged, branch, "left").withColumn("n", F.coalesce("_n", "n")).withColumn("bad", F.coalesce("_bad", "bad"))
        templates = templates.withColumn("rejected", F.col("rejected") | (F.col("above").isNotNull() & (F.col("n") >= LABELLED) & (_purity(100) >= PURE))).drop("above", "tenth", "_n", "_bad")
        if level > levels:
            templates = written(spark, templates, f"urls-up-{level}")
        level -= 1
    return tree.join(templates.where("rejected").select("host", "steps"), ["host", "steps"], "left_semi").select("host", "shape")


def verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, kind = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("kind", kind).withColumn("shape", general(F.col("path")))
    urls = rows.select("host", "shape", F.when(F.col("kind") == "block", 1).when(F.col("kind") == "allow", 0).alias("label"))
    rejected = judged_templates(urls).withColumn("rejected", F.lit("block"))
    out = rows.join(rejected, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("kind", "rejected", F.lit("allow")).alias("verdict"))


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order) + " END"
    kind = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in order) + " END"
    cols = [f"s{i}" for i in range(1, LEVELS + 1)]
    parts = ["t0 AS (SELECT *, " + ", ".join(f"coalesce(string_split(shape, '/')[{i + 2}], '') AS {c}" for i, c in enumerate(cols)) + f", coalesce(array_to_string(string_split(shape, '/')[{LEVELS + 2}:], '/'), '') AS tail FROM leaves)"]
    for i, c in enumerate(cols):
        above = ["host", *cols[:i]]
        dense = f"(SELECT {', '.join(above)}, count(DISTINCT {c}) AS c FROM t{i} GROUP BY ALL)"
        parts.append(f"t{i + 1} AS (SELECT t.* REPLACE (CASE WHEN d.c > {CHILDREN} THEN '*' ELSE t.{c} END AS {c}) FROM t{i} t JOIN {dense} d USING ({', '.join(above)}))")
    steps = ", ".join(["host", *cols, "tail"])
    branch = ", ".join(["host", *cols[:-1]])
    purity = lambda k: f"CASE WHEN all_n = 0 THEN 0 ELSE ({k} * (bad * all_n + {SMOOTH} * all_bad)) // greatest((n + {SMOOTH}) * all_n, 1) END"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {rule} AS rule, {kind} AS kind, regexp_replace(regexp_replace(path, '[0-9a-f]{{12,}}', 'x', 'g'), '[0-9]+', '0', 'g') AS shape FROM h),
leaves AS (SELECT host, shape, count(kind)::BIGINT AS n, count(*) FILTER (kind = 'block')::BIGINT AS bad FROM r GROUP BY ALL),
totals AS (SELECT sum(n)::BIGINT AS all_n, sum(bad)::BIGINT AS all_bad FROM leaves),
{", ".join(parts)},
templates AS (SELECT *, {purity(10)} AS tenth FROM (SELECT {steps}, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM t{LEVELS} GROUP BY ALL) CROSS JOIN totals),
merged AS (SELECT {branch}, tenth, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, all_n, all_bad FROM templates GROUP BY {branch}, tenth, all_n, all_bad),
rejected AS (SELECT {branch}, tenth FROM merged WHERE n >= {LABELLED} AND {purity(100)} >= {PURE}),
bad AS (SELECT DISTINCT host, shape FROM t{LEVELS} JOIN (SELECT {steps} FROM templates JOIN rejected USING ({branch}, tenth)) USING ({steps}))
SELECT page_id, r.host, path, rule, coalesce(kind, CASE WHEN bad.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM r LEFT JOIN bad ON bad.host = r.host AND bad.shape = r.shape
"""


SQL = _sql()
