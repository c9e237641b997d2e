"""Urls in text and their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import blank_to_null

#: (?U): white space of all scripts ends a url, not only that of ASCII.
URL = r"(?U)https?://\S+"
_TRAIL = ").,]>\"'"
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def split_url(url: Column) -> Column:
    """struct(scheme, domain, path, query), each null where absent; parameters behind `;` in the last path segment are dropped."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    path = F.regexp_replace(part(3), r";[^/]*$", "")
    return F.struct(blank_to_null(F.lower(part(1))).alias("scheme"), blank_to_null(part(2)).alias("domain"), blank_to_null(path).alias("path"), blank_to_null(part(4)).alias("query"))


def extract_urls(text: Column) -> Column:
    """array of struct(url, start, end) in order; places in code points, punctuation behind a url is not part of it."""
    raw = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<url:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, u: Column) -> Column:
        s = F.call_function("locate", u, text, acc["at"] + 1) - 1
        url = F.call_function("rtrim", F.lit(_TRAIL), u)
        one = F.array(F.struct(url.alias("url"), s.cast("int").alias("start"), (s + F.length(url)).cast("int").alias("end")))
        return F.struct((s + F.length(u)).cast("int").alias("at"), F.concat(acc["out"], one).alias("out"))

    return F.aggregate(raw, start, step, lambda acc: acc["out"])
