"""Ids and null handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor the empty string; the last as it is."""
    return F.coalesce(*(blank_to_null(c) for c in columns[:-1]), columns[-1])


def stable_id(*parts: Column) -> Column:
    """SHA-1 (hex) of the parts joined by two bars; null counts as nothing."""
    return F.sha1(F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
