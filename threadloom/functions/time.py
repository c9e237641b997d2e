"""Epoch seconds to the archive's ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_time(seconds: Column) -> Column:
    """`2023-11-14T22:13:20Z`, with six decimals only where there is a fraction; null for null, NaN and what no date can hold.

    Microseconds are rounded half to even. The session's time zone must be UTC.
    """
    micros = F.bround(seconds.cast("double") * 1_000_000, 0)
    fits = seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (F.abs(seconds) < 2.5e11) & (seconds >= -62135596800)
    ts = F.timestamp_micros(F.when(fits, micros).cast("bigint"))
    short = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros % 1_000_000 == 0, F.concat(short, F.lit("Z"))).otherwise(F.concat(short, F.date_format(ts, ".SSSSSS"), F.lit("Z")))
