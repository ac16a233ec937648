"""Time and bucket expressions (P4, P18-P23).  All JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_ms(ts) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ (or TIMESTAMP) column.

    ``timestampdiff`` on NTZ values does not depend on the session time zone,
    so the result is the same on every cluster.
    """
    return F.timestamp_diff(
        "MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts).cast("timestamp_ntz")
    )


def publish_timestamp(ms) -> Column:
    """The event time carried in messages, epoch ms as a string."""
    return _c(ms).cast("string")


def wallclock_string(ts) -> Column:
    """``%Y-%m-%d %H:%M:%S.0`` wall-clock text."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss'.0'")


def ms_from_string(s) -> Column:
    """Numeric epoch ms from its string form."""
    return F.expr("try_cast({} AS BIGINT)".format(s)) if isinstance(s, str) else _c(s).try_cast("bigint")


def bucket(t, origin, bucket_ms: int, shift=0) -> Column:
    """``floor((t - origin) / bucket_ms) + shift``, as a long."""
    return (F.floor((_c(t) - _c(origin)) / F.lit(bucket_ms)) + shift).cast("long")


def ten_bucket(b, width: int = 10) -> Column:
    """Bucket rounded down to a multiple of ``width`` (the evident intent)."""
    return (F.floor(_c(b) / F.lit(width)) * width).cast("long")
