"""Per-key aggregates.

All are grouped aggregates with map-side partial aggregation, so a hot key
costs one partial row per task, never a whole group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")


def latest_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """The latest value per key in (ts, event_id) order (harness state)."""
    return df.groupBy(key).agg(
        F.max_by(value, F.struct(*ORDER)).alias("latest_message"),
        F.max_by("event_id", F.struct(*ORDER)).alias("latest_event_id"),
        F.count(F.lit(1)).alias("n_messages"),
    )


def first_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """First-seen value per key (state set only if null)."""
    return df.groupBy(key).agg(
        F.min_by(value, F.struct(*ORDER)).alias("first_message"),
        F.min_by("event_id", F.struct(*ORDER)).alias("first_event_id"),
    )


def frequency(df: DataFrame, key: str) -> DataFrame:
    """Events per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"))


def distinct_by_period(df: DataFrame, key: str, period: str) -> DataFrame:
    """Distinct keys per period, keys first seen in the period, and the
    cumulative distinct count.

    First-seen is ``min(period)`` per key (an aggregate); the running sum is
    a window over the per-period table, which has one row per period.
    """
    per = df.groupBy(period).agg(F.count_distinct(key).alias("n_distinct"))
    first = df.groupBy(key).agg(F.min(period).alias(period)).groupBy(period).agg(
        F.count(F.lit(1)).alias("n_new")
    )
    w = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        per.join(first, period, "left")
        .select(period, "n_distinct", F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"))
        .withColumn("n_cumulative", F.sum("n_new").over(w).cast("long"))
    )


def every_nth(df: DataFrame, n: int, key_order=ORDER) -> DataFrame:
    """F13 + W6: progress marks -- every n-th event overall with its running count.

    Rows are range-partitioned and sorted on (ts, event_id); the global
    position is the partition's offset (a running sum over a table of one
    row per partition) plus the row's index inside its partition, read from
    ``monotonically_increasing_id`` (partition id in the upper bits).  No
    task ever sees all rows.  The ranged frame feeds both the counts and the
    rows, so it is written once (``session.write_table``): range bounds are
    sampled per plan instance and must be the same for both.
    """
    from keyfold.session import write_table

    ranged = write_table(
        df.repartitionByRange(*key_order)
        .sortWithinPartitions(*key_order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", 33))
        .withColumn("_i", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1),
        "ranged",
    )
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    pos = ranged.join(F.broadcast(offs), "_pid").withColumn("position", F.col("_off") + F.col("_i"))
    return pos.where(F.col("position") % n == 0).drop("_mid", "_pid", "_i", "_off")
