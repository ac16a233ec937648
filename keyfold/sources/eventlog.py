"""Text event log ``key=json``.

The generator of the reference writes one folder per period with lines like
``aaaa={"userId":"aaaa","quantity":3,"itemId":"x1","publishTimestamp":"2024-01-01 00:00:00.0"}``.
Here the lines are derived from the driver's events table by column
expressions and written with ``partitionBy("period")``, one folder per
period, by all tasks in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import codecs
from keyfold.functions.timefns import wallclock_string
from keyfold.sources import testdata as td


def period_col(ts="ts"):
    """Period of an event: its calendar day, as days since 1970-01-01, so that
    periods follow time order however long the log is."""
    return F.unix_date(F.col(ts).cast("date")).cast("int")


def lines_from_events(events: DataFrame, restock_qty: int = 300) -> DataFrame:
    """Log lines from the events table.

    Columns: event_id, ts, period, kind, value (the line).  ``error`` events
    become a cut-off record (the consumer was killed mid-write).
    """
    kind = td.kind_col()
    user = F.col("user_id").cast("string")
    item = td.item_col().cast("string")
    stamp = wallclock_string(F.col("ts"))
    add = F.to_json(
        F.struct(
            user.alias("userId"),
            td.raw_add_quantity().alias("quantity"),
            item.alias("itemId"),
            stamp.alias("publishTimestamp"),
        )
    )
    checkout = F.to_json(F.struct(user.alias("userId"), stamp.alias("publishTimestamp")))
    restock = F.to_json(
        F.struct(item.alias("itemId"), F.lit(restock_qty).alias("quantity"), stamp.alias("publishTimestamp"))
    )
    garbage = F.concat(F.lit('{"userId":"'), user, F.lit('","quantity":'))
    line = (
        F.when(kind == "add", codecs.key_line(user, add))
        .when(kind == "checkout", codecs.key_line(user, checkout))
        .when(kind == "restock", codecs.key_line(item, restock))
        .otherwise(codecs.key_line(user, garbage))
    )
    return events.select("event_id", "ts", period_col().alias("period"), kind.alias("kind"), line.alias("value"))


def inject_poison_first_add(lines: DataFrame, fail_period: int) -> DataFrame:
    """The first add of ``fail_period`` (in (ts, event_id) order) gets
    quantity ``-1``, as the replayer does once per run.

    The first add is found with ``min_by`` (a map-side aggregate, one row),
    not a window over the period.
    """
    first = (
        lines.where((F.col("kind") == "add") & (F.col("period") == fail_period))
        .agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("_poison_id"))
    )
    tagged = lines.join(F.broadcast(first), F.col("event_id") == F.col("_poison_id"), "left")
    key, body = codecs.split_key_line("value")
    return tagged.select(
        *[c for c in lines.columns if c != "value"],
        F.when(F.col("_poison_id").isNotNull(), codecs.key_line(key, codecs.inject_poison(body)))
        .otherwise(F.col("value"))
        .alias("value"),
    )


def write_periods(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per period (``period=N``), text files of lines."""
    lines.select("period", "value").write.mode(mode).partitionBy("period").text(path)


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """Read all periods back; ``period`` comes from the folder name."""
    return spark.read.text(path).select("*", F.col("_metadata.file_path").alias("source_file"))
