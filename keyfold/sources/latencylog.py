"""Latency log: one JSON line per confirmation.

Record: ``{"inputKafkaTimestamp": "<epoch ms string>", "outputKafkaTimestamp": <epoch ms>}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold import schemas
from keyfold.functions.timefns import epoch_ms


def from_events(events: DataFrame, n_runs: int = 3) -> DataFrame:
    """Latency records derived from the driver's events table (FIXTURES.md).

    ``in = epoch_ms(ts)``, ``out = in + floor(value)``, ``run = event_id % n_runs``.
    """
    ms = epoch_ms("ts")
    return events.select(
        F.pmod(F.col("event_id"), F.lit(n_runs)).cast("long").alias("run"),
        ms.cast("string").alias("inputKafkaTimestamp"),
        (ms + F.floor("value")).cast("long").alias("outputKafkaTimestamp"),
    )


def from_confirms(confirms: DataFrame, output_ms) -> DataFrame:
    """Latency record from a confirmation and the record time of its output."""
    return confirms.select(
        F.col("publishTimestamp").alias("inputKafkaTimestamp"),
        output_ms.cast("long").alias("outputKafkaTimestamp"),
    )


def write_json(log: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S10 sink: JSON lines (``run`` becomes a folder when present)."""
    w = log.write.mode(mode)
    if "run" in log.columns:
        w = w.partitionBy("run")
    w.json(path)


def read_json(spark: SparkSession, path: str, run=None, drop_corrupt: bool = True) -> DataFrame:
    """S11 + S12: read JSON lines with a declared schema.

    A truncated last record (the consumer was killed mid-write) lands in
    ``_corrupt_record`` and is dropped; unlike the reference shell script,
    a good last line is kept.
    """
    schema = T.StructType(list(schemas.LATENCY_LOG.fields) + [T.StructField("_corrupt_record", T.StringType())])
    df = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    if drop_corrupt:
        # also test a real field: Spark refuses plans that read only the corrupt column
        df = df.where(F.col("_corrupt_record").isNull() & F.col("outputKafkaTimestamp").isNotNull())
    df = df.drop("_corrupt_record")
    if run is not None:
        df = df.withColumn("run", F.lit(run))
    return df


def forward_fill_failed(raw: DataFrame, order_cols=("partition", "offset")) -> DataFrame:
    """W5 (opt-in): a record that failed to parse re-uses the previous record's
    input time with its own output time, as the reference consumer does.

    ``raw`` holds ``partition, offset, value (text), timestamp (ms)``.  The last
    parsed time is carried along each topic partition by the range pass, so a
    partition is cut into many tasks, and a run of failures over any number of
    them too; one shuffle, no join but with the ranges' border values.
    """
    from keyfold.operators import rangescan, scan

    part, offset = order_cols
    parsed = raw.select(
        part, offset, "timestamp", F.get_json_object(F.col("value"), "$.publishTimestamp").alias("inputKafkaTimestamp")
    )
    filled = rangescan.range_carry(parsed, [part], "inputKafkaTimestamp", scan.choose_chunking(raw).ranges, (offset,))
    return filled.where("inputKafkaTimestamp IS NOT NULL").select(
        "inputKafkaTimestamp", F.col("timestamp").cast("long").alias("outputKafkaTimestamp")
    )
