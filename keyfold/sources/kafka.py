"""Kafka sources and sinks.

One thin factory: the options are Spark's own Kafka connector options.
The connector jar is not part of this environment, so this path is not run
by the tests here (the file-source path exercises the same decode and
pipeline code).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import codecs

# Topic names of the reference deployment.
ADD_TO_CART_TOPIC = "add-to-cart"
CHECKOUT_TOPIC = "checkout"
RESTOCK_TOPIC = "restock"
CONFIRM_TOPIC = "add-confirm"


def stream_options(
    bootstrap: str,
    topics: list[str],
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """The options of a stream over ``topics``: T10 start position, S13 rate
    bound; ``min_partitions`` splits large offset ranges, so a topic partition
    that holds a third of the records is read by many tasks."""
    given = {
        "kafka.bootstrap.servers": bootstrap, "subscribe": ",".join(topics), "startingOffsets": starting_offsets,
        "maxOffsetsPerTrigger": max_offsets_per_trigger, "minPartitions": min_partitions,
    }
    return {k: str(v) for k, v in given.items() if v}


def batch_options(
    bootstrap: str, topic: str, committed_only: bool = True, min_partitions: int | None = None
) -> dict[str, str]:
    """The options of a scan from the earliest offset (S6), of committed records only."""
    options = stream_options(bootstrap, [topic], "earliest", None, min_partitions)
    return options | ({"kafka.isolation.level": "read_committed"} if committed_only else {})


def read_stream(spark: SparkSession, *args, **kwargs) -> DataFrame:
    """Raw records as a stream; arguments as ``stream_options``."""
    from keyfold.streaming.pipeline import stream_session

    return stream_session(spark).readStream.format("kafka").options(**stream_options(*args, **kwargs)).load()


def read_batch(spark: SparkSession, *args, **kwargs) -> DataFrame:
    """A topic as a table; arguments as ``batch_options``."""
    return spark.read.format("kafka").options(**batch_options(*args, **kwargs)).load()


def records_to_lines(records: DataFrame) -> DataFrame:
    """P30 + P4/R10: bytes to text; the broker time replaces the event time."""
    return records.select(
        F.col("topic"),
        F.col("partition"),
        F.col("offset"),
        codecs.bytes_to_text("key").alias("key"),
        codecs.bytes_to_text("value").alias("body"),
        F.unix_millis(F.col("timestamp")).alias("broker_ms"),
    )


def records_to_routed(records: DataFrame) -> DataFrame:
    """Kafka records in the shape ``routing.decode`` takes: the topic is the
    record's own; ``value`` keeps the raw ``key=body`` text for the reject side."""
    lines = records_to_lines(records)
    return lines.withColumn("value", codecs.key_line(F.col("key"), F.col("body")))


def write_stream(df: DataFrame, bootstrap: str, topic: str, key_col: str, value_col: str, checkpoint: str):
    """Key and JSON value to a topic (at-least-once; pair with an
    idempotent consumer, or use ``keyfold.streaming.sinks.committed_sink``)."""
    return (
        df.select(codecs.key_bytes(key_col).alias("key"), F.encode(F.col(value_col), "UTF-8").alias("value"))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
