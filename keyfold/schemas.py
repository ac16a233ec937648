"""Declared schemas (never inferred) for logs."""

from pyspark.sql import types as T

LATENCY_LOG = T.StructType(
    [T.StructField("inputKafkaTimestamp", T.StringType()), T.StructField("outputKafkaTimestamp", T.LongType())]
)
