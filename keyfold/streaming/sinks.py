"""Exactly-once batch sinks for streams: a commit log beside the data.

``foreachBatch`` may run a batch again after a crash.  ``committed_sink``
writes each try into a folder of its own and then, as one small file, a commit
that names the try.  A crash before the commit leaves a try that no commit
names; a crash after it (but before Spark's own checkpoint of the batch) lets
the batch run again, and the sink sees the commit and leaves it.
``read_committed`` reads the tries that commits name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SinkCrash(RuntimeError):
    """An injected failure."""


def crash_at(where: str, batch: int) -> Callable[[str, int], None]:
    """A fault that stops the stream at one point of one batch: "written"
    (before the commit) or "committed" (before the checkpoint)."""

    def fault(point: str, batch_id: int) -> None:
        if (point, batch_id) == (where, batch):
            raise SinkCrash(f"{where} {batch}")

    return fault


def committed_sink(path: str, encode: Callable[[DataFrame], DataFrame], fault: Callable[[str, int], None] | None = None):
    """A ``foreachBatch`` function that writes ``encode(batch)`` exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sc = spark.sparkContext
        commit = f"{path}/commits/batch={batch_id}"
        done = sc._jvm.org.apache.hadoop.fs.Path(f"{commit}/_SUCCESS")
        if done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
            # the stateful stages must still run, so that their stores commit
            batch.write.format("noop").mode("overwrite").save()
            return
        attempt = uuid.uuid4().hex
        encode(batch).write.parquet(f"{path}/data/batch={batch_id}/attempt={attempt}")
        if fault:
            fault("written", batch_id)
        spark.range(1).select(F.lit(attempt).alias("attempt")).write.mode("overwrite").parquet(commit)
        if fault:
            fault("committed", batch_id)

    return write


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches."""
    commits = spark.read.parquet(f"{path}/commits").select("batch", "attempt")
    return spark.read.parquet(f"{path}/data").join(commits, ["batch", "attempt"], "left_semi").drop("batch", "attempt")
