"""Streaming extras: live buckets (T11), state inspection (T12), generated
messages and the harness function (S15, S16, A18, F4, F5), progress (F13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from keyfold.functions import synth
from keyfold.session import ship_package
from keyfold.streaming.pipeline import after_watermark, in_order, stream_session
from keyfold.streaming.processors import LatestMessageProcessor, SpineProcessor


def live_buckets(log_stream: DataFrame, width: str, watermark: str) -> DataFrame:
    """Per-run event count and mean latency in tumbling event-time windows.

    ``watermark``, the lateness up to which rows count, lets append mode close
    a window (rows later than that are dropped, so the caller names it); Spark refuses NTZ for watermarks, so the input time
    is cast to a timestamp.
    """
    t = F.timestamp_millis(F.col("inputKafkaTimestamp").try_cast("long"))
    lat = F.col("outputKafkaTimestamp") - F.col("inputKafkaTimestamp").try_cast("long")
    return (
        log_stream.withColumn("event_time", t)
        .withColumn("latency", lat)
        .withWatermark("event_time", watermark)
        .groupBy("run", F.window("event_time", width).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.avg("latency").alias("mean_latency"))
        .select("run", F.col("bucket.start").alias("bucket_start"), "n_events", "mean_latency")
    )


#: Rank error of the sketches at their default size (99 % of cases), as a share of the rows.
KLL_RANK_ERROR = 0.0133


def live_percentiles(log_stream: DataFrame, width: str, watermark: str) -> DataFrame:
    """Per-run median and 99th percentile of latency in tumbling
    event-time windows.  The state holds one mergeable KLL sketch a window: its
    size does not grow with the rows, and a percentile's rank is off by at most
    about ``KLL_RANK_ERROR``.  ``watermark`` as in ``live_buckets``."""
    t = F.timestamp_millis(F.col("inputKafkaTimestamp").try_cast("long"))
    lat = F.col("outputKafkaTimestamp") - F.col("inputKafkaTimestamp").try_cast("long")
    sketches = (
        log_stream.withColumn("event_time", t).withColumn("latency", lat).withWatermark("event_time", watermark)
        .groupBy("run", F.window("event_time", width).alias("bucket"))
        .agg(F.count("latency").alias("n_events"), F.kll_sketch_agg_bigint("latency").alias("sketch"))
    )
    return sketches.select(
        "run", F.col("bucket.start").alias("bucket_start"), "n_events",
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5)).alias("p50"),
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.99)).alias("p99"),
    )


def live_gap_filled(log_stream: DataFrame, bases: DataFrame, bucket_ms: int, watermark: str) -> DataFrame:
    """Events per end bucket and run, with a row of 0 for every bucket
    that elapses without an event.

    ``bases`` (run, base: the time in ms at which the run's bucket 0 begins) is
    the run list, one row a run; runs that it lacks give no rows.  A run's times
    are moved back by its base's phase in the bucket grid, so that its buckets
    are Spark's own windows: events fold into window counts on the map side, and
    only counts of closed windows reach the run's processor.  ``watermark`` as in
    ``live_buckets``; it is taken over moved times, which are up to one bucket
    early, so name a bucket more than the lateness.  Rows run on until the
    watermark stops.
    """
    ship_package(log_stream.sparkSession)
    phase = F.pmod(F.col("base"), F.lit(bucket_ms))
    known = log_stream.join(F.broadcast(bases.select("run", "base")), "run", "left")
    moved = known.withColumn("start", F.coalesce(F.col("base") - phase, F.lit(0))).withColumn(
        "event_time", F.timestamp_millis(F.col("outputKafkaTimestamp") - F.coalesce(phase, F.lit(0)))
    )
    counts = (
        moved.withWatermark("event_time", watermark)
        .groupBy("run", "start", F.col("base").isNotNull().alias("listed"), F.window("event_time", f"{bucket_ms} milliseconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
    )
    closed = counts.select(
        "run", "start", "listed", F.expr(f"(unix_millis(w.start) - start) DIV {bucket_ms}").alias("bucket"), "n_events", F.window_time("w").alias("closed")
    )
    # pushed below the watermark, the filter would keep unlisted rows from it
    return closed.where(after_watermark(F.col("listed"), "closed")).drop("listed").groupBy("run", "start").transformWithStateInPandas(
        statefulProcessor=SpineProcessor(bucket_ms),
        outputStructType="run long, end_bucket long, n_events long",
        outputMode="Append",
        timeMode="EventTime",
    )


def find_operator(spark: SparkSession, checkpoint: str, state_var: str) -> int:
    """The id of the stateful operator that declares ``state_var`` (from the
    checkpoint's state metadata: one row per operator)."""
    import json

    for r in spark.read.format("state-metadata").load(checkpoint).collect():
        props = json.loads(r.operatorProperties or "{}")
        if any(v.get("stateName") == state_var for v in props.get("stateVariables", [])):
            return int(r.operatorId)
    raise KeyError(state_var)


def read_state(spark: SparkSession, checkpoint: str, state_var: str, operator_id: int | None = None,
               batch_id: int | None = None) -> DataFrame:
    """Read a stateful operator's state at the latest (or a given) batch."""
    if operator_id is None:
        operator_id = find_operator(spark, checkpoint, state_var)
    r = (
        spark.read.format("statestore")
        .option("path", checkpoint)
        .option("operatorId", operator_id)
        .option("stateVarName", state_var)
    )
    if batch_id is not None:
        r = r.option("batchId", batch_id)
    return r.load()


def generated_messages(spark: SparkSession, rows_per_batch: int, crash_at: int | None = None) -> DataFrame:
    """The harness's generated messages as a deterministic stream.

    ``rate-micro-batch`` gives ``rows_per_batch`` rows per batch with a
    sequence number; user id (20 chars) and message (250 chars) are pure
    functions of it.  Row ``crash_at`` carries the empty (poison) message.
    """
    src = stream_session(spark).readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()
    seq = F.col("value")
    msg = synth.id_string(seq, 250)
    if crash_at is not None:
        msg = F.when(seq == crash_at, F.lit("")).otherwise(msg)
    return src.select(
        seq.alias("event_id"),
        F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        synth.id_string(seq * 7 + 3, 20).alias("user_id"),
        msg.alias("message"),
    )


LATEST_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("latest_message", T.StringType()),
        T.StructField("n_messages", T.LongType()),
    ]
)


def harness(messages: DataFrame, quarantine_poison: bool = True) -> DataFrame:
    """Harness function: latest message per user in keyed state.

    With ``quarantine_poison`` an empty message (F4) is filtered out before
    the stateful stage instead of crashing it (the reference crashes once).
    """
    ship_package(messages.sparkSession)
    m = messages.where(F.col("message") != "") if quarantine_poison else messages
    return in_order(m, "user_id").groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=LatestMessageProcessor(),
        outputStructType=LATEST_SCHEMA,
        outputMode="Append",
        timeMode="None",
    )


class ProgressListener(StreamingQueryListener):
    """report every n-th processed record, as the reference's producer
    and consumer print progress; keeps the counts for inspection."""

    def __init__(self, every: int):
        self.every = int(every)
        self.total = 0
        self.marks: list[int] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        before = self.total
        self.total += int(event.progress.numInputRows)
        for k in range(before // self.every + 1, self.total // self.every + 1):
            self.marks.append(k * self.every)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
