"""Streaming order pipeline.

``build_pipeline(domain_stream, profile)`` wires source -> stage 1 (stock,
keyed by item) -> stage 2 (cart, keyed by shard of users,
a state entry per user) -> output.  Sources and
sinks are plain DataFrame readers / writers chosen by the caller:

* file sources (``file_source``) for tests and backfill, Kafka
  (``keyfold.sources.kafka``) in production;
* the file sink is exactly-once through its metadata log; ``sinks`` gives the
  same guarantee to a ``foreachBatch`` sink through a commit log.

Ordering: each processor gets its key's rows of a micro-batch in
``(ts, event_id)`` order (``in_order``); across batches, files (or Kafka
offsets) must arrive in event order.  ``write_in_order`` writes files that do,
and ``file_source`` takes a bounded number of them per batch (S13).

A stream runs in a session of its own (``stream_session``), so that its state
partitions and state store are no setting of any other query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from keyfold.functions.timefns import epoch_ms
from keyfold.operators.reserve import stock_rows
from keyfold.profiles import Profile
from keyfold.session import ship_package, use_rocksdb_state
from keyfold.streaming.processors import (
    OUTPUT_SCHEMA,
    DOMAIN_SCHEMA,
    ITEM_RECEIPT_SCHEMA,
    SETTLED_SCHEMA,
    CartItemsProcessor,
    CartProcessor,
    Packed,
    ReorderProcessor,
    StockProcessor,
    arrow_schema,
    pack,
    unpack,
)

#: Most rows of a replayed file (S13).  A micro-batch takes a file a core; its
#: fixed part is some 3 s, and a task sorts its rows on disk and folds them by chunk.
ROWS_PER_FILE = 400_000
#: Below these rows a file is not made smaller to give every core one.
LEAST_ROWS = 100_000
#: The users are dealt over so many keys of stage 2.  Fixed in a checkpoint.  A
#: call costs some 10 ms, and a shard's open baskets are one value of the state:
#: raise it for more than 256 cores or some 5 M users.
USER_SHARDS = 256
#: Bytes of an Arrow batch that goes to a Python worker of a stream.
BATCH_BYTES = 16 << 20


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for one stream on the same cluster: RocksDB state, its own
    number of state partitions (fixed in the checkpoint by the first run;
    default: the cluster's default parallelism), and leave to sort the rows of
    a micro-batch within their partitions, which the plan check for streams
    does not tell from a sort of the whole stream.  Listeners are added to the
    stream's session too: ``stream.sparkSession.streams``."""
    s = spark.newSession()
    use_rocksdb_state(s)
    for key in ("spark.sql.session.timeZone", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        s.conf.set(key, spark.conf.get(key))
    s.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    s.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    s.conf.set("spark.sql.streaming.unsupportedOperationCheck", "false")
    return s


def file_source(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, schema: str | T.StructType = DOMAIN_SCHEMA
) -> DataFrame:
    """Events from parquet files as a stream of its own session (S1-S3
    stand-in), at most ``files_per_trigger`` files a micro-batch (S13; default:
    the cluster's default parallelism).  A batch costs its fixed part and a
    handler call per key that occurs in it, so the bound grows with the cluster:
    by a file of a few rows per key, the calls would outweigh the rows."""
    r = stream_session(spark).readStream.schema(schema)
    return r.option("maxFilesPerTrigger", files_per_trigger or spark.sparkContext.defaultParallelism).parquet(path)


def write_in_order(df: DataFrame, path: str, rows_per_file: int | None = None, derive=None) -> int:
    """Append ``df`` to ``path`` as files of about ``rows_per_file`` rows that
    the file source takes in (ts, event_id) order; returns their number.
    Default: ``ROWS_PER_FILE`` at most, and as many files as fill the last
    micro-batch's cores, if they then have ``LEAST_ROWS``.
    ``derive`` makes the written columns from those of ``df``, row by row: the
    passes that count and sample the rows then do without it.

    One job writes them, cut by range; the source goes by modification time, so
    the files' times are then set in range order, each a millisecond after the
    one before.  The folder must be on a file system that can set times."""
    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())

    def files() -> dict[str, tuple]:
        if not fs.exists(folder):
            return {}
        found = ((f.getPath(), f.getModificationTime()) for f in fs.listStatus(folder))
        return {p.getName(): (p, t) for p, t in found if p.getName().startswith("part-")}

    old = files()
    rows = df.count()
    n = max(1, -(-rows // (rows_per_file or ROWS_PER_FILE)))
    if not rows_per_file:
        n = max(n, min(-(-n // sc.defaultParallelism) * sc.defaultParallelism, rows // LEAST_ROWS))
    ranged = df.repartitionByRange(n, "ts", "event_id")
    (derive(ranged) if derive else ranged).sortWithinPartitions("ts", "event_id").write.mode("append").parquet(path)
    now = files()
    new = sorted(now.keys() - old.keys())
    last = max((t for _, t in now.values()), default=0)
    for i, name in enumerate(new, 1):
        fs.setTimes(now[name][0], last + i, -1)
    return len(new)


def in_order(rows: DataFrame, key: str, *within: str) -> DataFrame:
    """The rows of each micro-batch dealt by ``key`` and, in each partition, in
    (key, ``within``, ts, event_id) order: the order in which a processor gets
    them."""
    return rows.repartition(key).sortWithinPartitions(key, *within, "ts", "event_id")


def fold(rows: DataFrame, key: str, processor: StatefulProcessor, output: T.StructType, *within: str) -> DataFrame:
    """``processor`` over the rows of each key in order (``in_order``).  Rows go
    to it and come from it packed, an Arrow message for the rows of a key in an
    Arrow batch: a row that went alone would be walked in Python several times."""
    ship_package(rows.sparkSession)
    given, made = arrow_schema(rows.schema), arrow_schema(output)
    messages = T.StructType([rows.schema[key], T.StructField("seq", T.LongType()), T.StructField("rows", T.BinaryType())])
    packed = in_order(rows, key, *within).mapInArrow(pack(key, given), messages)
    # a key's messages come from one task, which numbered them
    folded = packed.repartition(key).sortWithinPartitions(key, "seq").groupBy(key).transformWithStateInPandas(
        statefulProcessor=Packed(processor, given, made), outputStructType="rows binary", outputMode="Append", timeMode="None"
    )
    return folded.mapInArrow(unpack(made), output)


def settle_stream(domain: DataFrame, profile: Profile) -> DataFrame:
    """Stage 1 (T1, T2, T6): stock per item."""
    processor = StockProcessor(profile.initial_stock, profile.restock_applies)
    return fold(stock_rows(domain, profile), "item_id", processor, SETTLED_SCHEMA)


def _cart_input(domain: DataFrame, profile: Profile, checkouts: DataFrame | None = None) -> DataFrame:
    settled = settle_stream(domain, profile).where(F.col("kind") == "add").select(
        "event_id", "ts", "ts_ms", "kind", "user_id", "item_id", "requested", "status"
    )
    checkouts = (domain if checkouts is None else checkouts).where(F.col("kind") == "checkout").select(
        "event_id", "ts", "ts_ms", "kind", "user_id",
        F.lit(None).cast("long").alias("item_id"),
        F.lit(None).cast("int").alias("requested"),
        F.lit(None).cast("string").alias("status"),
    )
    rows = settled.unionByName(checkouts).where(F.col("user_id").isNotNull())
    return rows.withColumn("shard", F.pmod(F.xxhash64("user_id"), F.lit(USER_SHARDS)).cast("int"))


def _cart_stream(rows: DataFrame, processor: StatefulProcessor, output: T.StructType) -> DataFrame:
    """Stage 2: the carts of each shard of users."""
    return fold(rows, "shard", processor, output, "user_id")


def build_item_receipts(domain: DataFrame, profile: Profile) -> DataFrame:
    """The chain with a map-state basket; output = per-item receipts."""
    return _cart_stream(_cart_input(domain, profile), CartItemsProcessor(), ITEM_RECEIPT_SCHEMA)


def build_pipeline(
    domain: DataFrame, profile: Profile, n_filler: int = 0, checkouts: DataFrame | None = None
) -> DataFrame:
    """The whole chain; output rows are confirms and receipts (``kind``).
    ``checkouts``: their stream, if it is not part of ``domain``."""
    processor = CartProcessor(profile.checkout, profile.receipt_format, n_filler)
    return _cart_stream(_cart_input(domain, profile, checkouts), processor, OUTPUT_SCHEMA)


def run_available(out: DataFrame, sink, checkpoint: str, fmt: str = "parquet", trigger: dict | None = None) -> None:
    """Process everything available now, append it to a file sink (a path) or
    hand it to a ``foreachBatch`` function, and stop (T7, T8).

    Restarting with the same ``checkpoint`` resumes after the last committed
    batch: state and file sink are exactly-once.
    """
    w = out.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    w = w.foreachBatch(sink) if callable(sink) else w.format(fmt).option("path", sink)
    q = w.trigger(**(trigger or {"availableNow": True})).start()
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
    if q.exception() is not None:
        raise q.exception()


def console_sink(out: DataFrame, checkpoint: str):
    """Print sink (the harness's printing egress)."""
    return out.writeStream.format("console").option("checkpointLocation", checkpoint).outputMode("append")


def processing_trigger(writer, seconds: int = 10):
    """Micro-batch (and checkpoint) every ``seconds``."""
    return writer.trigger(processingTime=f"{seconds} seconds")


def to_topic_records(out: DataFrame, profile: Profile) -> DataFrame:
    """S4/S5 + P5/P6/R14: pipeline output as (topic, key, value) records.

    Confirms go to the profile's confirm topic as AddToCart JSON, receipts to
    its receipt topic as Receipt JSON (the topic differs per variant); the
    key is the user id as UTF-8 bytes; default-valued fields are omitted.
    Works on batch and streaming frames alike.
    """
    from keyfold.functions import codecs

    is_confirm = F.col("kind") == "confirm"
    value = F.when(
        is_confirm,
        codecs.encode_add_to_cart(F.col("user_id"), F.col("item_id"), F.col("quantity"), F.col("publishTimestamp")),
    ).otherwise(codecs.encode_receipt(F.col("user_id"), F.col("receipt"), F.col("publishTimestamp")))
    return out.select(
        F.when(is_confirm, F.lit(profile.confirm_topic)).otherwise(F.lit(profile.receipt_topic)).alias("topic"),
        codecs.key_bytes(F.col("user_id")).alias("key"),
        value.alias("value"),
    )


def after_watermark(pred, event_time: str = "event_time"):
    """A filter predicate the optimizer cannot push below ``withWatermark``.

    Conjuncts that do not use the event-time column are pushed under the
    watermark node, which then sees only the filtered rows (each branch its
    own watermark).  A CASE on the event-time column keeps the filter above
    it, so the watermark is taken over every source row.
    """
    return F.when(F.col(event_time).isNotNull(), pred).otherwise(F.lit(False))


def reorder(src: DataFrame, pred, bucket_ms: int, spread: int) -> DataFrame:
    """T4/O2: the rows of ``src`` (watermarked on ``event_time``) that satisfy
    ``pred``, let go bucket by bucket as the watermark passes: every row of a
    micro-batch is later than all rows of the batches before it.  A bucket is
    dealt over ``spread`` keys, so a burst at one time is not one task."""
    ship_package(src.sparkSession)
    keyed = src.where(after_watermark(pred)).select(
        F.floor(epoch_ms("ts") / bucket_ms).cast("long").alias("bucket"),
        F.pmod("event_id", F.lit(spread)).cast("int").alias("part"), *DOMAIN_SCHEMA.fieldNames(), "event_time")
    return keyed.groupBy("bucket", "part").transformWithStateInPandas(
        statefulProcessor=ReorderProcessor(bucket_ms),
        outputStructType=DOMAIN_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


def build_ordered_pipeline(
    domain: DataFrame, profile: Profile, lateness: str, bucket_ms: int = 3_600_000, spread: int = 4
) -> DataFrame:
    """The chain in event order under a watermark (opt-in; the reference is
    arrival-ordered).  Events may arrive out of order by up to ``lateness``;
    older ones, and rows without a time, are dropped.  Rows wait in buckets of
    ``bucket_ms`` until the watermark passes them (``reorder``); what is let go
    runs through the same chain as in arrival order."""
    # event time from the UTC epoch of the wall-clock ts: independent of the
    # session time zone, and the same clock that cuts the buckets
    src = domain.withColumn("event_time", F.timestamp_millis(epoch_ms("ts"))).withWatermark("event_time", lateness)
    stock = reorder(src, F.col("kind").isin("add", "restock") & F.col("item_id").isNotNull(), bucket_ms, spread)
    checkouts = reorder(src, (F.col("kind") == "checkout") & F.col("user_id").isNotNull(), bucket_ms, spread)
    return build_pipeline(stock, profile, checkouts=checkouts)
