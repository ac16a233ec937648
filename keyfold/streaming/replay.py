"""Ordered replay of driver events through the streaming pipeline.

The events are written under a shared folder in ``waves`` of equal time spans,
each as files of bounded size in event order; the stream takes a bounded number
of files a micro-batch (S13) until the wave is processed, and with more than one
wave a fresh query object resumes from the checkpoint for the next -- the stop /
restart of the reference's crash test.  All paths sit under
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import codecs
from keyfold.functions.timefns import epoch_ms
from keyfold.operators import routing
from keyfold.profiles import Profile
from keyfold.session import shared_path
from keyfold.sources import eventlog
from keyfold.sources import testdata as td
from keyfold.streaming import pipeline

RECEIPT_COLS = ("user_id", "event_id", "n_items", "receipt", "publishTimestamp")


def time_waves(domain: DataFrame, waves: int, ts_ms: str = "ts_ms") -> list[DataFrame]:
    """``domain`` cut into ``waves`` consecutive spans of its own time range,
    each row in exactly one."""
    if waves == 1:
        return [domain]
    low, high = domain.agg(F.min(ts_ms), F.max(ts_ms)).first()
    if low is None:
        return [domain]
    cuts = [low + (high - low + 1) * i // waves for i in range(1, waves)]
    wave = F.lit(0)
    for c in cuts:
        wave = wave + (F.col(ts_ms) >= c).cast("int")
    return [domain.where(wave == i) for i in range(waves)]


def _events(spark: SparkSession, sf_dir: str, profile: Profile, domain: DataFrame | None = None):
    """The rows to replay, with ts, event_id and ts_ms, and what derives the
    domain events from them (``pipeline.write_in_order``)."""
    if domain is not None:
        return domain, None
    raw = td.of_kinds(td.table(spark, sf_dir, "events")).withColumn("ts_ms", epoch_ms("ts"))
    return raw, lambda df: td.domain_events(df, profile.restock_qty)


def replay_events(
    spark: SparkSession, sf_dir: str, profile: Profile, waves: int = 1, base: str | None = None, build=None,
    domain: DataFrame | None = None, rows_per_file: int | None = None, sink=None, after_wave=None,
) -> DataFrame | None:
    """Run the chain over the events table (or ``domain``) in ordered waves.

    Returns the sink contents (confirms and receipts) as a batch DataFrame;
    source, sink and checkpoint live under ``base`` (a fresh shared folder
    by default).  ``sink``: a ``foreachBatch`` function in the file sink's
    place.  ``after_wave(wave)`` is called when a wave is processed.
    ``rows_per_file``: files of so many rows, one a micro-batch (by default
    ``file_source`` sets the bound).
    """
    base = base or shared_path(spark, "replay")
    src, ckpt = f"{base}/source", f"{base}/checkpoint"
    rows, derive = _events(spark, sf_dir, profile, domain)
    for wave, part in enumerate(time_waves(rows, waves)):
        pipeline.write_in_order(part, src, rows_per_file, derive)
        stream = pipeline.file_source(spark, src, 1 if rows_per_file else None)
        out = (build or pipeline.build_pipeline)(stream, profile)
        pipeline.run_available(out, sink or f"{base}/sink", ckpt)
        if after_wave:
            after_wave(wave)
    return None if sink else spark.read.parquet(f"{base}/sink")


def receipts_of(out: DataFrame) -> DataFrame:
    return out.where(F.col("kind") == "receipt").select(*RECEIPT_COLS)


def stream_receipts(
    spark: SparkSession, sf_dir: str, profile: Profile, waves: int = 1, domain: DataFrame | None = None
) -> DataFrame:
    return receipts_of(replay_events(spark, sf_dir, profile, waves, domain=domain))


def stream_receipt_lines(spark: SparkSession, sf_dir: str, profile: Profile, waves: int = 1) -> DataFrame:
    """T4/P12 streamed: per-item receipts from a map-state basket."""
    return replay_events(spark, sf_dir, profile, waves, build=pipeline.build_item_receipts)


def stream_receipts_out_of_order(
    spark: SparkSession, sf_dir: str, profile: Profile, domain: DataFrame | None = None
) -> DataFrame:
    """Ordered mode over out-of-order arrival: the later half of the time span
    arrives first, then the earlier half, then one tick beyond both that moves
    the watermark past everything.  The lateness bound is the data's own span
    and a day, so nothing is late and the receipts equal the batch result."""
    base = shared_path(spark, "replay-ordered")
    src, sink, ckpt = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    rows, derive = _events(spark, sf_dir, profile, domain)
    low, high = rows.agg(F.min(epoch_ms("ts")), F.max(epoch_ms("ts"))).first()
    if low is None:
        return spark.createDataFrame([], "user_id long, event_id long, n_items long, receipt string, publishTimestamp string")
    day = 86_400_000
    days = (high - low) // day + 2
    at = high + (days + 2) * day
    tick = spark.createDataFrame(
        [(-1, dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=at), at, "tick", None, None, None)],
        "event_id long, ts timestamp_ntz, ts_ms long, kind string, user_id long, item_id long, quantity int",
    )
    for part, of in [*((w, derive) for w in reversed(time_waves(rows, 2))), (tick, None)]:
        pipeline.write_in_order(part, src, derive=of)
        out = pipeline.build_ordered_pipeline(pipeline.file_source(spark, src), profile, f"{days} days", day, spread=2)
        pipeline.run_available(out, sink, ckpt)
    return receipts_of(spark.read.parquet(sink))


# -------------------------------------------------------- streams of log text


def log_stream(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Log records (text line, offset, broker time) to domain
    events: route, decode, and drop what does not decode.  ``strict`` fails on
    a poison record, as the reference does the first time.  Returns adds and
    restocks, and checkouts: a record goes by its topic before it is decoded, so
    the chain's two ways in decode it once."""
    src = pipeline.file_source(spark, path, schema="event_id long, ts timestamp_ntz, ts_ms long, value string")
    routed, topic = routing.route(src), F.col("topic")
    return tuple(_decoded(routed.where(of), strict) for of in (topic != "checkout", topic == "checkout"))


def _decoded(routed: DataFrame, strict: bool) -> DataFrame:
    decoded = routing.decode(routed)
    if strict:
        decoded = routing.strict(decoded)
    topic = F.col("topic")
    kind = F.when(topic == "add-to-cart", "add").when(topic == "checkout", "checkout").otherwise("restock")
    return decoded.where("decoded").select(
        "event_id", "ts", "ts_ms", kind.alias("kind"),
        F.col("userId").try_cast("long").alias("user_id"), F.col("itemId").try_cast("long").alias("item_id"),
        F.when(kind != "checkout", F.col("quantity")).cast("int").alias("quantity"),
    )


def _log_rows(lines: DataFrame) -> DataFrame:
    return lines.select("event_id", "ts", epoch_ms("ts").alias("ts_ms"), "value")


def stream_receipts_from_log(spark: SparkSession, sf_dir: str, profile: Profile) -> DataFrame:
    """The whole chain in one stream: text lines to receipts."""
    base = shared_path(spark, "replay-log")
    pipeline.write_in_order(td.table(spark, sf_dir, "events"), f"{base}/source",
                            derive=lambda df: _log_rows(eventlog.lines_from_events(df, profile.restock_qty)))
    stock, checkouts = log_stream(spark, f"{base}/source")
    out = pipeline.build_pipeline(stock, profile, checkouts=checkouts)
    pipeline.run_available(out, f"{base}/sink", f"{base}/checkpoint")
    return receipts_of(spark.read.parquet(f"{base}/sink"))


def stream_crash_resume(spark: SparkSession, sf_dir: str, profile: Profile, fail_period: int) -> DataFrame:
    """The log holds one poison record.  The first run fails inside
    the micro-batch that reads it; the second, on the same checkpoint, takes
    the batch again and processes the record.  State and sink show no trace of
    the failed attempt."""
    base = shared_path(spark, "replay-crash")
    lines = eventlog.lines_from_events(td.table(spark, sf_dir, "events"), profile.restock_qty)
    lines = eventlog.inject_poison_first_add(lines, fail_period)
    early = F.col("period") < fail_period
    has_poison = not lines.where((F.col("period") == fail_period) & (F.col("kind") == "add")).isEmpty()

    def run(strict: bool) -> None:
        stock, checkouts = log_stream(spark, f"{base}/source", strict)
        out = pipeline.build_pipeline(stock, profile, checkouts=checkouts)
        pipeline.run_available(out, f"{base}/sink", f"{base}/checkpoint")

    pipeline.write_in_order(_log_rows(lines.where(early)), f"{base}/source")
    run(strict=True)
    pipeline.write_in_order(_log_rows(lines.where(~early)), f"{base}/source")
    try:
        run(strict=True)
        crashed = False
    except StreamingQueryException:
        crashed = True
    if crashed != has_poison:
        raise RuntimeError("the poison record did not stop the stream" if has_poison else "the stream failed by itself")
    if crashed:
        run(strict=False)
    return receipts_of(spark.read.parquet(f"{base}/sink"))


def state_final_stock(spark: SparkSession, sf_dir: str, profile: Profile) -> DataFrame:
    """The final stock per item, read from the stream's state."""
    from keyfold.streaming.extras import read_state

    base = shared_path(spark, "replay-state")
    replay_events(spark, sf_dir, profile, base=base)
    st = read_state(spark, f"{base}/checkpoint", "stock")
    return st.select(F.col("key.item_id").alias("item_id"), F.col("value.stock").alias("final_stock"))


def last_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that a stream's checkpoint has committed."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    names = (f.getPath().getName() for f in folder.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(folder))
    return max(int(n) for n in names if n.isdigit())


def state_by_wave(spark: SparkSession, sf_dir: str, profile: Profile, waves: int) -> DataFrame:
    """The stock per item as the state had it after each wave: the epoch
    is the wave's last batch, read back when all waves are done."""
    from keyfold.streaming.extras import read_state

    base, epochs = shared_path(spark, "replay-epochs"), []
    replay_events(spark, sf_dir, profile, waves, base=base,
                  after_wave=lambda wave: epochs.append((wave, last_batch(spark, f"{base}/checkpoint"))))
    out = None
    for wave, batch in epochs:
        st = read_state(spark, f"{base}/checkpoint", "stock", batch_id=batch)
        st = st.select(F.lit(wave).alias("wave"), F.col("key.item_id").alias("item_id"), F.col("value.stock").alias("stock"))
        out = st if out is None else out.unionByName(st)
    return out


def stream_topic_records(spark: SparkSession, sf_dir: str, profile: Profile, n_filler: int, crash: bool = True) -> DataFrame:
    """Confirmations and receipts leave the stream as topic
    records through the commit log.  The first run crashes between a batch's
    write and its commit, the second between the commit and the checkpoint; the
    third finds each batch once."""
    from keyfold.streaming import sinks

    base = shared_path(spark, "replay-topics")
    rows, derive = _events(spark, sf_dir, profile)
    pipeline.write_in_order(rows, f"{base}/source", derive=derive)
    for fault in [sinks.crash_at("written", 0), sinks.crash_at("committed", 0), None] if crash else [None]:
        out = pipeline.build_pipeline(pipeline.file_source(spark, f"{base}/source"), profile, n_filler)
        sink = sinks.committed_sink(f"{base}/topics", lambda df: pipeline.to_topic_records(df, profile), fault)
        try:
            pipeline.run_available(out, sink, f"{base}/checkpoint")
        except StreamingQueryException:
            if fault is None:
                raise
    return sinks.read_committed(spark, f"{base}/topics")


def stream_latency_log(spark: SparkSession, sf_dir: str, profile: Profile) -> DataFrame:
    """Each confirmation leaves the stream as a latency record, stamped
    with the time of its micro-batch, into a log of JSON lines; returns the log
    as the evaluator reads it."""
    from keyfold.sources import latencylog

    base = shared_path(spark, "replay-latency")
    rows, derive = _events(spark, sf_dir, profile)
    pipeline.write_in_order(rows, f"{base}/source", derive=derive)
    out = pipeline.build_pipeline(pipeline.file_source(spark, f"{base}/source"), profile)
    confirms = out.where(F.col("kind") == "confirm")
    log = latencylog.from_confirms(confirms, F.unix_millis(F.current_timestamp()))
    pipeline.run_available(log, f"{base}/log", f"{base}/checkpoint", fmt="json")
    return latencylog.read_json(spark, f"{base}/log")


#: The declared fields of each message type.
MESSAGE_FIELDS = {
    "add-to-cart": {"userId": "string", "itemId": "string", "quantity": "int", "publishTimestamp": "string"},
    "checkout": {"userId": "string", "publishTimestamp": "string"},
    "restock-item": {"itemId": "string", "quantity": "int", "publishTimestamp": "string"},
}


def stream_envelope(spark: SparkSession, sf_dir: str, profile: Profile) -> DataFrame:
    """Every event packed into an envelope of its type; one stream of
    them, from which each type's function takes its own fields."""
    base = shared_path(spark, "replay-envelope")
    domain = td.domain_events(td.table(spark, sf_dir, "events"), profile.restock_qty)
    name = F.when(F.col("kind") == "add", "add-to-cart").when(F.col("kind") == "checkout", "checkout").otherwise("restock-item")
    message = F.struct(
        F.col("user_id").cast("string").alias("userId"), F.col("item_id").cast("string").alias("itemId"), "quantity",
        F.col("ts_ms").cast("string").alias("publishTimestamp"),
    )
    packed = domain.select("event_id", "ts", codecs.typed_envelope(name, message).alias("e"))
    pipeline.write_in_order(packed.select("event_id", "ts", "e.typename", "e.payload"), f"{base}/source")
    stream = pipeline.file_source(spark, f"{base}/source", schema="event_id long, ts timestamp_ntz, typename string, payload variant")
    out = None
    for typename, fields in MESSAGE_FIELDS.items():
        own = stream.where(F.col("typename") == typename)
        own = own.select("event_id", "typename", *codecs.open_envelope("payload", fields))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    pipeline.run_available(out, f"{base}/sink", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sink")
