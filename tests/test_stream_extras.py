from pyspark.sql import functions as F

from conftest import SF001
from keyfold.operators import reserve
from keyfold.plans import params as P
from keyfold.session import shared_path
from keyfold.sources import testdata as td
from keyfold.streaming import extras
from keyfold.streaming.replay import replay_events


def test_harness_latest_message_with_poison_quarantined(spark):
    base = shared_path(spark, "t-harness")
    out = extras.harness(extras.generated_messages(spark, 40, crash_at=17))
    listener = extras.ProgressListener(10)
    out.sparkSession.streams.addListener(listener)
    try:
        q = (out.writeStream.format("parquet").option("path", base + "/out")
             .option("checkpointLocation", base + "/ck").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        out.sparkSession.streams.removeListener(listener)
    got = spark.read.parquet(base + "/out")
    n = got.agg(F.sum("n_messages")).first()[0]
    batches = q.lastProgress["batchId"] + 1 if q.lastProgress else 1
    assert n == 40 * batches - 1  # the empty (poison) message is split off
    assert got.where(F.length("latest_message") != 250).count() == 0


def test_state_readback_equals_batch_final_stock(spark):
    base = shared_path(spark, "t-state")
    replay_events(spark, SF001, P.UNIT, waves=2, base=base)
    st = extras.read_state(spark, base + "/checkpoint", "stock")
    got = {r.key.item_id: r.value.stock for r in st.collect()}
    d = td.domain_events(td.table(spark, SF001, "events"), P.UNIT.restock_qty, ("add", "restock"))
    want = {r.item_id: r.final_stock for r in reserve.item_outcomes(reserve.reserve(d, P.UNIT)).collect()}
    assert got == want
    # the state at the first wave's batch differs (fewer events settled)
    first = extras.read_state(spark, base + "/checkpoint", "stock", batch_id=0)
    assert first.count() <= len(got)


def test_live_buckets(spark):
    base = shared_path(spark, "t-live")
    rows = [(0, str(1_000 + i * 100), 1_000 + i * 100 + 5) for i in range(40)] + [(0, "100000", 100005)]
    spark.createDataFrame(rows, "run long, inputKafkaTimestamp string, outputKafkaTimestamp long") \
        .coalesce(1).write.json(base + "/in")
    src = spark.readStream.schema("run long, inputKafkaTimestamp string, outputKafkaTimestamp long").json(base + "/in")
    q = (extras.live_buckets(src, "1 second", "0 seconds").writeStream.format("parquet")
         .option("path", base + "/out").option("checkpointLocation", base + "/ck")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.bucket_start.timestamp(): r.n_events for r in spark.read.parquet(base + "/out").collect()}
    # the row at 100 s closes every earlier window: 1.0-1.9, 2.0-2.9, ...
    assert got == {1.0: 10, 2.0: 10, 3.0: 10, 4.0: 10}


def test_live_gap_filled_lets_go_empty_buckets_as_time_passes(spark):
    from keyfold.streaming.pipeline import run_available, stream_session

    base = shared_path(spark, "t-spine")
    schema = "run long, inputKafkaTimestamp string, outputKafkaTimestamp long"
    session = stream_session(spark, 2)
    bases = [(0, 10_500), (1, 9_000)]  # run 0 begins within the bucket grid, run 9 is not listed

    def wave(times):
        rows = [(run, str(t - 1), t) for run, t in times]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")
        stream = session.readStream.schema(schema).parquet(base + "/in")
        out = extras.live_gap_filled(stream, session.createDataFrame(bases, "run long, base long"), 1_000, "1 second")
        run_available(out, base + "/out", base + "/ck")
        return sorted(tuple(r) for r in spark.read.parquet(base + "/out").collect())

    got = wave([(0, 10_500), (0, 11_499), (0, 13_500), (1, 9_999), (1, 12_000), (9, 16_000)])
    # watermark 15 s (of moved times): windows up to it are closed, empty ones too
    assert got == [(0, 0, 2), (0, 1, 0), (0, 2, 0), (0, 3, 1), (0, 4, 0), (1, 0, 1), (1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 0), (1, 5, 0)]
    more = wave([(1, 17_100), (9, 20_000)])
    assert [r for r in more if r in got] == got  # what was let go stays as it was
    assert [r for r in more if r not in got] == [(0, b, 0) for b in range(5, 9)] + [(1, 6, 0), (1, 7, 0), (1, 8, 1), (1, 9, 0)]


def test_progress_listener_marks(spark):
    import time

    base = shared_path(spark, "t-progress")
    listener = extras.ProgressListener(25)
    src = extras.generated_messages(spark, 60)
    src.sparkSession.streams.addListener(listener)  # listeners belong to the stream's session
    try:
        q = (src.writeStream.format("parquet").option("path", base + "/out")
             .option("checkpointLocation", base + "/ck").trigger(availableNow=True).start())
        q.awaitTermination()
        n = spark.read.parquet(base + "/out").count()
        for _ in range(50):  # listener events arrive asynchronously
            if listener.total >= n:
                break
            time.sleep(0.2)
    finally:
        src.sparkSession.streams.removeListener(listener)
    assert listener.total == n
    assert listener.marks == [k * 25 for k in range(1, n // 25 + 1)]
