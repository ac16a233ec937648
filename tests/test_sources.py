import datetime as dt

from keyfold.operators import routing
from keyfold.session import shared_path
from keyfold.sources import kafka, latencylog
from keyfold.streaming import pipeline


def test_forward_fill_failed_parse(spark):
    # A record that fails to parse re-uses the previous input time
    raw = spark.createDataFrame(
        [(0, 1, '{"publishTimestamp":"10"}', 15), (0, 2, "garbage", 20), (0, 3, '{"publishTimestamp":"30"}', 31),
         (1, 1, "garbage", 5)],
        "partition int, offset long, value string, timestamp long",
    )
    got = sorted((r.inputKafkaTimestamp, r.outputKafkaTimestamp) for r in latencylog.forward_fill_failed(raw).collect())
    assert got == [("10", 15), ("10", 20), ("30", 31)]  # a first-record failure has nothing to re-use


def test_kafka_records_decode_path(spark):
    # the Kafka record shape, without a broker: bytes -> text, broker time wins
    recs = spark.createDataFrame(
        [("add-to-cart", 0, 7, bytearray(b"u1"), bytearray(b'{"userId":"u1","itemId":"i","quantity":2}'),
          dt.datetime(2024, 1, 1, 0, 0, 1))],
        "topic string, partition int, offset long, key binary, value binary, timestamp timestamp",
    )
    lines = kafka.records_to_lines(recs)
    r = lines.first()
    assert (r.key, r.body, r.broker_ms % 1000) == ("u1", '{"userId":"u1","itemId":"i","quantity":2}', 0)
    dec = routing.decode(kafka.records_to_routed(recs)).first()
    assert dec.quantity == 2 and dec.decoded and dec.topic == "add-to-cart"


def test_committed_sink_keeps_each_batch_once(spark):
    from keyfold.session import shared_path
    from keyfold.streaming import sinks

    path = shared_path(spark, "t-sink")
    for where, rows in (("written", 3), ("committed", 4), (None, 5)):
        fault = sinks.crash_at(where, 0) if where else None
        write = sinks.committed_sink(path, lambda df: df.withColumnRenamed("id", "x"), fault)
        try:
            write(spark.range(rows), 0)
            assert where is None
        except sinks.SinkCrash:
            assert where
    sinks.committed_sink(path, lambda df: df.withColumnRenamed("id", "x"))(spark.range(10, 12), 1)
    # the try of 3 rows has no commit; the try of 4 has, so the one of 5 is left
    assert sorted(r.x for r in sinks.read_committed(spark, path).collect()) == [0, 1, 2, 3, 10, 11]


def test_kafka_options_without_a_broker():
    from keyfold.sources import kafka

    assert kafka.stream_options("b:9092", ["x", "y"], "earliest", 500, 32) == {
        "kafka.bootstrap.servers": "b:9092", "subscribe": "x,y", "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "500", "minPartitions": "32",
    }
    assert kafka.stream_options("b:9092", ["x"])["startingOffsets"] == "latest"
    scan = kafka.batch_options("b:9092", "add-confirm")
    assert scan["startingOffsets"] == "earliest" and scan["kafka.isolation.level"] == "read_committed"
    assert "kafka.isolation.level" not in kafka.batch_options("b:9092", "add-confirm", committed_only=False)
