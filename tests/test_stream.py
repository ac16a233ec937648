import pytest
from pyspark.sql import functions as F

from conftest import SF001
from helpers import ev
from keyfold.operators import carts, reserve
from keyfold.plans import params as P
from keyfold.session import shared_path
from keyfold.streaming import pipeline
from keyfold.streaming.replay import last_batch, replay_events, stream_receipts

_RECEIPT_COLS = ["user_id", "event_id", "n_items", "receipt", "publishTimestamp"]


def _batch_receipts(spark, sf_dir, profile):
    from keyfold.sources import testdata as td

    d = td.domain_events(td.table(spark, sf_dir, "events"), profile.restock_qty)
    return carts.receipts(reserve.reserve(d, profile), d, profile).select(*_RECEIPT_COLS)


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == b.count()


def test_stream_equals_batch_one_run(spark):
    s = stream_receipts(spark, SF001, P.UNIT, waves=1).select(*_RECEIPT_COLS)
    assert _same(s, _batch_receipts(spark, SF001, P.UNIT))


def test_stream_resume_across_restarts(spark):
    # FIXTURES case 6: several ordered files, restart between them.
    s = stream_receipts(spark, SF001, P.UNIT, waves=3).select(*_RECEIPT_COLS)
    assert _same(s, _batch_receipts(spark, SF001, P.UNIT))


def test_stream_remote_profile_confirms(spark):
    out = replay_events(spark, SF001, P.ANY, waves=2)
    conf = out.where(F.col("kind") == "confirm").count()
    from keyfold.sources import testdata as td

    n_adds = td.domain_events(td.table(spark, SF001, "events"), 12, ("add",)).count()
    assert conf == n_adds  # R5: a confirmation for every add, either outcome
    rec = out.where(F.col("kind") == "receipt").select(*_RECEIPT_COLS)
    assert _same(rec, _batch_receipts(spark, SF001, P.ANY))


def test_stream_literal_ordering_inside_batch(spark):
    # adds and the checkout arrive in one micro-batch; order decides the receipt
    rows = [(3, 3, "checkout", 5, None, None), (1, 1, "add", 5, 1, 1), (2, 2, "add", 5, 1, 1),
            (4, 4, "add", 5, 1, 1)]
    base = shared_path(spark, "t-literal")
    pipeline.write_in_order(ev(spark, rows), f"{base}/src")
    out_df = pipeline.build_pipeline(pipeline.file_source(spark, f"{base}/src"), P.EMBEDDED)
    pipeline.run_available(out_df, f"{base}/sink", f"{base}/ckpt")
    rec = spark.read.parquet(f"{base}/sink").where(F.col("kind") == "receipt").collect()
    assert [(r.event_id, r.n_items) for r in rec] == [(3, 2)]


def test_topic_records_per_profile(spark):
    from keyfold.profiles import get_profile

    rows = [(1, 1, "add", 5, 1, 1), (2, 2, "checkout", 5, None, None)]
    base = shared_path(spark, "t-topics")
    pipeline.write_in_order(ev(spark, rows), f"{base}/src")
    p = get_profile("remote", initial_stock=10)
    out = pipeline.to_topic_records(pipeline.build_pipeline(pipeline.file_source(spark, f"{base}/src"), p), p)
    pipeline.run_available(out, f"{base}/sink", f"{base}/ckpt")
    got = sorted((r.topic, bytes(r.key).decode(), r.value) for r in spark.read.parquet(f"{base}/sink").collect())
    assert got == [
        ("add-confirm", "5", '{"userId":"5","itemId":"1","quantity":1,"publishTimestamp":"1000"}'),
        ("receipts", "5", '{"userId":"5","receipt":"Total items: 1","publishTimestamp":"2000"}'),
    ]


def test_ordered_mode_settles_in_event_order(spark):
    # the checkout (t=20) and an add of another user (t=15) arrive a batch
    # before the adds at t=10 and t=12; event order decides stock and basket
    import datetime as dt

    base = shared_path(spark, "t-ordered")
    P1 = P.UNIT.with_(initial_stock=1)

    def wave(rows):
        pipeline.write_in_order(ev(spark, rows), f"{base}/src")
        out = pipeline.build_ordered_pipeline(pipeline.file_source(spark, f"{base}/src"), P1, "30 seconds", bucket_ms=1000, spread=2)
        pipeline.run_available(out, f"{base}/sink", f"{base}/ckpt")

    wave([(3, 20, "checkout", 5, None, None), (5, 15, "add", 6, 1, 1)])
    wave([(1, 10, "add", 5, 1, 1), (2, 12, "add", 5, 2, 1)])
    wave([(9, 1000, "tick", None, None, None)])
    out = spark.read.parquet(f"{base}/sink").collect()
    rec = [(r.event_id, r.n_items) for r in out if r.kind == "receipt"]
    assert rec == [(3, 2)]  # user 5 got item 1's only unit (t=10 before t=15) and item 2
    assert sorted(r.event_id for r in out if r.kind == "confirm") == [1, 2, 5]


def _long_log(spark):
    """400 events over seven months, a third of them of one item, 8 users."""
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(400):
        kind = rnd.choices(["add", "checkout", "restock"], [6, 2, 1])[0]
        item = None if kind == "checkout" else 0 if rnd.random() < 0.33 else rnd.randint(1, 4)
        user = None if kind == "restock" else rnd.randint(1, 8)
        q = None if kind == "checkout" else 3 if kind == "restock" else rnd.randint(1, 9)
        rows.append((i, rnd.randint(0, 210 * 86400), kind, user, item, q))
    return ev(spark, rows)


def test_streams_equal_batch_on_a_log_of_months(spark):
    from keyfold.streaming.replay import stream_receipts_out_of_order, time_waves

    d = _long_log(spark)
    want = carts.receipts(reserve.reserve(d, P.UNIT), d, P.UNIT).select(*_RECEIPT_COLS)
    assert want.count() > 20
    waves = time_waves(d, 3)
    assert sum(w.count() for w in waves) == 400 and all(w.count() > 50 for w in waves)
    assert _same(stream_receipts(spark, "", P.UNIT, waves=1, domain=d), want)
    assert _same(stream_receipts(spark, "", P.UNIT, waves=3, domain=d), want)
    assert _same(stream_receipts_out_of_order(spark, "", P.UNIT, domain=d), want)


def test_periods_follow_the_calendar(spark):
    from keyfold.sources.eventlog import period_col

    p = _long_log(spark).select(period_col().alias("p")).distinct().count()
    assert p > 100


# ------------------------------------------------- bounded batches, carried folds


@pytest.mark.parametrize("records,rows_per_file", [(16, 10_000), (10_000, 90)])
def test_chunks_of_a_key_and_files_of_a_wave(spark, records, rows_per_file):
    """A hot item's batch spans many Arrow chunks; or the log many micro-batches."""
    d = _long_log(spark)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
        base = shared_path(spark, "t-chunks")
        out = replay_events(spark, "", P.UNIT, domain=d, rows_per_file=rows_per_file, base=base)
        got = out.where("kind = 'receipt'").select(*_RECEIPT_COLS)
        assert _same(got, carts.receipts(reserve.reserve(d, P.UNIT), d, P.UNIT).select(*_RECEIPT_COLS))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert last_batch(spark, f"{base}/checkpoint") >= (3 if rows_per_file < 100 else 0)


def test_files_are_taken_in_event_order(spark):
    import glob
    import os

    base = shared_path(spark, "t-files")
    n = pipeline.write_in_order(_long_log(spark), base, rows_per_file=50)
    files = sorted(glob.glob(f"{base}/part-*.parquet"), key=os.path.getmtime)
    assert n == len(files) > 4
    ends = [spark.read.parquet(f).agg(F.min("ts"), F.max("ts")).first() for f in files]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


class _List:
    def __init__(self):
        self.held, self.written, self.read = [], 0, 0

    def appendValue(self, v):
        self.held.append(v)
        self.written += 1

    def get(self):
        self.read += len(self.held)
        return iter(list(self.held))

    def clear(self):
        self.held = []


def test_reorder_state_is_written_and_read_once():
    import pandas as pd

    from keyfold.streaming.processors import DOMAIN_SCHEMA, ReorderProcessor

    timers, states = [], []

    class Handle:
        def getListState(self, name, schema):
            states.append(_List())
            return states[-1]

        def registerTimer(self, at):
            timers.append(at)

    names = DOMAIN_SCHEMA.fieldNames()
    for bucket in range(50):  # each key has its own list, as in the state store
        p = ReorderProcessor(1000)
        p.init(Handle())
        for k in range(4):
            ts = bucket * 1000 + 10 * k
            rows = pd.DataFrame([(k, pd.Timestamp(ts, unit="ms"), ts, "add", 1, None, 2)], columns=names)
            assert list(p.handleInputRows((bucket, 0), iter([rows]), None)) == []
        out = pd.concat(list(p.handleExpiredTimer((bucket, 0), None, None)))
        assert out["event_id"].tolist() == [0, 1, 2, 3] and out["item_id"].isna().all()
    assert timers == [(b + 1) * 1000 for b in range(50) for _ in range(4)]
    assert [(s.written, s.read, s.held) for s in states] == [(4, 4, [])] * 50


def test_rows_out_of_order_are_refused():
    import pandas as pd

    from keyfold.streaming.processors import _chunks

    def chunk(*ids):
        return pd.DataFrame({"ts": pd.to_datetime(list(ids), unit="s"), "event_id": list(ids)})

    assert [len(c) for c in _chunks(iter([chunk(1, 2), chunk(), chunk(2, 3)]))] == [2, 2]
    for bad in ([chunk(2, 1)], [chunk(1, 3), chunk(2)]):
        with pytest.raises(RuntimeError, match="out of"):
            list(_chunks(iter(bad)))


def test_processing_time_trigger_and_topic_records(spark):
    """Micro-batches on a clock; S16: the print sink starts and stops."""
    base = shared_path(spark, "t-clock")
    pipeline.write_in_order(ev(spark, [(1, 1, "add", 5, 1, 1)]), f"{base}/src")
    stream = pipeline.file_source(spark, f"{base}/src")
    w = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
    q = pipeline.processing_trigger(w, 1).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(f"{base}/out").count() == 1
    q = pipeline.console_sink(stream, f"{base}/ck2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


# ------------------------------------------- what a replay costs (F1 to F11 of round 3)


def test_a_micro_batch_takes_a_file_a_core(spark):
    """The number of micro-batches falls with the cores: it was one a file."""
    base = shared_path(spark, "t-bound")
    n = pipeline.write_in_order(_long_log(spark), f"{base}/src", rows_per_file=20)
    cores = spark.sparkContext.defaultParallelism
    pipeline.run_available(pipeline.file_source(spark, f"{base}/src"), f"{base}/sink", f"{base}/ckpt")
    assert n > cores or cores > 16
    assert last_batch(spark, f"{base}/ckpt") + 1 == -(-n // cores)
    assert spark.read.parquet(f"{base}/sink").count() == 400


class _Map:
    def __init__(self):
        self.held, self.reads, self.writes = {}, 0, 0

    def getValue(self, k):
        self.reads += 1
        return self.held.get(k)

    def containsKey(self, k):
        self.reads += 1
        return k in self.held

    def updateValue(self, k, v):
        self.writes += 1
        self.held[k] = v

    def removeKey(self, k):
        self.writes += 1
        self.held.pop(k, None)


class _Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, _Map())


def _cart_rows(*rows):
    import pandas as pd

    names = ["user_id", "ts_ms", "kind", "item_id", "requested", "status"]
    pdf = pd.DataFrame(rows, columns=names)
    return pdf.assign(event_id=pdf["ts_ms"], ts=pd.to_datetime(pdf["ts_ms"], unit="ms"))


def test_a_shard_of_users_is_one_call():
    """One handler call for many users, each with a state of their own; a user
    costs a read, and a write only if the basket changed."""
    import pandas as pd

    from keyfold.streaming.processors import CartItemsProcessor, CartProcessor

    first = _cart_rows((1, 1, "add", 7, 2, "INSTOCK"), (1, 2, "add", 8, 1, "OUTOFSTOCK"), (2, 1, "add", 7, 3, "INSTOCK"),
                       (2, 5, "checkout", None, None, None), (3, 4, "checkout", None, None, None))
    second = _cart_rows((1, 9, "checkout", None, None, None), (2, 9, "add", 7, 1, "OUTOFSTOCK"))
    handle = _Handle()
    p = CartProcessor("clear", "{user}: {n}", n_filler=1)
    p.init(handle)
    out = pd.concat(p.handleInputRows((0,), iter([first[:3], first[3:]]), None))
    assert out[out.kind == "receipt"][["user_id", "event_id", "n_items", "receipt"]].values.tolist() == [[2, 5, 3, "2: 3"]]
    assert out[out.kind == "confirm"][["user_id", "item_id", "quantity"]].values.tolist() == [[1, 7, 2], [1, 8, 1], [2, 7, 3]]
    basket, filler = handle.states["basket"], handle.states["filler0"]
    assert (basket.held, basket.reads, basket.writes) == ({(1,): (2,)}, 3, 1) and set(filler.held) == {(1,), (2,)}
    out = pd.concat(p.handleInputRows((0,), iter([second]), None))
    assert out["n_items"].tolist() == [2, None] and basket.held == {} and (basket.reads, basket.writes) == (5, 2)
    assert filler.writes == 2

    handle = _Handle()
    p = CartItemsProcessor()
    p.init(handle)
    out = pd.concat(p.handleInputRows((0,), iter([first]), None))
    assert out["receipt"].tolist() == ["User 2 receipt: \nItem: 7, Quantity: 3\n"]
    assert handle.states["basket_items"].held == {(1,): ('{"7": 2}',)}
    out = pd.concat(p.handleInputRows((0,), iter([second]), None))
    assert out["receipt"].tolist() == ["User 1 receipt: \nItem: 7, Quantity: 2\n"]
    assert handle.states["basket_items"].held == {}


def test_users_of_a_shard_out_of_order_are_refused():
    from keyfold.streaming.processors import _chunks

    a, b = _cart_rows((1, 5, "checkout", None, None, None)), _cart_rows((2, 1, "checkout", None, None, None))
    assert len(list(_chunks(iter([a, b]), "user_id"))) == 2
    with pytest.raises(RuntimeError, match="out of"):
        list(_chunks(iter([b, a]), "user_id"))


# ------------------------------- rows and states by the message (F2 to F9, F11 of round 3)


class _Value:
    def __init__(self):
        self.held, self.reads, self.writes = None, 0, 0

    def get(self):
        self.reads += 1
        return self.held

    def update(self, v):
        self.writes += 1
        self.held = v

    def clear(self):
        self.writes += 1
        self.held = None


class _Values:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value())


def _packed_cart(n_filler=0):
    from pyspark.sql import types as T

    from keyfold.streaming import processors as X

    types = {"event_id": T.LongType(), "ts": T.TimestampNTZType(), "ts_ms": T.LongType(), "kind": T.StringType(),
             "user_id": T.LongType(), "item_id": T.LongType(), "requested": T.IntegerType(), "status": T.StringType()}
    given = X.arrow_schema(T.StructType([T.StructField(n, t) for n, t in types.items()]))
    made, handle = X.arrow_schema(X.OUTPUT_SCHEMA), _Values()
    p = X.Packed(X.CartProcessor("clear", "{user}: {n}", n_filler), given, made)
    p.init(handle)

    def call(*parts):
        import pandas as pd
        import pyarrow as pa

        bodies = [pa.RecordBatch.from_pandas(x, given, preserve_index=False).serialize().to_pybytes() for x in parts]
        made_rows = p.handleInputRows((0,), iter([pd.DataFrame({"rows": bodies})]), None)
        messages = [m for pdf in made_rows for m in pdf["rows"]]
        rows = [r for b in X.unpack(made)(iter([pa.record_batch({"rows": pa.array(messages, pa.binary())})])) for r in b.to_pylist()]
        return rows

    return call, handle


def test_a_shards_states_are_a_message_each():
    """A call reads and writes each state of a shard once, however many users:
    it was a message to the JVM per user."""
    call, handle = _packed_cart(n_filler=1)
    adds = _cart_rows(*((u, 1, "add", 7, 2, "INSTOCK") for u in range(500)))
    assert [(r["kind"], r["user_id"]) for r in call(adds[:300], adds[300:])] == [("confirm", u) for u in range(500)]
    basket, filler = handle.states["basket"], handle.states["filler0"]
    assert [(s.reads, s.writes) for s in (basket, filler)] == [(1, 1), (1, 1)]
    out = call(_cart_rows(*((u, 2, "checkout", None, None, None) for u in range(0, 500, 2))))
    assert [(r["user_id"], r["n_items"], r["receipt"]) for r in out] == [(u, 2, f"{u}: 2") for u in range(0, 500, 2)]
    assert (basket.reads, basket.writes, filler.reads, filler.writes) == (2, 2, 1, 1)
    call(_cart_rows((1, 3, "add", 7, 1, "OUTOFSTOCK")))
    assert (basket.reads, basket.writes, filler.writes) == (3, 2, 1)
    out = call(_cart_rows(*((u, 4, "checkout", None, None, None) for u in range(500))))
    assert [r["user_id"] for r in out] == list(range(1, 500, 2)) and basket.held is None


def test_rows_are_packed_per_key_and_batch():
    import pyarrow as pa

    from keyfold.streaming.processors import pack

    given = pa.schema([("k", pa.int64()), ("s", pa.string()), ("ts", pa.timestamp("us"))])
    rows = pa.record_batch([[1, 1, 2, 2, 2, 5], ["a", None, "b", "", "c", "é"], [1, None, 3, 4, 5, 6]], schema=given)
    got = [m for b in pack("k", given)(iter([rows, rows.slice(0, 0), rows.slice(5)])) for m in b.to_pylist()]
    assert [(m["k"], m["seq"]) for m in got] == [(1, 0), (2, 1), (5, 2), (5, 3)]
    back = [pa.ipc.read_record_batch(pa.py_buffer(m["rows"]), given) for m in got]
    assert pa.Table.from_batches(back).equals(pa.Table.from_batches([rows, rows.slice(5)]).combine_chunks())


def test_refused_adds_are_one_run(monkeypatch):
    """Adds refused one after another at the same stock were a turn each."""
    import numpy as np

    n, turns, cumsum = 100_000, [], np.cumsum
    monkeypatch.setattr(reserve.np, "cumsum", lambda a: turns.append(len(a)) or cumsum(a))
    is_add = np.ones(n, bool)
    is_add[50_000] = False
    ok, after = reserve.settle_run(5, np.where(is_add, -1, 2), is_add)
    assert ok.nonzero()[0].tolist() == [0, 1, 2, 3, 4, 50_001, 50_002] and after[[4, 49_999, 50_000, 50_002, n - 1]].tolist() == [0, 0, 2, 0, 0]
    assert len(turns) < 10


def test_derived_columns_are_made_once(spark):
    """The passes that count and sample a replay's rows made its columns too."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"x{i}"

    base = shared_path(spark, "t-derive")
    d = _long_log(spark)
    n = pipeline.write_in_order(d, base, 50, lambda df: df.select("event_id", "ts", text("event_id").alias("x")))
    got = spark.read.parquet(base)
    assert n > 4 and _same(got, d.select("event_id", "ts", F.concat(F.lit("x"), F.col("event_id").cast("string"))))
    assert made.value == 400


# ------------------- baskets by the chunk, larger files, records decoded once (F3 to F6 of round 3)


def test_baskets_of_a_chunk_are_sums(monkeypatch):
    """A row of a chunk was several Python calls."""
    import pandas as pd

    from keyfold.streaming import processors as X

    calls = []
    monkeypatch.setattr(X, "_text", lambda x: calls.append(x) or str(int(x)))
    monkeypatch.setattr(X, "_long", lambda x: calls.append(x) or (None if x is None or x != x else int(x)))
    rows = _cart_rows((1, 1, "add", 7, 2, "INSTOCK"), (1, 2, "checkout", None, None, None), (1, 3, "checkout", None, None, None),
                      (1, 4, "add", 8, 4, "INSTOCK"), (1, 5, "add", 8, 9, "OUTOFSTOCK"), (1, 6, "checkout", None, None, None),
                      (2, 1, "checkout", None, None, None), (2, 2, "add", 7, 0, "INSTOCK"), (2, 3, "checkout", None, None, None))
    for mode, want in (("clear", [(2, 2), (6, 4), (3, 0)]), ("running", [(2, 2), (3, 2), (6, 6), (1, 0), (3, 0)]), ("none", [])):
        for cut in range(1, len(rows)):
            p = X.CartProcessor(mode, "{user}: {n}")
            p.init(_Handle())
            out = pd.concat(p.handleInputRows((0,), iter([rows[:cut], rows[cut:]]), None))
            got = out[out.kind == "receipt"]
            assert list(zip(got["event_id"], got["n_items"])) == want
            assert out[out.kind == "confirm"]["quantity"].tolist() == [2, 4, 9, 0]
    assert not calls


def test_a_replayed_file_holds_some_hundred_thousand_rows(spark, monkeypatch):
    """A micro-batch, whose fixed part is seconds, took 100,000 rows a core."""
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(pipeline, "ROWS_PER_FILE", 400)
    monkeypatch.setattr(pipeline, "LEAST_ROWS", 100)
    rows = spark.range(300 * cores).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("ts"))
    assert pipeline.write_in_order(rows, shared_path(spark, "t-files")) == cores
    assert pipeline.write_in_order(rows.limit(250), shared_path(spark, "t-files")) == min(2, cores)


def test_a_log_record_is_decoded_in_one_stream(spark):
    """Adds, restocks and checkouts were decoded in both ways into the chain."""
    from keyfold.streaming.replay import log_stream

    base = shared_path(spark, "t-log")
    lines = ['1={"userId":"1","itemId":"7","quantity":2}', '1={"userId":"1"}', '7={"itemId":"7","quantity":3}', "x=none", "1={userId"]
    values = [(i, f"2024-01-01 00:00:0{i}", i, v.replace("{userId", '{"userId"')) for i, v in enumerate(lines)]
    df = spark.createDataFrame(values, "event_id long, ts string, ts_ms long, value string")
    pipeline.write_in_order(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), f"{base}/src")
    kinds = []
    for i, part in enumerate(log_stream(spark, f"{base}/src")):
        pipeline.run_available(part, f"{base}/sink{i}", f"{base}/ckpt{i}")
        kinds.append(sorted((r.event_id, r.kind) for r in spark.read.parquet(f"{base}/sink{i}").collect()))
    assert kinds == [[(0, "add"), (2, "restock")], [(1, "checkout")]]
