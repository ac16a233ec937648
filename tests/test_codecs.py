from pyspark.sql import functions as F

from keyfold.functions import codecs, synth, timefns
from keyfold.operators import routing


def _decode(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return routing.decode(routing.route(df)).collect()


def test_decode_cases(spark):
    # FIXTURES case 4 and the sample lines.
    rows = _decode(spark, [
        'aaaa={"userId":"aaaa","quantity":3,"itemId":"x1","publishTimestamp":"2024-01-01 00:00:00.0"}',
        'aaaa={"userId":"aaaa","publishTimestamp":"2024-01-01 00:00:01.0"}',
        'x1={"itemId":"x1","quantity":300,"publishTimestamp":"2024-01-01 00:00:02.0"}',
        'bbbb={"userId":"bbbb","quantity":-1,"itemId":"x1","publishTimestamp":"1"}',
        'cccc={"userId":',
        'dddd={"userId":"dddd","quantity":"4","itemId":"x2","extra":1}',
        'eeee={"userId":"eeee","quantity":0,"itemId":"x2"}',
        '  ffff={"userId":"ffff","itemId":"x3","quantity":5}  ',
    ])
    by_key = {r.key: r for r in rows}
    assert by_key["aaaa"].topic in ("add-to-cart", "checkout")
    assert [r.topic for r in rows][:3] == ["add-to-cart", "checkout", "restock"]
    assert rows[0].quantity == 3 and rows[0].decoded
    assert rows[2].quantity == 300 and rows[2].itemId == "x1"
    assert rows[3].quantity == -1 and rows[3].decoded
    assert not rows[4].decoded  # cut-off record -> reject side
    assert rows[5].quantity == 4 and not rows[5].decoded  # quoted number; a field that is not declared
    assert rows[6].quantity == 0 and rows[6].decoded
    assert rows[7].key == "ffff" and rows[7].decoded  # trimmed


def test_missing_quantity_reads_zero(spark):
    rows = _decode(spark, ['u={"userId":"u","itemId":"i","quantity_x":1}'])
    # classified by content as add (contains "quantity"); quantity missing -> 0
    assert rows[0].quantity == 0


def test_quantity_forms_and_defaults(spark):
    body = 'u={"userId":"d","quantity":%s}'
    forms = ['"abc"', "3.5", "99999999999", "[1]", "null", "4.0", "1e2", '"7"', "-2147483648"]
    rows = _decode(spark, [body % f for f in forms] + ['u={"userId":"d","quantity":2}', "u=[1]", "u=7", "u"])
    assert [r.decoded for r in rows] == [False] * 4 + [True] * 6 + [False] * 3
    assert [r.quantity for r in rows[4:9]] == [0, 4, 100, 7, -2147483648]
    assert rows[9].itemId is None and rows[9].quantity == 2  # an absent field is a default


def test_body_is_parsed_once(spark):
    df = spark.createDataFrame([("u={}",)], "value string")
    dec = routing.decode(routing.route(df))
    for out in (routing.accepted(dec, "add-to-cart"), routing.rejects(dec), routing.quarantine(dec)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1


def test_accepted_and_quarantined_are_disjoint(spark):
    df = spark.createDataFrame([('e={"userId":"e","quantity":-1,"itemId":"x"}',), ('f={"userId":"f","quantity":1}',)], "value string")
    dec = routing.decode(routing.route(df))
    assert [r.key for r in routing.accepted(dec, "add-to-cart").collect()] == ["f"]
    assert [r.key for r in routing.quarantine(dec).collect()] == ["e"]


def test_draws_are_independent(spark):
    df = spark.range(0, 20000).select(*[synth.uniform("id", s).alias(f"u{s}") for s in (1, 2, 11)])
    for a, b in (("u1", "u2"), ("u1", "u11"), ("u2", "u11")):
        r = df.agg(F.corr(a, b).alias("c"), F.countDistinct(F.round(F.col(a) - F.col(b), 6)).alias("n")).first()
        assert abs(r.c) < 0.03 and r.n > 10000
    texts = spark.range(3).select(synth.id_string("id", 250).alias("s")).collect()
    assert all(len(r.s) == 250 and r.s[:64] != r.s[64:128] for r in texts)


def test_quarantine_and_strict(spark):
    df = spark.createDataFrame([('b={"userId":"b","quantity":-1,"itemId":"x"}',),
                                ('a={"userId":"a","quantity":2,"itemId":"x"}',)], "value string")
    dec = routing.decode(routing.route(df))
    q = routing.quarantine(dec).collect()
    assert [(r.key, r.reason) for r in q] == [("b", "negative_quantity")]
    import pytest

    with pytest.raises(Exception):
        routing.strict(dec).collect()


def test_poison_injection_whole_number(spark):
    df = spark.createDataFrame([('{"userId":"u","quantity":12,"itemId":"i"}',)], "b string")
    out = df.select(codecs.inject_poison("b").alias("x")).first().x
    assert out == '{"userId":"u","quantity":-1,"itemId":"i"}'


def test_encode_omits_defaults(spark):
    df = spark.createDataFrame([("u", "", 0, "5")], "u string, i string, q int, t string")
    v = df.select(codecs.encode_add_to_cart("u", "i", "q", "t").alias("v")).first().v
    assert v == '{"userId":"u","publishTimestamp":"5"}'
    r = df.select(codecs.encode_receipt("u", F.lit("Total items: 0"), "t").alias("v")).first().v
    assert r == '{"userId":"u","receipt":"Total items: 0","publishTimestamp":"5"}'


def test_envelope_round_trip(spark):
    df = spark.createDataFrame([("{}",)], "p string")
    env = df.select(codecs.envelope("type.googleapis.com/AddToCart", "p").alias("e"))
    t, v = codecs.unpack_envelope("e")
    r = env.select(t.alias("t"), v.alias("v")).first()
    assert r.t.endswith("AddToCart") and r.v == "{}"


def test_receipt_text_formats(spark):
    df = spark.createDataFrame([(7, 3)], "u long, n long")
    a = df.select(codecs.receipt_text("User {user} receipt: {n} items", "u", "n").alias("x")).first().x
    b = df.select(codecs.receipt_text("Total items: {n}", "u", "n").alias("x")).first().x
    assert (a, b) == ("User 7 receipt: 3 items", "Total items: 3")


def test_time_functions_independent_of_session_tz(spark):
    import datetime as dt

    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7, 179575),)], "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        r = df.select(timefns.epoch_ms("ts").alias("ms"), timefns.wallclock_string("ts").alias("w")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r.ms == 1704067207179 and r.w == "2024-01-01 00:00:07.0"


def test_synth_power_law_mean(spark):
    df = spark.range(0, 50000).select(synth.power_law_index("id", 1000, 3.0).alias("x"))
    m = df.agg(F.avg("x")).first()[0]
    assert abs(m - 750) < 15  # a/(a+1) of the range
    u = spark.range(0, 20000).select(synth.uniform_int("id", 1, 9).alias("q")).agg(F.min("q"), F.max("q")).first()
    assert (u[0], u[1]) == (1, 9)
    ids = spark.range(3).select(synth.id_string("id", 20).alias("s")).collect()
    assert all(len(r.s) == 20 for r in ids)


def test_endless_replay_and_period_files(spark):
    import os

    from keyfold.operators import synth as syn
    from keyfold.session import shared_path
    from keyfold.sources import eventlog
    from conftest import SF001
    from keyfold.sources import testdata as td

    df = spark.createDataFrame([(1, 100), (2, 200)], "event_id long, ts_ms long")
    out = sorted((r.event_id, r.round, r.ts_ms) for r in syn.endless_replay(df, 3, 1000).collect())
    assert out == [(1, 0, 100), (1, 1, 1100), (1, 2, 2100), (2, 0, 200), (2, 1, 1200), (2, 2, 2200)]
    # One folder per period, read back whole
    lines = eventlog.lines_from_events(td.table(spark, SF001, "events"))
    path = shared_path(spark, "t-periods")
    eventlog.write_periods(lines, path)
    assert len([d for d in os.listdir(path) if d.startswith("period=")]) == lines.select("period").distinct().count()
    back = eventlog.read_periods(spark, path)
    assert back.count() == lines.count()
    day = lines.first().period
    assert back.where(back.period == day).count() == lines.where(lines.period == day).count()
