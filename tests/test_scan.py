import random

import pytest
from pyspark.sql import functions as F

from helpers import ev
from keyfold.operators import scan


@pytest.mark.parametrize("ranges", [None, 1, 7])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_sums_match_python(spark, ranges, exclusive):
    rnd = random.Random(4)
    rows = [(i, rnd.randint(0, 3000), "add", rnd.randint(0, 3), None, rnd.randint(-3, 9)) for i in range(300)]
    df = ev(spark, rows)
    got = {
        r.event_id: r.s
        for r in scan.running_sums(df, ["user_id"], {"s": F.col("quantity").cast("long")},
                                   scan.Chunking(ranges), exclusive=exclusive).collect()
    }
    acc, want = {}, {}
    for eid, sec, _k, u, _i, q in sorted(rows, key=lambda r: (r[1], r[0])):
        if exclusive:
            want[eid] = acc.get(u, 0)
            acc[u] = acc.get(u, 0) + q
        else:
            acc[u] = acc.get(u, 0) + q
            want[eid] = acc[u]
    assert got == want


@pytest.mark.parametrize("ranges", [None, 1, 5])
def test_reflected_level(spark, ranges):
    rnd = random.Random(9)
    rows = [(i, rnd.randint(0, 2000), "add", None, rnd.randint(0, 2), rnd.choice([-1, -1, -1, 2, 0])) for i in range(250)]
    df = ev(spark, rows)
    out = scan.reflected_level(df, ["item_id"], F.col("quantity"), 3, scan.Chunking(ranges))
    got = {r.event_id: r._level - r._m for r in out.collect()}
    level, want = {}, {}
    for eid, sec, _k, _u, item, d in sorted(rows, key=lambda r: (r[1], r[0])):
        level[item] = max(level.get(item, 3) + d, 0)
        want[eid] = level[item]
    assert got == want


@pytest.mark.parametrize("ranges", [1, 3, 13])
def test_range_scan_running_sums_and_level(spark, ranges):
    rnd = random.Random(31)
    # few keys, many partitions: keys span partition borders; one burst at one instant
    rows = [(i, rnd.randint(0, 3000), "add", rnd.choice([0, 0, 0, 1, 2]), rnd.choice([5, 5, 6]),
             rnd.randint(-3, 4)) for i in range(350)]
    rows += [(1000 + i, 1500, "add", 0, 5, rnd.choice([-1, 2])) for i in range(60)]
    df = ev(spark, rows)
    ch = scan.Chunking(ranges=ranges)
    got = {r.event_id: (r.s, r.c) for r in scan.running_sums(
        df, ["user_id"], {"s": F.col("quantity").cast("long"), "c": F.lit(1).cast("long")}, ch,
        exclusive={"c"}).collect()}
    want = {r.event_id: (r.s, r.c) for r in scan.running_sums(
        df, ["user_id"], {"s": F.col("quantity").cast("long"), "c": F.lit(1).cast("long")}, scan.Chunking(),
        exclusive={"c"}).collect()}
    assert got == want
    a = {r.event_id: (r._level, r._m, r._m_prev)
         for r in scan.reflected_level(df, ["item_id"], F.col("quantity"), 2, ch).collect()}
    b = {r.event_id: (r._level, r._m, r._m_prev)
         for r in scan.reflected_level(df, ["item_id"], F.col("quantity"), 2, scan.Chunking()).collect()}
    assert a == b


def test_range_scan_small_arrow_batches(spark):
    # state carried across Arrow batch borders inside one partition
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(5)
        rows = [(i, rnd.randint(0, 500), "add", rnd.choice([0, 1]), 3, rnd.randint(-2, 3)) for i in range(120)]
        df = ev(spark, rows)
        a = {r.event_id: (r._level, r._m, r._m_prev)
             for r in scan.reflected_level(df, ["user_id"], F.col("quantity"), 1, scan.Chunking(ranges=2)).collect()}
        b = {r.event_id: (r._level, r._m, r._m_prev)
             for r in scan.reflected_level(df, ["user_id"], F.col("quantity"), 1, scan.Chunking()).collect()}
        assert a == b
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_range_scan_consistent_under_sampling(spark):
    # with real sampling, range bounds depend on the sample (seeded per plan
    # instance); both consumers of the pass must still see the same partitions
    import os, sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from skew_demo import events

    from keyfold.operators import reserve
    from keyfold.profiles import get_profile

    p = get_profile("remote", initial_stock=1000, restock_qty=300, demand="unit")
    d = events(spark, 600_000)
    cols = ["event_id", "status", "stock_after"]
    got = reserve.reserve(d, p, method="unit", chunking=scan.Chunking(ranges=32)).select(*cols)
    want = reserve.reserve(d, p, method="unit", chunking=scan.Chunking()).select(*cols)
    assert want.exceptAll(got).count() == 0 == got.exceptAll(want).count()
    q = get_profile("remote", initial_stock=2000, restock_qty=300)
    got = reserve.reserve(d, q, method="fold", chunking=scan.Chunking(ranges=32)).select(*cols)
    want = reserve.reserve(d, q, method="fold", chunking=scan.Chunking()).select(*cols)
    assert want.exceptAll(got).count() == 0 == got.exceptAll(want).count()


def test_every_nth_positions_under_sampling(spark):
    from keyfold.operators import keyed

    n = 600_000
    df = spark.range(0, n, numPartitions=16).select(
        F.col("id").alias("event_id"),
        F.timestamp_millis(F.lit(1_704_067_200_000) + (F.col("id") * 7) % 1_000_000).cast("timestamp_ntz").alias("ts"),
    )
    marks = keyed.every_nth(df, 1000)
    # the expected position of each event in (ts, event_id) order
    got = sorted((r.event_id, r.position) for r in marks.select("event_id", "position").collect())
    order = sorted(((r.ts, r.event_id) for r in df.collect()))
    assert got == sorted((eid, i + 1) for i, (_, eid) in enumerate(order) if (i + 1) % 1000 == 0)
