import random

import pytest
from pyspark.sql import functions as F

from helpers import ev, python_fold
from keyfold.operators import reserve, scan
from keyfold.profiles import get_profile


def settled_map(df):
    return {r.event_id: (r.status, r.stock_after) for r in df.collect()}


UNIT = get_profile("embedded", initial_stock=2, restock_applies=True, restock_qty=3)
ANY = get_profile("remote", initial_stock=5, restock_qty=4)


def test_exact_stock_one_short_restock_between(spark):
    # FIXTURES case 1: stock 2, two grants, one refusal, restock, grant.
    rows = [
        (1, 1, "add", 10, 7, 1),
        (2, 2, "add", 11, 7, 1),
        (3, 3, "add", 12, 7, 1),
        (4, 4, "restock", None, 7, 3),
        (5, 5, "add", 13, 7, 1),
    ]
    got = settled_map(reserve.reserve(ev(spark, rows), UNIT))
    assert got == {1: ("INSTOCK", 1), 2: ("INSTOCK", 0), 3: ("OUTOFSTOCK", 0),
                   4: (None, 3), 5: ("INSTOCK", 2)}


def test_two_users_neighbouring_times(spark):
    # FIXTURES case 2: the earlier (ts, event_id) wins the last unit.
    p = UNIT.with_(initial_stock=1)
    rows = [(8, 5, "add", 1, 3, 1), (7, 5, "add", 2, 3, 1)]
    got = settled_map(reserve.reserve(ev(spark, rows), p))
    assert got[7] == ("INSTOCK", 0) and got[8] == ("OUTOFSTOCK", 0)


def test_embedded_ignores_restock(spark):
    p = get_profile("embedded", initial_stock=1)
    rows = [(1, 1, "add", 1, 3, 1), (2, 2, "restock", None, 3, 300), (3, 3, "add", 2, 3, 1)]
    got = settled_map(reserve.reserve(ev(spark, rows), p))
    assert got == {1: ("INSTOCK", 0), 3: ("OUTOFSTOCK", 0)}


def test_negative_quantity_raises_stock(spark):
    # A negative request is granted and the stock rises.
    rows = [(1, 1, "add", 1, 3, 1), (2, 2, "add", 1, 3, -1), (3, 3, "add", 1, 3, 1)]
    got = settled_map(reserve.reserve(ev(spark, rows), UNIT.with_(initial_stock=1)))
    assert got == {1: ("INSTOCK", 0), 2: ("INSTOCK", 1), 3: ("INSTOCK", 0)}


def test_any_demand_is_all_or_nothing(spark):
    rows = [(1, 1, "add", 1, 3, 4), (2, 2, "add", 1, 3, 3), (3, 3, "add", 1, 3, 1),
            (4, 4, "restock", None, 3, 4), (5, 5, "add", 1, 3, 3)]
    got = settled_map(reserve.reserve(ev(spark, rows), ANY))
    assert got == {1: ("INSTOCK", 1), 2: ("OUTOFSTOCK", 1), 3: ("INSTOCK", 0),
                   4: (None, 4), 5: ("INSTOCK", 1)}


def _random_rows(seed, n=400, items=4, unit=False):
    rnd = random.Random(seed)
    rows = []
    for eid in range(n):
        sec = rnd.randint(0, 5000)
        item = rnd.randint(0, items - 1)
        if rnd.random() < 0.12:
            rows.append((eid, sec, "restock", None, item, rnd.randint(1, 6)))
        else:
            q = 1 if unit else rnd.randint(1, 9)
            if rnd.random() < 0.02:
                q = -rnd.randint(1, 3)
            rows.append((eid, sec, "add", rnd.randint(0, 20), item, q))
    return rows


@pytest.mark.parametrize("ranges", [None, 2, 9])
@pytest.mark.parametrize("seed", [1, 2])
def test_unit_scan_equals_fold(spark, seed, ranges):
    rows = _random_rows(seed, unit=True)
    p = UNIT.with_(initial_stock=4)
    want = python_fold(rows, 4, "unit", True)
    got = settled_map(reserve.reserve(ev(spark, rows), p, method="unit", chunking=scan.Chunking(ranges)))
    assert got == want


@pytest.mark.parametrize("ranges", [None, 12])
@pytest.mark.parametrize("init", [3, 60, 400])
def test_any_demand_fold_equals_python(spark, ranges, init):
    rows = _random_rows(7, unit=False)
    p = ANY.with_(initial_stock=init)
    want = python_fold(rows, init, "quantity", True)
    got = settled_map(reserve.reserve(ev(spark, rows), p, method="fold", chunking=scan.Chunking(ranges)))
    assert got == want


def test_unit_and_fold_agree_on_unit_demand(spark):
    rows = _random_rows(3, unit=True)
    d = ev(spark, rows)
    a = settled_map(reserve.reserve(d, UNIT, method="unit", chunking=scan.Chunking(5)))
    b = settled_map(reserve.reserve(d, UNIT, method="fold", chunking=scan.Chunking(5)))
    assert a == b


def test_invariants(spark):
    rows = _random_rows(11, unit=False)
    s = reserve.reserve(ev(spark, rows), ANY.with_(initial_stock=10), chunking=scan.Chunking(5))
    adds = sum(1 for r in rows if r[2] == "add")
    agg = s.agg(
        F.min("stock_after").alias("lo"),
        F.sum(F.when(F.col("status").isNotNull(), 1).otherwise(0)).alias("n"),
    ).first()
    assert agg.lo >= 0
    assert agg.n == adds


def test_item_outcomes_final_stock(spark):
    rows = _random_rows(5, unit=True)
    s = reserve.reserve(ev(spark, rows), UNIT, chunking=scan.Chunking(5))
    want = python_fold(rows, UNIT.initial_stock, "unit", True)
    last = {}
    for eid, sec, kind, user, item, q in sorted(rows, key=lambda r: (r[1], r[0])):
        if eid in want:
            last[item] = want[eid][1]
    got = {r.item_id: r.final_stock for r in reserve.item_outcomes(s).collect()}
    assert got == last


def test_layout_is_the_same_for_every_size(spark):
    assert scan.choose_chunking(ev(spark, _random_rows(1))) == scan.Chunking(
        ranges=int(spark.conf.get("spark.sql.shuffle.partitions"))
    )


def test_unit_method_is_guarded(spark):
    d = ev(spark, _random_rows(1))
    with pytest.raises(ValueError):
        reserve.reserve(d, ANY, method="unit")
    with pytest.raises(ValueError):
        reserve.reserve(d, UNIT.with_(restock_qty=-1))


@pytest.mark.parametrize("seed", range(4))
def test_hot_item_over_many_ranges(spark, seed):
    """One item holds a third of the rows and spans at least eight ranges;
    its stock runs dry again and again."""
    rnd = random.Random(seed)
    rows = []
    for eid in range(900):
        item = 0 if rnd.random() < 0.4 else rnd.randint(1, 30)
        if rnd.random() < 0.15:
            rows.append((eid, rnd.randint(0, 500), "restock", None, item, rnd.randint(1, 60)))
        else:
            rows.append((eid, rnd.randint(0, 500), "add", rnd.randint(0, 20), item, rnd.choice([1, 2, 5, 9, 30, -2])))
    p = ANY.with_(initial_stock=rnd.choice([0, 20, 200]))
    got = settled_map(reserve.reserve(ev(spark, rows), p, method="fold", chunking=scan.Chunking(ranges=24)))
    assert got == python_fold(rows, p.initial_stock, "quantity", True)


@pytest.mark.parametrize("init", [0, 25, 10_000])
def test_fold_partition_blocks_and_batches(init):
    import numpy as np
    import pandas as pd

    rnd = random.Random(init + 3)
    rows = []
    for item in (4, 9, 11):
        for _ in range(rnd.randint(50, 700)):
            if rnd.random() < 0.05:
                rows.append((item, "restock", None, rnd.randint(1, 400)))
            else:
                rows.append((item, "add", rnd.choice([1, 2, 3, 9, -1]), None))
    eids = list(range(len(rows)))
    pdf = pd.DataFrame({
        "event_id": eids, "ts": pd.to_datetime(eids, unit="s"), "ts_ms": eids, "kind": [r[1] for r in rows],
        "user_id": 1, "item_id": [r[0] for r in rows],
        "requested": pd.array([r[2] for r in rows], dtype="Int32"),
        "restock": pd.array([r[3] for r in rows], dtype="Int32"), "_S": init,
        "_add": [r[1] == "add" for r in rows],
    })
    cuts = [0] + sorted(rnd.sample(range(1, len(rows)), 9)) + [len(rows)]
    batches = [pdf.iloc[a:b] for a, b in zip(cuts, cuts[1:])]
    out = pd.concat(list(reserve._fold_partition(iter(batches))))
    stock, want = {}, []
    for item, kind, q, r in rows:
        s = stock.get(item, init)
        if kind == "add":
            st = "INSTOCK" if s >= q else "OUTOFSTOCK"
            s = s - q if s >= q else s
        else:
            st, s = None, s + r
        stock[item] = s
        want.append((st, s))
    status = [("INSTOCK" if g else "OUTOFSTOCK") if k == "add" else None for g, k in zip(out["_granted"], out["kind"])]
    got = list(zip(status, out["stock_after"].astype(np.int64)))
    assert got == want


@pytest.mark.parametrize("ranges", [1, 3, 9])
@pytest.mark.parametrize("init", [3, 60, 400])
def test_any_demand_ranged_equals_python(spark, ranges, init):
    rows = _random_rows(7, n=500, items=3, unit=False)
    p = ANY.with_(initial_stock=init)
    want = python_fold(rows, init, "quantity", True)
    got = settled_map(reserve.reserve(ev(spark, rows), p, method="fold", chunking=scan.Chunking(ranges=ranges)))
    assert got == want
