"""One shared input, the differences between variants by rule number."""

from pyspark.sql import functions as F

from helpers import ev
from keyfold.operators import carts, reserve
from keyfold.profiles import PROFILES, get_profile

ROWS = [
    (1, 1, "add", 5, 1, 3),
    (2, 2, "restock", None, 1, 10),
    (3, 3, "add", 5, 1, 4),
    (4, 4, "checkout", 5, None, None),
    (5, 5, "checkout", 5, None, None),
]


def test_profile_table():
    assert PROFILES["embedded"].receipt_topic == "receipt"
    assert PROFILES["remote"].receipt_topic == "receipts"
    assert PROFILES["embedded"].initial_stock == PROFILES["remote"].initial_stock == 100_000


def test_differences_on_shared_input(spark):
    d = ev(spark, ROWS)
    emb = get_profile("embedded", initial_stock=3)
    rem = get_profile("remote", initial_stock=3, restock_qty=10)
    se = {r.event_id: (r.requested, r.status, r.stock_after) for r in reserve.reserve(d, emb).collect()}
    sr = {r.event_id: (r.requested, r.status, r.stock_after) for r in reserve.reserve(d, rem).collect()}
    # Embedded asks for 1, remote for the real quantity
    assert se[1] == (1, "INSTOCK", 2) and sr[1] == (3, "INSTOCK", 0)
    # Embedded ignores the restock, remote adds it
    assert 2 not in se and sr[2] == (None, None, 10)
    assert sr[3] == (4, "INSTOCK", 6)
    # R7 vs R8/R9: one receipt then nothing (clear) vs a receipt per checkout (running)
    re_ = {r.event_id: r.receipt for r in carts.receipts(reserve.reserve(d, emb), d, emb).collect()}
    rr = {r.event_id: r.receipt for r in carts.receipts(reserve.reserve(d, rem), d, rem).collect()}
    assert re_ == {4: "User 5 receipt: 2 items"}
    assert rr == {4: "Total items: 7", 5: "Total items: 7"}
    # Simple echoes the add at once with the raw quantity, no receipts
    echo = carts.echo_confirms(d).select("event_id", "quantity").orderBy("event_id").collect()
    assert [(r.event_id, r.quantity) for r in echo] == [(1, 3), (3, 4)]


def test_poison_negative_passes_on(spark):
    # After replay a negative request is granted: stock rises, basket falls
    rows = [(1, 1, "add", 5, 1, 1), (2, 2, "add", 5, 1, -2), (3, 3, "checkout", 5, None, None)]
    d = ev(spark, rows)
    p = get_profile("embedded", initial_stock=1)
    s = reserve.reserve(d, p)
    assert {r.event_id: r.stock_after for r in s.collect()} == {1: 0, 2: 2}
    rec = carts.receipts(s, d, p).select("n_items").first()
    assert rec.n_items == -1
    assert s.where(F.col("status") == "OUTOFSTOCK").count() == 0
