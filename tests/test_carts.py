from helpers import ev
from keyfold.operators import carts, reserve, scan
from keyfold.profiles import get_profile

EMB = get_profile("embedded", initial_stock=10)
REM = get_profile("remote", initial_stock=10, restock_qty=5)


def _receipts(spark, rows, profile, chunk_ms=None):
    d = ev(spark, rows)
    s = reserve.reserve(d, profile, chunking=scan.Chunking(None))
    return {r.event_id: (r.n_items, r.receipt) for r in carts.receipts(s, d, profile, scan.Chunking(chunk_ms)).collect()}


ROWS = [
    (1, 1, "checkout", 5, None, None),  # checkout with no basket
    (2, 2, "add", 5, 1, 3),
    (3, 3, "add", 5, 2, 2),
    (4, 4, "checkout", 5, None, None),
    (5, 5, "checkout", 5, None, None),  # two checkouts in a row
    (6, 6, "add", 5, 1, 4),  # add after a checkout
    (7, 7, "checkout", 5, None, None),
    (8, 8, "add", 6, 1, 1),  # open cart, never checked out
]


def test_embedded_clear_rules(spark):
    for chunk in (None, 1500):
        got = _receipts(spark, ROWS, EMB, chunk)
        # unit demand: each add asks for 1
        assert got == {4: (2, "User 5 receipt: 2 items"), 7: (1, "User 5 receipt: 1 items")}


def test_remote_running_rules(spark):
    got = _receipts(spark, ROWS, REM)
    assert got == {
        1: (0, "Total items: 0"),
        4: (5, "Total items: 5"),
        5: (5, "Total items: 5"),
        7: (9, "Total items: 9"),
    }


def test_refused_add_not_in_basket(spark):
    p = EMB.with_(initial_stock=1)
    rows = [(1, 1, "add", 5, 1, 1), (2, 2, "add", 6, 1, 1), (3, 3, "checkout", 6, None, None),
            (4, 4, "checkout", 5, None, None)]
    got = _receipts(spark, rows, p)
    assert got == {4: (1, "User 5 receipt: 1 items")}  # user 6 had no granted add


def test_confirms_for_both_outcomes_without_status(spark):
    p = EMB.with_(initial_stock=1)
    rows = [(1, 1, "add", 5, 1, 7), (2, 2, "add", 6, 1, 7)]
    d = ev(spark, rows)
    c = carts.add_confirms(reserve.reserve(d, p)).orderBy("event_id").collect()
    assert [r.quantity for r in c] == [1, 1]
    assert "status" not in c[0].asDict()
    assert c[0].value == '{"userId":"5","itemId":"1","quantity":1,"publishTimestamp":"1000"}'


def test_echo_confirms_simple(spark):
    rows = [(1, 1, "add", 5, 1, 7)]
    c = carts.echo_confirms(ev(spark, rows)).collect()
    assert c[0].quantity == 7


def test_basket_items_and_lines(spark):
    d = ev(spark, ROWS)
    s = reserve.reserve(d, REM)
    items = {(r.user_id, r.cart_no, r.item_id): r.quantity for r in carts.basket_items(s, d).collect()}
    assert items == {(5, 1, 1): 3, (5, 1, 2): 2, (5, 3, 1): 4, (6, 0, 1): 1}
    lines = {r.event_id: r.receipt for r in carts.receipt_lines(s, d).collect()}
    assert lines[4] == "User 5 receipt: \nItem: 1, Quantity: 3\nItem: 2, Quantity: 2\n"
    assert lines[7] == "User 5 receipt: \nItem: 1, Quantity: 4\n"


def test_cart_positions(spark):
    pos = {r.event_id: (r.cart_no, r.position) for r in carts.cart_positions(ev(spark, ROWS)).collect()}
    assert pos == {2: (1, 1), 3: (1, 2), 6: (3, 1), 8: (0, 1)}


def test_basket_with_removals_and_maps(spark):
    rows = [(1, 1, "add", 5, 1, 3), (2, 2, "add", 5, 1, -2), (3, 3, "add", 5, 1, -4),
            (4, 4, "add", 5, 1, 2), (5, 5, "add", 5, 2, 1)]
    got = {r.event_id: r.basket_qty for r in carts.basket_with_removals(ev(spark, rows), chunking=scan.Chunking(1500)).collect()}
    assert got == {1: 3, 2: 1, 3: 0, 4: 2, 5: 1}  # entry dropped at <= 0, then added anew
    d = ev(spark, ROWS)
    m = {(r.user_id, r.cart_no): dict(r.basket)
         for r in carts.basket_maps(carts.basket_items(reserve.reserve(d, REM), d)).collect()}
    assert m[(5, 1)] == {1: 3, 2: 2}
