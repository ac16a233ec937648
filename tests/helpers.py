"""Literal event frames and a plain-Python reference fold for tests."""

from __future__ import annotations

import datetime as dt

BASE = dt.datetime(2024, 1, 1)


def ev(spark, rows):
    """rows: (event_id, second, kind, user_id, item_id, quantity)."""
    data = [
        (eid, BASE + dt.timedelta(seconds=sec), int(sec * 1000), kind, user, item, q)
        for eid, sec, kind, user, item, q in rows
    ]
    return spark.createDataFrame(
        data,
        "event_id long, ts timestamp_ntz, ts_ms long, kind string, user_id long, item_id long, quantity int",
    )


def python_fold(rows, init, demand="unit", restock_applies=True):
    """Reference semantics: all-or-nothing per item in (ts, event_id) order.

    Returns {event_id: (status, stock_after)} for add and applied restock rows.
    """
    out, stock = {}, {}
    for eid, sec, kind, user, item, q in sorted(rows, key=lambda r: (r[1], r[0])):
        if item is None or kind not in ("add", "restock"):
            continue
        if kind == "restock" and not restock_applies:
            continue
        s = stock.get(item, init)
        if kind == "add":
            req = (q if q < 0 else 1) if demand == "unit" else q
            if s >= req:
                s -= req
                out[eid] = ("INSTOCK", s)
            else:
                out[eid] = ("OUTOFSTOCK", s)
        else:
            s += q
            out[eid] = (None, s)
        stock[item] = s
    return out
