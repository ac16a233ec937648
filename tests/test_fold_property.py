"""Property: the block-vectorized fold equals the plain sequential fold for
any sequence, initial stock and batch split (pure pandas, no Spark)."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from keyfold.operators import reserve

event = st.tuples(
    st.integers(0, 3),  # item
    st.booleans(),  # is add
    st.integers(-3, 12),  # requested (adds) / restock amount
)


@settings(max_examples=150, deadline=None)
@given(st.lists(event, min_size=1, max_size=400), st.integers(0, 60), st.lists(st.integers(1, 399), max_size=6))
def test_block_fold_equals_sequential(events, init, cuts):
    events = sorted(events, key=lambda e: e[0])  # rows arrive sorted by item
    n = len(events)
    pdf = pd.DataFrame({
        "event_id": np.arange(n), "ts": pd.to_datetime(np.arange(n), unit="s"), "ts_ms": np.arange(n),
        "kind": ["add" if a else "restock" for _, a, _ in events], "user_id": 1,
        "item_id": [i for i, _, _ in events],
        "requested": pd.array([q if a else None for _, a, q in events], dtype="Int32"),
        "restock": pd.array([None if a else abs(q) for _, a, q in events], dtype="Int32"),
        "_S": init, "_add": [a for _, a, _ in events],
    })
    edges = sorted({c for c in cuts if c < n})
    bounds = [0, *edges, n]
    batches = [pdf.iloc[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]
    out = pd.concat(list(reserve._fold_partition(iter(batches))))
    stock, want = {}, []
    for item, is_add, q in events:
        s = stock.get(item, init)
        if is_add:
            g = s >= q
            s = s - q if g else s
        else:
            g, s = False, s + abs(q)
        stock[item] = s
        want.append((g, s))
    assert list(zip(out["_granted"].tolist(), out["stock_after"].tolist())) == want


row = st.tuples(st.integers(0, 4), st.integers(-1000, 1000))


@settings(max_examples=150, deadline=None)
@given(st.lists(row, min_size=1, max_size=300), st.lists(st.integers(1, 299), max_size=6))
def test_range_pass_equals_plain_prefix(rows, cuts):
    from unittest import mock

    from keyfold.operators import rangescan

    rows = sorted(rows, key=lambda r: r[0])
    n = len(rows)
    pdf = pd.DataFrame({"k": [k for k, _ in rows], "_vx": [v for _, v in rows], "_vc": 1})
    edges = sorted({c for c in cuts if c < n})
    bounds = [0, *edges, n]
    batches = [pdf.iloc[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]
    fn = rangescan._prefix_fn(["k"], ["_vx", "_vc"], {"_vc"}, "_vx")
    with mock.patch("pyspark.TaskContext.get") as tc:
        tc.return_value.partitionId.return_value = 0
        out = pd.concat(list(fn(iter(batches))))
    acc, cnt, low, want = {}, {}, {}, []
    for k, v in rows:
        prev_low = low.get(k)
        acc[k] = acc.get(k, 0) + v
        low[k] = acc[k] if prev_low is None else min(prev_low, acc[k])
        want.append((acc[k], cnt.get(k, 0), low[k], prev_low))
        cnt[k] = cnt.get(k, 0) + 1
    got = [(a, c, m, None if pd.isna(p) else int(p)) for a, c, m, p in
           zip(out["_l_vx"], out["_l_vc"], out["_lmin"], out["_lmin_prev"])]
    assert got == want
