"""Many ranges per key on real data equal the plain per-key window (and so,
through test_oracle, DuckDB)."""

import pytest

from conftest import SF01
from keyfold.operators import carts, reserve, scan
from keyfold.plans import params as P
from keyfold.sources import testdata as td


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("profile", [P.UNIT, P.ANY], ids=["unit", "any"])
def test_many_ranges_equal_single(spark, profile):
    d = td.domain_events(td.table(spark, SF01, "events"), profile.restock_qty)
    single_s = reserve.reserve(d, profile, chunking=scan.Chunking())
    single_r = carts.receipts(single_s, d, profile, chunking=scan.Chunking())
    # 100 items and 150 users over 300 ranges: every key spans several
    hot = scan.Chunking(ranges=300)
    hot_s = reserve.reserve(d, profile, chunking=hot)
    hot_r = carts.receipts(hot_s, d, profile, chunking=hot)
    cols_s = ["event_id", "status", "stock_after"]
    cols_r = ["event_id", "n_items", "receipt"]
    assert _rows(hot_s, cols_s) == _rows(single_s, cols_s)
    assert _rows(hot_r, cols_r) == _rows(single_r, cols_r)
