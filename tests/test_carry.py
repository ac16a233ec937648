"""The range carry against a plain fill, with runs of nulls over many ranges."""

import random

import pytest

from keyfold.operators import rangescan


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_carry_over_ranges(spark, ranges):
    rnd = random.Random(ranges)
    rows = []
    for key in range(3):
        for i in range(400):
            # one key is almost all null, one begins with nulls
            p = 0.004 if key == 0 else 0.0 if key == 1 and i < 150 else 0.3
            rows.append((key, i, f"v{key}-{i}" if rnd.random() < p else None))
    want, held = {}, {}
    for key, i, v in rows:
        held[key] = v if v is not None else held.get(key)
        want[key, i] = held[key]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, v string")
    got = {(r.k, r.i): r.v for r in rangescan.range_carry(df, ["k"], "v", ranges, ("i",)).collect()}
    assert got == want


def test_carry_of_nothing(spark):
    df = spark.createDataFrame([], "k long, i long, v string")
    assert rangescan.range_carry(df, ["k"], "v", 4, ("i",)).collect() == []
