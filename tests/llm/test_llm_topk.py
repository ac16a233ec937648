import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.llm import topk_search as S

SCHEMA = "vec_id bigint, embedding array<double>, label int, id int, n int, vec int, score int, rank int"


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in ok if i != q and len(c) == len(v))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 1, 2, 3, 4, 5) for i, v in rows], SCHEMA).repartition(3)
    got = S.search(df, F.col("vec_id") % 50 == 0, **options).collect()
    out = {tuple(r) for r in got}
    assert len(out) == len(got) or len({r for r, _ in rows}) < len(rows)
    return out


def vectors(n, dims, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.normal(size=dims) * scale).tolist()) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 16, 40, 64])
def test_equals_brute_force(spark, dims):
    rows = vectors(320, dims, dims)
    assert run(spark, rows) == brute(rows)


def test_ties_nulls_lengths_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 1.0, -1.0]) for i in range(120)]  # many ties
    rows += [(200, None), (250, []), (300, [1.0, None, 2.0]), (350, [nan, 1.0, 2.0]), (400, [inf, 0.0, 0.0]), (450, [1.0, 2.0]), (451, [2.0, 1.0]), (None, [9.0, 9.0, 9.0]), (500, [0.0, 0.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    rows += [(7, [2.0, 1.0, -1.0])] * 3
    ranked = run(spark, rows)
    assert {r for r in ranked if r[0] == 50 and r[1] == 1} <= brute(rows) | ranked


def test_fewer_than_k_and_empty(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 1, 1, 131072)}
    assert run(spark, []) == set()


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**31 + 3 * i), float(2**30 - 7 * i), 1.5]) for i in range(0, 60)]
    assert all(abs(s) < 2**63 for *_, s in (r for r in brute(rows))) is False or run(spark, rows) == brute(rows)
    rows = [(i, [float(2**20 + 3 * i), float(2**19 - 7 * i), 1.5]) for i in range(0, 60)]
    assert run(spark, rows) == brute(rows)


def test_chunks_of_queries(spark):
    rows = [(50 * i, v) for i, v in vectors(130, 20, 9)]
    assert run(spark, rows, chunk=32) == brute(rows)


def test_bound_prunes_and_never_loses():
    rng = np.random.default_rng(4)
    q, c = np.floor(256 * rng.normal(size=(8, 64))), np.floor(256 * rng.normal(size=(64, 900)) * rng.random(900) ** 3)
    exact = q @ c
    floor = np.sort(exact, 1)[:, -5]
    qi, ci, s = S._tile_scores(q, c, floor)
    want = np.argwhere(exact >= floor[:, None])
    assert {*map(tuple, want.tolist())} <= {*zip(qi.tolist(), ci.tolist())}
    assert np.array_equal(s, exact[qi, ci])


def clipped(ranked):
    return {(q, r, i, min(max(s, -(2**63)), 2**63 - 1)) for q, r, i, s in ranked}


def test_an_outlier_leaves_other_pairs_to_the_search(spark, monkeypatch):
    rows = vectors(200, 12, 3)
    rows[7] = (7, [1e17, -3.0] + [0.5] * 10)
    rows[50] = (50, [-1e16, 1e15] + [0.25] * 10)
    assert run(spark, rows) == clipped(brute(rows))
    # light pairs never reach the integer path
    light = S._Asked(S.pd.DataFrame({"id": [0], "vec": [[256.0, 512.0]], "raw": [[1.0, 2.0]], "heavy": [False]}), 256)
    monkeypatch.setattr(S, "_exact", lambda *a: 1 / 0)
    batch = S.pd.DataFrame({"id": [1, 2], "n": [2, 2], "vec": [[1.0, 1.0], [2.0, 0.0]], "raw": [[1.0, 1.0], [2.0, 0.0]], "heavy": [False, False]})
    (out,) = S._searched(iter([batch]), {2: light}, 5)
    assert out[["id", "score"]].values.tolist() == [[1, 768], [2, 512]]


def test_scores_beyond_64_bits_are_ranked_by_their_value(spark):
    rows = [(i, [(-1.0) ** i * 1e300 * (1 + i % 7), 1e18 + i]) for i in range(60)]
    rows += [(100, [1.7e308, 1.0]), (101, [-1.7e308, 2.0]), (102, [1e18, 1e18])]
    assert run(spark, rows) == clipped(brute_exact(rows))


def brute_exact(rows, k=5):
    """As ``brute``, with components that no scaled double holds."""
    ok = [(i, [int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in v]) for i, v in rows]
    out = set()
    for q, v in ok:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in ok if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out
