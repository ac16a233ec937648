from collections import defaultdict

import numpy as np
import pytest
from llm_helpers import DOCS, WORD, invented

from keyfold.llm import mixing as M


def test_targets():
    assert M.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    out = M.targets([10, 1000, 500, 10])  # 10 words stop at 30
    assert out[0] == out[3] == 30 and np.isclose(sum(out), 1520) and np.isclose(out[1] / out[2], 2)
    assert M.targets([]) == [] and M.targets([0, 0]) == [0, 0]
    assert np.isclose(sum(M.targets([5, 0, 7])), 12)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(n):
    got = M.permuted(np.arange(n), n, 12345)
    assert sorted(got.tolist()) == list(range(n))
    if n > 50:
        assert (got != np.arange(n)).mean() > 0.8 and not np.array_equal(got, M.permuted(np.arange(n), n, 54321))


def test_shards_share_out_every_slot_once():
    slots = np.array([9000, 0, 1, 30000, 777])
    shards = -(-int(slots.sum()) // M.SHARD)
    counts = [M.shard_counts(slots, k, shards, M.SHARD, 1) for k in range(shards)]
    assert np.array_equal(sum(c for c, _ in counts), slots)
    run = np.zeros_like(slots)
    for k, (have, before) in enumerate(counts):
        assert np.array_equal(before, run)
        run = run + have
        assert have.sum() == M.SHARD or k == shards - 1


def docs(spark, n=400):
    rng = np.random.default_rng(1)
    texts = invented(n, seed=8)
    sources = ["b", "a", None, "ä", "zz"]
    weights = [0.5, 0.3, 0.1, 0.07, 0.03]
    rows = [(int(i), t, "en", sources[rng.choice(5, p=weights)], len(t)) for i, t in enumerate(texts)]
    rows += [(None, "null id here", "en", "a", 12), (3, None, "en", "a", 0), (5, "", "en", "b", 0), (7, "twice the same", "en", "b", 3), (7, "twice the same", "en", "b", 3), (1000, "big " * 30000, "en", "zz", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_mix_meets_targets_and_reruns_agree(spark):
    df = docs(spark)
    got = M.mix(df).toPandas()
    size = df.toPandas()
    assert len(got) == len(size)
    total = defaultdict(int)
    for r in size.itertuples():
        total[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, M.targets([total[s] for s in order])))
    by = got.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert sorted(zip(by.source_size, by.target.round(6))) == sorted((total[s], round(goal[s], 6)) for s in order)
    assert (abs(by.taken - by.target) <= np.maximum(2 * M.BLOCK, 0.02 * by.target)).all()
    assert (got.taken <= 3 * got["size"]).all()
    again = M.mix(df.repartition(7)).toPandas()
    key = ["id", "size", "taken"]
    assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))


def test_documents_hold_the_words_taken(spark):
    df = docs(spark)
    plan = M.mix(df).toPandas()
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    out = out.toPandas()
    have = out.text.map(lambda t: len(WORD.findall(t))).groupby(out.doc_id.fillna(-1)).sum()
    want = plan.groupby(plan.id.fillna(-1)).taken.sum()
    assert {k: v for k, v in want.items() if v} == have.to_dict()
    first = {r.doc_id: r.text for r in df.toPandas().itertuples()}
    for r in out[(out.doc_id >= 0) & (out.doc_id != 7)].itertuples():
        assert set(WORD.findall(r.text)) <= set(WORD.findall(first[r.doc_id] or "")) or r.doc_id in (3, 5)


def test_empty_and_clashing_columns(spark):
    schema = DOCS + ", size int, block int, times int, position int, id int, mark int, part int"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    assert M.mixed_documents(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a b c", "en", "s", 5, *[9] * 7)], schema)
    assert M.mix(df).first()["taken"] == 3
    assert M.mixed_documents(df).collect() == df.collect()


def test_tiny_sources_come_near_their_targets(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50)), "en", f"s{i:02d}", 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["id"]: r for r in M.mix(df).collect()}
    for i in range(60):
        assert got[i]["target"] == (93.75, 37.5, 18.75)[i % 3]
        assert abs(got[i]["taken"] - got[i]["target"]) <= 1
    out = M.mixed_documents(df).toPandas()
    have = out.text.map(lambda t: len(WORD.findall(t))).groupby(out.doc_id).sum()
    assert have.to_dict() == {i: got[i]["taken"] for i in got}


def test_slots_hold_the_target_to_the_word():
    sizes = np.array([50, 1000, 0, 128, 129, 7, 10**9])
    for goal in (np.array(M.targets(sizes.tolist())), 3.0 * sizes, 0.0 * sizes, 1.0 * sizes):
        blocks = -(-sizes // M.BLOCK)
        slots, last = M.slot_numbers(goal, sizes, blocks)
        mean = sizes / np.maximum(blocks, 1)
        assert np.allclose((slots - (slots > 0) + np.where(slots > 0, last, 0)) * mean, goal, rtol=1e-6, atol=1e-5)
        assert (slots <= 3 * blocks).all()


def test_columns_named_as_the_operator_names_its_own(spark):
    own = ["_spans", "_i", "_key", "_id", "_mark", "_m", "_by", "_nth", "_source", "row", "spans", "low", "high", "words", "times", "start"]
    df = spark.createDataFrame([(1, "a b c", "en", "s", 5, *range(len(own)))], DOCS + "".join(f", {c} int" for c in own))
    assert M.mixed_documents(df).collect() == df.collect()
    assert M.mix(df).first()["taken"] == 3
