import zlib

import numpy as np
import public_tokenizers as P
import pytest
from llm_helpers import DOCS, invented

from keyfold.llm import packing as K
from keyfold.llm.tokens import encoder

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    rng, width = np.random.default_rng(seed), 64
    at = np.unique(np.concatenate([rng.integers(1, 900, 120), np.arange(30, 900, 30), [900]]))
    pen = rng.integers(0, 30, len(at))
    cost = {0: 0}
    for p, c in zip(at.tolist(), pen.tolist()):  # every window that may end at p
        cost[p] = c + min(v + (0 if (n := p - q) & (n - 1) == 0 else width - n) for q, v in cost.items() if p - q <= width)
    cuts = [0, *K.best_cuts(at, pen, width)]
    of = dict(zip(at.tolist(), pen.tolist()))
    got = sum(of[b] + (0 if (n := b - a) & (n - 1) == 0 else width - n) for a, b in zip(cuts, cuts[1:]))
    assert cuts[-1] == 900 and got == cost[900] and max(np.diff(cuts)) <= width


def check(rows, got):
    tok = encoder(PATH).tok
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for i, docs in want.items():
        if len(docs) > 1:
            continue
        ids, at = docs[0], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    total = padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= K.WIDTH
        total += at
        padding += 0 if at & (at - 1) == 0 else K.WIDTH - at
    assert total == sum(len(d) for docs in want.values() for d in docs)
    return padding / max(total, 1)


def test_pieces(spark):
    rows = [(i, t) for i, t in enumerate(invented(300, low=5, high=900))]
    rows += [(1000, None), (1001, ""), (None, "null id"), (1002, "x" * 60000), (1003, "One. Two. " * 9000), (1004, "t"), (1004, "t")]
    schema = DOCS + ", k int, start int, offset int"
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, 3) for i, t in rows], schema).repartition(3)
    assert check(rows, K.pack(df, PATH).collect()) < 0.02


def test_empty_and_single(spark):
    assert K.pack(spark.createDataFrame([], DOCS), PATH).count() == 0
    got = K.pack(spark.createDataFrame([(1, None, "en", "s", 0)], DOCS), PATH).collect()
    assert [(r["doc_id"], r["length"], r["doc_tokens"]) for r in got] == [(1, 1, 1)]


def test_runs_join_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(0)
    stops = np.zeros(100, bool)
    stops[7] = True
    sizes = rng.integers(1, 400, 200)
    ids, ends = rng.integers(0, 100, sizes.sum()).astype(np.uint32), np.cumsum(sizes)
    for last in (False, True):
        columns, used = K.pack_run(list(range(200)), ids, ends, stops, 256, last, 5)
        doc, start, length, crc, doc_tokens, seq, offset = columns
        assert np.array_equal(np.bincount(doc.astype(int), length).astype(int), sizes)
        assert seq.min() == 5 and seq.max() == 4 + used
