"""Phrase mining: tries against dictionaries, small rows against plain counts
(the SQL over whole tables is in test_oracles)."""

import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import DOCS
from pyspark.sql import functions as F

from keyfold.llm import phrase_mining as M


def plain(rows, least, top, longest=4):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for a in range(len(w) - m + 1):
                    key = (lang, *w[a : a + m])
                    f[key] = f.get(key, 0) + 1
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        if any(
            100 * cand[q] >= 80 * a
            for q in cand
            if q[0] == lang and len(q) > len(p) and any(q[i : i + len(w)] == w for i in range(1, len(q)))
        ):
            continue
        cuts = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, l, r = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, n[lang], -s)
        for lang, rows in out.items()
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)
    )


def texts(n, seed):
    rng = np.random.default_rng(seed)
    vocab = ["New", "york", "Cité", "of", "the", "\x00", "a-b", " x"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]
    return ["".join(str(rng.choice(vocab, p=[.3, .25, .1, .1, .1, .05, .05, .05])) + str(rng.choice(marks)) for _ in range(rng.integers(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"shard": 64, "slice_": 7}])
def test_against_plain_counts(spark, how):
    langs = ["en", None, "und", "fr"]
    rows = [(langs[i % 4], t) for i, t in enumerate(texts(120, 4))] + [("en", None), (None, ""), ("en", " ".join(["new york"] * 3000))]
    docs = spark.createDataFrame([(i, t, lang, None, 1) for i, (lang, t) in enumerate(rows)], DOCS).repartition(3)
    docs = docs.withColumn("word", F.lit(1)).withColumn("n", F.lit(1)).withColumn("p", F.lit(1)).withColumn("shard", F.lit(1))
    got = sorted(tuple(r) for r in M.collocations(docs, least=5, top=40, **how).collect())
    assert got == plain(rows, 5, 40)


def test_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert M.collocations(empty).collect() == []
    few = spark.createDataFrame([(1, "a b a b", "en", "s", 1)], DOCS)
    assert M.collocations(few).collect() == []


@pytest.mark.parametrize("depth,n,alphabet", [(2, 1, 3), (2, 5000, 300), (3, 4000, 60), (4, 3000, 2000), (4, 200, 3)])
def test_trie(depth, n, alphabet):
    rng = np.random.default_rng(depth * n)
    heavy = (rng.pareto(1.0, (n, depth)) * 3).astype(np.int64) % alphabet + 1
    phrases = np.unique(heavy, axis=0)[rng.permutation(len(np.unique(heavy, axis=0)))] * 7
    trie = M.Trie(phrases)
    rows = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    assert sorted(trie.accept[trie.accept >= 0].tolist()) == list(range(len(phrases)))
    body = ((rng.pareto(1.0, 20_000) * 3).astype(np.int64) % (alphabet + 2) * 7).astype(np.int32)
    body = np.concatenate([body, phrases.ravel().astype(np.int32)])
    state = trie.walk(body)
    want = [rows.get(tuple(body[i : i + depth].tolist()), -1) for i in range(len(body) - depth + 1)]
    assert np.where(state >= 0, trie.accept[state], -1).tolist() == want
    assert len(trie.check) < 6 * len(phrases) * depth + 8 * alphabet + 200


def test_decimal_scores(spark):
    """Products beyond 64 bits stay exact."""
    big = spark.range(1).select(F.lit(9_000_000_000_000_000_000).alias("a"), F.lit(9_000_000_000_000_000_001).alias("l"), F.lit(9_100_000_000_000_000_000).alias("r"))
    got = big.select(F.expr(M.SCORE.format(2_000_000))).first()[0]
    assert got == 2_000_000 * 9_000_000_000_000_000_000 // (9_000_000_000_000_000_001 + 9_100_000_000_000_000_000)


def shares(batches):
    """The counts that batches of shares hold, and how many rows those are."""
    got, rows = Counter(), 0
    for b in batches:
        rows += b.num_rows
        for bucket, keys, counts in zip(*(b.column(i).to_pylist() for i in range(3))):
            for k, n in zip(M._unplaned(keys).tolist(), M._unplaned(counts).tolist()):
                got[k >> 32, k & 0xFFFFFFFF] += n
    return got, rows


@pytest.mark.parametrize("held,stretch", [(10**6, 10**6), (50, 7)])
def test_a_task_hands_on_a_row_per_bucket(monkeypatch, held, stretch):
    import pyarrow as pa

    monkeypatch.setattr(M, "HELD", held)
    monkeypatch.setattr(M, "STRETCH", stretch)
    rng = np.random.default_rng(5)
    bodies = [rng.integers(0, 6, n).astype(np.int32) for n in (3000, 1, 2, 40)]
    batch = pa.record_batch([pa.array([b.tobytes() for b in bodies], pa.binary())], names=["body"])
    phrases = np.array([(a, b) for a in range(1, 5) for b in range(1, 6)])

    class Sent:
        value = (M.Trie(phrases), True)

    want, row = Counter(), {tuple(p): i for i, p in enumerate(phrases.tolist())}
    for b in map(np.ndarray.tolist, bodies):
        for i in range(len(b) - 1):
            if (p := row.get((b[i], b[i + 1]))) is not None:
                want[p, 0] += 1
                if i + 2 < len(b) and (b[i + 1], b[i + 2]) in row:
                    want[p, b[i + 2]] += 1
    got, rows = shares(M._counter(Sent, True, 3)(iter([batch])))
    assert got == want
    assert rows <= 3 or held == 50
    pairs, rows = shares(M._pairs(3)(iter([batch])))
    assert pairs == Counter((x, y) for b in bodies for x, y in zip(b.tolist(), b.tolist()[1:]) if x and y)
    assert rows <= 3 or held == 50
