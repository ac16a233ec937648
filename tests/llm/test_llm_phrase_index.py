"""The positional index against plain search (the SQL is in test_oracles)."""

import hashlib

import numpy as np
from llm_helpers import DOCS
from pyspark.sql import functions as F

from keyfold.llm import phrase_index as P

ITEMS = "item_id bigint, text string"


def plain_words(text):
    return [w.decode() for w in P.text_words(text)]


def plain(docs, items, width=10):
    runs = []
    for i, text in items:
        w = plain_words(text)
        runs += [(i, w[a : a + width]) for a in range(max(len(w) - width, 0) + 1)] if w else []
    out = []
    for d, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for i, run in runs:
            for a in range(len(w) - len(run) + 1):
                if w[a : a + len(run)] == run:
                    hit.update(range(a, a + len(run)))
                    found.add(i)
        found = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(["a", "b", "c", "Dé", "e1"], rng.integers(0, 60))) for _ in range(n)]


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in docs], DOCS).withColumn("term", F.lit("t")).withColumn("segment", F.lit(0))
    b = spark.createDataFrame(items, ITEMS).withColumn("run", F.lit(7)).withColumn("terms", F.lit("t"))
    size = how.pop("size", P.SEGMENT)
    runs, of_items = P.windows(b, width=how.pop("width", 10))
    return d, sorted((tuple(r) for r in P.contamination(P.index(d, size=size), runs, of_items, **how).collect()), key=repr)


def test_against_plain_search(spark):
    docs = list(enumerate(texts(60, 1))) + [(None, "a b c"), (7, "A b, c; dÉ dé é"), (7, None), (8, "")]
    items = [(i, t) for i, t in enumerate(texts(12, 2))] + [(50, "a b"), (51, "a b"), (52, "a"), (None, "c c"), (53, None), (54, "?!"), (50, "zz yy")]
    for how in ({}, {"size": 50, "block": 7}):
        _, got = run(spark, docs, items, **how)
        assert got == plain(docs, items)


def test_long_and_empty(spark):
    long = " ".join(["w%d" % (i % 977) for i in range(200_000)])
    docs, items = [(1, long), (2, "w1 w2 w3")], [(1, " ".join("w%d" % i for i in range(960, 977)) + " w0 w1"), (2, "w1 w2 w3")]
    _, got = run(spark, docs, items, size=1000)
    assert got == plain(docs, items)
    assert run(spark, [], items)[1] == []
    assert [g[2] for g in run(spark, docs, [])[1]] == [0, 0]


def test_proximity(spark):
    """Every shortest span, by trying all spans of every document."""
    docs = list(enumerate(texts(40, 3)))
    items = [(0, "a e1 c"), (1, "dé dé b"), (2, "a b c dé e1"), (3, "a zz")]
    for within in (3, 6):
        d, got = run(spark, docs, items, within=within, size=100)
        want = []
        for i, text in docs:
            w, hit, found = plain_words(text), set(), set()
            for k, item in items:
                terms = set(plain_words(item))
                spans = [(a, b) for a in range(len(w)) for b in range(a + 1, min(a + within, len(w)) + 1) if terms <= set(w[a:b])]
                tight = [(a, b) for a, b in spans if not (terms <= set(w[a + 1 : b]) or terms <= set(w[a : b - 1]))]
                for a, b in tight:
                    hit.update(range(a, b))
                    found.add(k)
            want.append((i, len(hit), len(found)))
        assert sorted((g[0], g[2], g[3]) for g in got) == want
        assert any(h for _, h, _ in want)
