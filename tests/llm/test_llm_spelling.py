"""Spelling variants against all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
from llm_helpers import DOCS
from pyspark.sql import functions as F

from keyfold.llm import spelling
from keyfold.llm.common import table

SF = "/root/testdata/sf0.001"


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    i = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :]


def plain(rows, period=31):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % period == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 7:
                count[w] += 1
    n = {w: c for w, c in count.items() if c >= 2}
    at = {}
    for w in n:  # words with one code point less meet their near words
        for k in range(len(w)):
            at.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    links = {w: set() for w in n}
    for w in n:
        meets = at.get(w, set()) | {v for k in range(len(w)) for v in at[w[:k] + w[k + 1 :]]}
        meets |= {w[:k] + w[k + 1 :] for k in range(len(w))} & n.keys()
        links[w] = {v for v in meets if near(w, v)}
    form = {}
    for w, near_words in links.items():
        best = min(near_words, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(links[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    got = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r[0]: tuple(r[1:]) for r in got}
    assert len(out) == len(got)
    return out


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    got = rows_of(spelling.variants(spelling.counted(docs, typos=31)))
    assert got == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert any(v[0] for v in got.values())


def test_chains_edges_and_odd_rows(spark):
    chain = " ".join(["abcdefgh"] * 2 + ["abcdefgx"] * 20 + ["abcdefyx"] * 200 + ["abcdezyx"] * 2000)
    odd = "ÀÉÈÊËÌÍ ÀÉÈÊËÌÍ àÉÈÊËÌÍ àÉÈÊËÌÍ a×b÷cdefg a×b÷cdefg " + ("q" * 5000 + " ") * 3 + ("q" * 4999 + " ") * 2
    rows = [(None, chain, None, None, None), (1, odd, "x", "s", 1), (1, odd, "x", "s", 1), (2, None, None, None, 0), (3, "", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    got = rows_of(spelling.variants(spelling.counted(docs, typos=31)))
    assert got == plain([(r[0], r[1]) for r in rows])
    assert got["abcdefgh"][1] == "abcdezyx"
    assert rows_of(spelling.variants(spelling.counted(docs.where("1 = 0"), typos=31))) == {}


def test_hot_chunks_are_cut_not_capped(spark):
    rng = np.random.default_rng(5)
    words = {"commonprefix" + "".join(rng.choice(list("abcd"), 4)) for _ in range(150)}
    words |= {"".join(rng.choice(list("abcd"), 4)) + "commonending" for _ in range(150)}
    words |= {w[:k] + w[k + 1 :] for w in list(words)[:60] for k in (0, 5, 13)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = {tuple(sorted((x, y), key=lambda w: (len(w), w))) for x in words for y in words if near(x, y)}
    for group in (4, 10_000):
        got = [tuple(r) for r in spelling.near_pairs(df, group=group).collect()]
        assert len(got) == len(set(got)) and set(got) == want
