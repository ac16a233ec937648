"""Quality classifier: a factorisation machine over hashed words, word shapes,
structure statistics and the length given with the document.

    score = sigmoid( b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ] )

The bracket is the sum-of-squares identity: all pairwise interactions in time
linear in the number of features.  The machine is fitted with AdaGrad on at
most ``SAMPLE`` labelled rows (the smallest by a hash of the id, so reruns
agree); every document is scored whole, in one pass without a shuffle.

Defined cases: null and empty texts have no words and get the score of their
statistics; a null length counts as 0; labels other than 0 and 1 and labels
without a document are left out; without any usable label every score is 0.5;
texts of any length are read whole; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import give_back, spans, utf8, words
from keyfold.session import ship_package

#: The bound on the labelled rows that the fit sees.
SAMPLE = 8192
WORDS, SHAPES, RANK = 1 << 16, 1 << 12, 8

_LOWER, _UPPER, _DIGIT, _MARK, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:128] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _UPPER
_CLASS[97:123] = _LOWER
_LAST = np.where(_CLASS == _MARK, np.arange(256), _CLASS).astype(np.int64)

STATISTICS = 14


@dataclass
class Features:
    """Rows in compressed form: hashed counts, and a dense block of statistics."""

    at: np.ndarray  # n + 1 offsets
    index: np.ndarray
    value: np.ndarray
    stats: np.ndarray


def _unit_counts(doc: np.ndarray, index: np.ndarray, n: int, space: int):
    """Distinct (doc, index) with counts scaled to length 1 per doc."""
    key, count = np.unique(doc * space + index, return_counts=True)
    d = key // space
    norm = np.sqrt(np.bincount(d, weights=count.astype(float) ** 2, minlength=n))
    return d, key % space, (count / norm[d]).astype(np.float32), count


def features(body: np.ndarray, at: np.ndarray, given: np.ndarray) -> Features:
    n = len(at) - 1
    h, start, end, first = words(body, at)
    per = np.diff(first)
    doc = np.repeat(np.arange(n), per)
    d1, i1, v1, c1 = _unit_counts(doc, (h >> np.uint64(48)).astype(np.int64), n, WORDS)
    shape = (_CLASS[body[start]].astype(np.int64) * 5 + _CLASS[body[(start + end) // 2]]) * 128 + _LAST[body[end - 1]]
    d2, i2, v2, _ = _unit_counts(doc, shape, n, SHAPES)
    order = np.argsort(np.concatenate([d1, d2]), kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(d1, minlength=n) + np.bincount(d2, minlength=n))])

    size = np.diff(at).astype(float)
    kinds = np.zeros((n, 7))
    if at[-1] > at[0]:
        text = body[at[0] : at[-1]]
        full = np.flatnonzero(size)
        cuts = at[:-1][full] - at[0]
        code = _CLASS[text]
        for k in range(5):
            kinds[full, k] = np.add.reduceat(code == k, cuts, dtype=np.int64)
        kinds[full, 5] = np.add.reduceat(text == 10, cuts, dtype=np.int64)
        kinds[full, 6] = np.add.reduceat(text == 124, cuts, dtype=np.int64)
    some, some_words = np.maximum(size, 1), np.maximum(per, 1)
    distinct, most = np.bincount(d1, minlength=n), np.zeros(n)
    np.maximum.at(most, d1, c1)
    marked = np.bincount(doc, weights=_CLASS[body[end - 1]] == _MARK, minlength=n) if len(doc) else np.zeros(n)
    echo = np.bincount(doc[1:], weights=(h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), minlength=n)  # a word said twice in a row
    stats = np.column_stack(
        [
            np.log1p(size), np.log1p(per), np.log1p(given), size / some_words, *(kinds[:, k] / some for k in range(1, 5)),
            kinds[:, 5] / some_words, kinds[:, 6] / some_words, distinct / some_words, most / some_words, marked / some_words, echo / some_words,
        ]
    )
    return Features(
        offsets, np.concatenate([i1, WORDS + i2])[order].astype(np.int32), np.concatenate([v1, v2])[order], stats.astype(np.float32)
    )


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def _full(self, f: Features):
        """Sparse rows with the scaled statistics appended to each."""
        n = len(f.at) - 1
        z = np.clip((f.stats - self.centre) / self.scale, -3, 3) / 2
        doc = np.concatenate([np.repeat(np.arange(n), np.diff(f.at)), np.repeat(np.arange(n), STATISTICS)])
        index = np.concatenate([f.index, np.tile(np.arange(STATISTICS) + WORDS + SHAPES, n)])
        value = np.concatenate([f.value, z.ravel()]).astype(np.float32)
        order = np.argsort(doc, kind="stable")
        return f.at[:-1] + np.arange(n) * STATISTICS, index[order], value[order], doc[order]

    def margin(self, at, index, value):
        vx = self.factors[index] * value[:, None]
        one = np.add.reduceat(vx, at)
        two = np.add.reduceat(vx * vx, at)
        linear = np.add.reduceat(self.linear[index] * value, at)
        return self.bias + linear + 0.5 * (one * one - two).sum(1), one

    def score(self, f: Features) -> np.ndarray:
        if len(f.at) == 1:
            return np.zeros(0)
        at, index, value, _ = self._full(f)
        return 1 / (1 + np.exp(-self.margin(at, index, value)[0].astype(float)))


def fit(f: Features, label: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.1, ridge: float = 1e-5, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    size = WORDS + SHAPES + STATISTICS
    m = Machine(
        0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32),
        np.zeros(STATISTICS, np.float32), np.ones(STATISTICS, np.float32),
    )
    if not len(label) or label.min() == label.max():
        m.factors[:] = 0
        return m
    m.centre, m.scale = f.stats.mean(0), np.maximum(f.stats.std(0), 1e-3)
    at, index, value, _ = m._full(f)
    stop = np.append(at[1:], len(index))
    seen_w, seen_v, seen_b = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(label)), max(1, len(label) // batch)):
            length = (stop - at)[rows]
            begin = np.cumsum(length) - length
            take = np.repeat(at[rows] - begin, length) + np.arange(length.sum())
            i, x = index[take], value[take]
            margin, one = m.margin(begin, i, x)
            error = (1 / (1 + np.exp(-margin)) - label[rows]).astype(np.float32) / len(rows)
            doc = np.repeat(np.arange(len(rows)), length)
            kinds, where = np.unique(i, return_inverse=True)
            g = error[doc] * x
            gw = np.bincount(where, g, len(kinds)).astype(np.float32) + ridge * m.linear[kinds]
            pull = g[:, None] * (one[doc] - m.factors[i] * x[:, None])
            gv = np.column_stack([np.bincount(where, pull[:, k], len(kinds)) for k in range(RANK)]).astype(np.float32)
            gv += ridge * m.factors[kinds]
            seen_w[kinds] += gw * gw
            seen_v[kinds] += gv * gv
            seen_b += float(error.sum()) ** 2
            m.linear[kinds] -= rate * gw / np.sqrt(seen_w[kinds])
            m.factors[kinds] -= rate / 4 * gv / np.sqrt(seen_v[kinds])
            m.bias -= rate * float(error.sum()) / seen_b**0.5
    return m


# ------------------------------------------------------------------- Spark


def remainder(key):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        body, at = utf8(batch.column(1))
        given = np.maximum(batch.column(2).fill_null(0).to_numpy(zero_copy_only=False), 0).astype(float)
        f = features(body, at, given)
        cut = [slice(a, b) for a, b in zip(f.at[:-1], f.at[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([f.index[c].tobytes() for c in cut], pa.binary()),
                pa.array([f.value[c].tobytes() for c in cut], pa.binary()),
                pa.array([r.tobytes() for r in f.stats], pa.binary()),
            ],
            names=["label", "index", "value", "stats"],
        )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", given_col: str = "n_chars", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit on the training side of the labels (see ``remainder``), at most ``sample`` rows."""
    ship_package(docs.sparkSession)
    chosen = (
        labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & (remainder(F.col("k")) != 0))
        .orderBy(F.xxhash64("k"), "k", "label").limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"), F.col(given_col).cast("bigint").alias("given"))
    # the right side is bounded by ``sample`` rows of two numbers
    got = (
        rows.join(F.broadcast(chosen), "k").select("label", "text", "given")
        .mapInArrow(_featured, "label int, index binary, value binary, stats binary").toArrow().combine_chunks()
    )
    column = {c: got.column(c).to_pylist() for c in got.column_names}
    # the sample's order must not depend on tasks
    order = sorted(range(got.num_rows), key=lambda r: (column["stats"][r], column["index"][r], column["label"][r]))
    index = [np.frombuffer(column["index"][r], np.int32) for r in order]
    f = Features(
        np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int64),
        np.concatenate([np.zeros(0, np.int32), *index]),
        np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(column["value"][r], np.float32) for r in order)]),
        np.array([np.frombuffer(column["stats"][r], np.float32) for r in order], np.float32).reshape(-1, STATISTICS),
    )
    return fit(f, np.array([column["label"][r] for r in order], np.float32))


def _scores(batch: pa.RecordBatch, model: Machine, text: int, given: int) -> np.ndarray:
    body, at = utf8(batch.column(text))
    size = np.maximum(batch.column(given).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), 0).astype(float)
    parts = [model.score(features(body, at[a : b + 1], size[a:b])) for a, b in spans(at)]
    return np.concatenate([np.zeros(0), *parts])


def scored(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", given_col: str = "n_chars") -> DataFrame:
    """``id, score`` of every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(given_col).cast("bigint").alias("given"))

    def run(batches):
        give_back()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b, model, 1, 2), pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, "id bigint, score double")


def kept(docs: DataFrame, model: Machine, threshold: float, text_col: str = "text", given_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they are."""
    ship_package(docs.sparkSession)
    text, given = docs.columns.index(text_col), docs.columns.index(given_col)

    def run(batches):
        give_back()
        for b in batches:
            yield b.filter(pa.array(_scores(b, model, text, given) >= threshold))

    return docs.mapInArrow(run, docs.schema)
