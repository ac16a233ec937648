"""Packing by order-preserving dynamic programming.

Token streams are cut into windows of at most ``width`` tokens, in order.
Windows end at document ends (free), sentence ends (``SENTENCE`` a cut) or,
where neither is near, inside a sentence (``INSIDE`` a cut).  A window costs
its padding (none where its length is a power of two) plus the penalty of the
cut that closes it; the programme minimises the sum over a run of documents:

    best(j) = penalty(j) + min( width - (p_j - p_i) + best(i)  for p_j - p_i <= width,
                                best(i)                         for p_j - p_i a power of two )

The first minimum slides over i with ``best(i) - ... + p_i`` in a monotone
queue, so a run takes linear time.  Each partition of the input is a stream of
its own and ends with candidate cuts at every token of its last two windows,
so that its tail falls into powers of two.  Nothing is shuffled.

Defined cases: a null text is empty (one piece: the end id); a null id stays
null; rows are packed in the order of the input partition, repeats included;
texts of any length are cut as often as needed; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.session import ship_package

WIDTH = 2048
#: Pieces that a packing worker remembers.
PIECES = 1_300_000
#: Penalties of a cut, in tokens of padding.
SENTENCE, INSIDE = 4, 24
#: Least distance of two sentence cuts, and of cuts inside a sentence.
GAP, STRIDE = 24, 256
#: Tokens of one run of the programme.
RUN = 1 << 20

COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cut_points(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, width: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts (positions above 0, the last is the run's end) and their
    penalties.  ``ends``: document ends; ``stops``: per id, ends a sentence."""
    n = int(ends[-1])
    pen = np.full(n + 1, -1, np.int16)
    pen[STRIDE::STRIDE] = INSIDE
    close = np.flatnonzero(stops[ids]) + 1
    if len(close):  # one sentence end of every GAP tokens is enough
        close = close[np.unique(close // GAP, return_index=True)[1]]
        pen[close] = SENTENCE
    if last:
        tail = pen[max(1, n - 2 * width) :]
        tail[tail < 0] = INSIDE
    pen[ends] = 0
    pen[0] = -1
    at = np.flatnonzero(pen >= 0)
    return at, pen[at]


def best_cuts(at: np.ndarray, pen: np.ndarray, width: int) -> list[int]:
    """The window ends of least total cost."""
    n = len(at)
    pos, penalty = [0, *at.tolist()], [0, *pen.tolist()]
    cost, back = [0] * (n + 1), [0] * (n + 1)
    # where a window of a power of two could begin: index of that cut, or -1
    powers = [p for p in (1 << k for k in range(width.bit_length())) if p < width]
    full = np.concatenate([[0], at])
    starts = []
    for p in powers:
        k = np.searchsorted(full, at - p)
        hit = (k < n + 1) & (full[np.minimum(k, n)] == at - p)
        starts.append(np.where(hit, k, -1))
    rows, cols = np.nonzero(np.array(starts).T >= 0)
    table = np.array(starts).T[rows, cols].tolist()
    of = np.searchsorted(rows, np.arange(n + 1)).tolist()
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, index), costs rising
    for j in range(1, n + 1):
        pj = pos[j]
        while pos[queue[0][1]] < pj - width:
            queue.popleft()
        value, i = queue[0]
        value += width - pj
        for k in table[of[j - 1] : of[j]]:
            if cost[k] <= value:
                value, i = cost[k], k
        cost[j] = value = value + penalty[j]
        back[j] = i
        key = value + pj
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def pack_run(docs: list[tuple], ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, width: int, last: bool, first_sequence: int) -> tuple[list[tuple], int]:
    """The pieces of one run of documents; ``docs``: their keys."""
    at, pen = cut_points(ids, ends, stops, width, last)
    cuts = np.array(best_cuts(at, pen, width), np.int64)
    borders = np.union1d(cuts, ends)
    begins = np.concatenate([[0], borders[:-1]])
    doc = np.searchsorted(ends, begins, "right")
    seq = np.searchsorted(cuts, begins, "right")
    doc_start, seq_start = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], cuts[:-1]])
    data = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), borders.tolist())]
    return [
        np.array(docs, object)[doc], begins - doc_start[doc], borders - begins, np.array(crc, np.int64),
        (ends - doc_start)[doc], first_sequence + seq, begins - seq_start[seq],
    ], len(cuts)


def _packed(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int, pieces: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    from keyfold.llm.common import give_back, spans, utf8
    from keyfold.llm.tokens import encoder

    give_back(encoders=True)
    enc = encoder(path, pieces)
    stops = sentence_stops(enc.tok, end_id)
    sequence = TaskContext.get().partitionId() << 40
    keys, parts, sizes, held = [], [], [], 0

    def run(last: bool):
        nonlocal sequence, keys, parts, sizes, held
        columns, used = pack_run(keys, np.concatenate(parts), np.cumsum(sizes), stops, width, last, sequence)
        sequence += used
        keys, parts, sizes, held = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in COLUMNS.split(", ")])

    for batch in batches:
        # a batch may hold many texts: a megabyte at a time becomes Python strings
        for a, b in spans(utf8(batch.column(1))[1], 1 << 20):
            texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
            flat, counts = enc.encode(texts)
            stop = np.cumsum(counts)
            flat = np.insert(flat, stop, end_id)  # the end id behind each document
            if held and held + len(flat) > RUN:
                yield run(False)
            keys += batch.column(0).slice(a, b - a).to_pylist()
            parts.append(flat.astype(np.uint32))
            sizes += (counts + 1).tolist()
            held += len(flat)
    if keys:
        yield run(True)


def sentence_stops(tok, end_id: int) -> np.ndarray:
    """Per id: does its text close a sentence or a line?"""
    vocab = tok.get_vocab()
    out = np.zeros(max([end_id, *vocab.values()]) + 1, bool)
    for text, i in vocab.items():
        if text.rstrip('"\')').endswith((".", "!", "?", "Ċ", "\n")):
            out[i] = True
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, width: int = WIDTH, pieces: int = PIECES) -> DataFrame:
    """One row per piece; see ``COLUMNS``."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(lambda it: _packed(it, tokenizer, end_id, width, pieces), COLUMNS)
