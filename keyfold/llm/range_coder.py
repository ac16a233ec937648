"""An adaptive context-mixing range coder for token ids.

A block of ids is cut into lanes of equal length, coded side by side: step t
codes the t-th id of every lane, then all models learn from these ids.  For
each id three models speak:

* order 2: the id last seen behind the two ids before, with a confidence;
* order 1: the id last seen behind the id before, with a confidence;
* order 0: adaptive frequencies of all ids.

The mix gives each of the two predicted ids a share of the range and the rest
to the order-0 frequencies.  The shares are learned: for each pair of
confidences (and whether the two predictions agree) the coder counts how often
each model was right.  One arithmetic-coding step codes the id.  All arithmetic
is on integers, so any machine decodes what another has written.

Every block starts from empty models and carries checksums of its ids and of
its bytes, so blocks are read independently.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
#: Fixed values of the format.
BITS, LITERAL_BITS = 24, 20
LITERAL = 1 << LITERAL_BITS
TOP, BOTTOM = 1 << 48, 1 << 40
SLOTS, SURE_BITS = 1 << 16, 3
SURE = (1 << SURE_BITS) - 1
#: What a confidence gains when its prediction was right, and when it was wrong.
UP = np.minimum(np.arange(SURE + 1) + 1, SURE) - np.arange(SURE + 1)
DOWN = (np.arange(SURE + 1) >> 1) - np.arange(SURE + 1)
STEP = np.concatenate([DOWN, UP])
LANES, LANE_IDS = 4096, 256
HEAD = struct.Struct("<4sIIIIII")
MAGIC = b"CMX1"


class _Models:
    """What the coder knows so far; both directions call the same methods."""

    def __init__(self, vocab: int, lanes: int, search: bool = False):
        if vocab > LITERAL // 2:
            raise ValueError(f"more than {LITERAL // 2} ids")
        self.vocab, self.search = vocab, search
        # id * (SURE + 1) + confidence: one look-up and one write for both
        self.next2, self.next1 = np.full(SLOTS, -SURE - 1, np.int64), np.full(vocab, -SURE - 1, np.int64)
        self.seen, self.right2, self.right1 = (np.zeros(2 * (SURE + 1) ** 2, np.int64) for _ in range(3))
        self.count = np.zeros(vocab, np.int64)
        self.recent: list[np.ndarray] = []
        self.steps, self.rebuild_at = 0, 1
        self.before1 = np.zeros(lanes, np.int64)
        self.before2 = np.zeros(lanes, np.int64)
        self._frequencies()

    def _frequencies(self) -> None:
        """Where each id's share of the LITERAL order-0 units begins: one unit
        for each id, the rest by counts."""
        if self.recent:
            self.count += np.bincount(np.concatenate(self.recent), minlength=self.vocab)
            self.recent.clear()
        upto = np.concatenate([[0], np.cumsum(self.count if self.steps else self.count + 1)])
        self.below = np.arange(self.vocab + 1) + upto * (LITERAL - self.vocab) // upto[-1]
        if self.search:
            self.owner = np.repeat(np.arange(self.vocab, dtype=np.int32), np.diff(self.below))

    def predict(self) -> None:
        self.slot = ((self.before2 * 0x9E3779B1 + self.before1 * 0x85EBCA6B) >> 7) & (SLOTS - 1)
        self.e2, self.e1 = self.next2.take(self.slot), self.next1.take(self.before1)
        self.p2, self.c2 = self.e2 >> SURE_BITS, self.e2 & SURE
        self.p1, self.c1 = self.e1 >> SURE_BITS, self.e1 & SURE
        alike = self.p1 == self.p2
        self.context = (self.c2 << SURE_BITS + 1) + (self.c1 << 1) + alike
        room = (1 << BITS) - LITERAL
        share2 = room * (2 * self.right2 + 1) // (2 * self.seen + 3)
        share1 = room * (2 * self.right1 + 1) // (2 * self.seen + 3)
        self.r2 = share2.take(self.context) * (self.e2 >= 0)
        self.r1 = share1.take(self.context) * ((self.e1 >= 0) & ~alike)
        self.base = self.r2 + self.r1
        self.r0 = (1 << BITS) - self.base

    def literal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.r0 * self.below.take(ids) >> LITERAL_BITS
        return self.base + low, (self.r0 * self.below.take(ids + 1) >> LITERAL_BITS) - low

    def find(self, rest: np.ndarray) -> np.ndarray:
        """The id whose literal share holds the unit ``rest``."""
        # below 2**45: the quotient in doubles is at most one too large, which shows
        top = ((rest + 1) << LITERAL_BITS) - 1
        unit = (top / self.r0).astype(np.int64)
        unit -= unit * self.r0 > top
        return self.owner.take(unit).astype(np.int64)

    def _next(self, entry: np.ndarray, sure: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Right: surer; wrong: half as sure; wrong and not sure at all: the id seen."""
        state = sure + (hit.view(np.int8) << SURE_BITS)
        return np.where(state > 0, entry + STEP.take(state), fresh)

    def learn(self, ids: np.ndarray) -> None:
        hit2, hit1 = ids == self.p2, ids == self.p1
        # per context: neither, order 1 alone, order 2 (with or without it)
        outcome = np.bincount(self.context * 4 + hit1 + 2 * hit2, minlength=4 * len(self.seen)).reshape(-1, 4)
        self.seen += outcome.sum(1)
        self.right2 += outcome[:, 2] + outcome[:, 3]
        self.right1 += outcome[:, 1]
        fresh = ids << SURE_BITS
        self.next2[self.slot] = self._next(self.e2, self.c2, hit2, fresh)
        self.next1[self.before1] = self._next(self.e1, self.c1, hit1, fresh)
        self.recent.append(ids)
        self.before2, self.before1 = self.before1, ids
        self.steps += 1
        if self.steps == self.rebuild_at:
            self._frequencies()
            self.rebuild_at += min(self.steps, 16)


def _settle(low: np.ndarray, span: np.ndarray, lanes: np.ndarray | None = None) -> np.ndarray:
    """Which (of these) lanes must move 16 bits on; a range that straddles a
    multiple of BOTTOM for too long is cut there."""
    x, s = (low, span) if lanes is None else (low[lanes], span[lanes])
    same = (x ^ (x + s)) < U(TOP)
    short = ~same & (s < U(BOTTOM))
    if short.any():
        at = np.flatnonzero(short) if lanes is None else lanes[short]
        span[at] = (U(0) - low[at]) & U(BOTTOM - 1)
    move = same | short
    return np.flatnonzero(move) if lanes is None else lanes[move]


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // LANE_IDS))
    steps = -(-n // lanes) if n else 0
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = ids
    grid = padded.reshape(lanes, steps).T.copy()
    m = _Models(vocab, lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    lane_of, word_of = [], []
    for t in range(steps):
        x = grid[t]
        m.predict()
        is2 = x == m.p2
        is1 = ~is2 & (x == m.p1)
        start, width = m.literal(x)
        start = np.where(is2, 0, np.where(is1, m.r2, start)).view(U)
        width = np.where(is2, m.r2, np.where(is1, m.r1, width)).view(U)
        unit = span >> U(BITS)
        low += unit * start
        span = unit * width
        go = _settle(low, span)
        while len(go):
            lane_of.append(go.astype(np.uint16))
            word_of.append((low[go] >> U(48)).astype(np.uint16))
            low[go] <<= U(16)
            span[go] <<= U(16)
            go = _settle(low, span, go)
        m.learn(x)
    close = low + U(1 << 33)  # two more words point into every lane's range
    every = np.arange(lanes, dtype=np.uint16)
    lane_of += [every, every]
    word_of += [(close >> U(48)).astype(np.uint16), (close >> U(32)).astype(np.uint16)]
    lane, word = np.concatenate(lane_of), np.concatenate(word_of)
    body = np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + word[np.argsort(lane, kind="stable")].astype("<u2").tobytes()
    body = zlib.compress(body[: 4 * lanes], 6) + body[4 * lanes :]
    sizes = len(body) - 2 * len(word)
    return HEAD.pack(MAGIC, n, lanes, sizes, len(body), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def block_length(head: bytes) -> int:
    """Bytes that follow a block's head."""
    return HEAD.unpack(head)[4]


def decode_block(data: bytes, vocab: int) -> np.ndarray:
    magic, n, lanes, sizes, length, crc, body_crc = HEAD.unpack(data[: HEAD.size])
    body = data[HEAD.size : HEAD.size + length]
    if magic != MAGIC or len(body) != length or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    words_of = np.frombuffer(zlib.decompress(body[:sizes]), "<u4").astype(np.int64)
    words = np.concatenate([np.frombuffer(body[sizes:], "<u2"), np.zeros(8, "<u2")]).astype(U)
    stop = np.cumsum(words_of)
    at = stop - words_of
    steps = -(-n // lanes) if n else 0

    def pull(which):
        """The next word of these lanes; zeros behind a lane's end."""
        got = np.where(at[which] < stop[which], words[np.minimum(at[which], len(words) - 1)], U(0))
        at[which] += 1
        return got

    every = np.arange(lanes)
    code = np.zeros(lanes, U)
    for _ in range(4):
        code = (code << U(16)) | pull(every)
    m = _Models(vocab, lanes, search=True)
    low, span = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    grid = np.empty((steps, lanes), np.int64)
    for t in range(steps):
        m.predict()
        unit = span >> U(BITS)
        value = np.minimum((code - low) // unit, U((1 << BITS) - 1)).astype(np.int64)
        is2 = value < m.r2
        is1 = ~is2 & (value < m.base)
        rest = np.maximum(value - m.base, 0)
        x = m.find(np.minimum(rest, m.r0 - 1))
        x = np.where(is2, m.p2, np.where(is1, m.p1, x))
        start, width = m.literal(x)
        start = np.where(is2, 0, np.where(is1, m.r2, start)).view(U)
        width = np.where(is2, m.r2, np.where(is1, m.r1, width)).view(U)
        low += unit * start
        span = unit * width
        go = _settle(low, span)
        while len(go):
            low[go] <<= U(16)
            span[go] <<= U(16)
            code[go] = (code[go] << U(16)) | pull(go)
            go = _settle(low, span, go)
        grid[t] = x
        m.learn(x)
    ids = grid.T.reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("damaged block")
    return ids
