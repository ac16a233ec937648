"""Shared helpers: scratch tables, byte-level words and shingles in numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.session import ensure_checkpoint_dir

#: White space and words as the contracts define them.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    later jobs read files that survive the loss of any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few dozen bytes that may be sent to every executor.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it has few rows; else
    as it is, so that Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def open_store(uri: str):
    """The file system of a shared path, for tasks that write or range-read
    files of their own, and the path in it."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def give_back(encoders: bool = False) -> None:
    """Return what earlier tasks of this Python worker freed to the system: a
    worker serves many stages, and its allocators keep their peak.  The encoders
    of a stage that is over go too; a stage that encodes keeps its own."""
    import ctypes
    import sys

    tokens = sys.modules.get("keyfold.llm.tokens")
    if tokens and not encoders:
        tokens.forget_encoders()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# ---------------------------------------------------------------- numpy text

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return body, at


def spans(at: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer text stands alone)."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word, and for each row its first word
    (n + 1 entries).  A word's hash is a polynomial over its bytes, case folded
    for A-Z, modulo 2**64, and then mixed."""
    lo, hi = int(at[0]), int(at[-1])
    b, n = body[lo:hi], hi - lo
    rows = at - lo
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64)
    space = _SPACE[b]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    edge = rows[(rows > 0) & (rows < n)]
    before[edge] = after[edge - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[b] * _powers(_BASE, n), out=total[1:], dtype=np.uint64)
    h = mix((total[end] - total[start]) * _powers(_BASE_INV, n)[start])
    return h, start + lo, end + lo, np.searchsorted(start, rows)


def shingle_sets(body: np.ndarray, at: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-word shingles.  A
    shorter text is one shingle; a text without words has none."""
    h, _, _, first = words(body, at)
    count = np.diff(first)
    rolled = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled += h[k : k + len(rolled)] * _STEP[k]
    rolled = mix(rolled)
    out = []
    for a, n in zip(first[:-1].tolist(), count.tolist()):
        if n >= size:
            out.append(np.unique(rolled[a : a + n - size + 1]))
        elif n:
            short = (h[a : a + n] * _STEP[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def row_order(*columns: str) -> list:
    """Ascending with nulls last, for a total order over nullable keys."""
    return [F.col(c).asc_nulls_last() for c in columns]


def free_name(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as it takes to differ from
    all ``columns``; Spark's names do not tell upper from lower case."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = f"_{name}"
    return name
