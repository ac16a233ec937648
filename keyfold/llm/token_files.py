"""Token-id files: whole texts to ids, in id order, range-coded in blocks.

One file per range of document ids, written by the task that holds the range:

    head    "KFIDS1", vocabulary size
    blocks  of ``BLOCK`` ids each (see ``range_coder``), cut without regard to
            documents, each decodable alone and checksummed
    table   ids and lengths of the documents (zlib), the blocks' offsets
    tail    where the table begins, its length and checksum

A task names its file after itself and a random mark and reports it in the
manifest, which is written as a table: a task that is run again leaves a file
that nothing refers to.  Files are read through the manifest, one per task,
block by block, so memory holds a block and no more.

Defined cases: a null text is empty (only the end id); null document ids come
last; rows with one id are ordered by the hash of their text; an empty table
gives no files and no rows; texts of any length are encoded whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.llm import range_coder
from keyfold.llm.common import materialise, open_store, scratch
from keyfold.session import ship_package

BLOCK = 1 << 20
HEAD = struct.Struct("<6sI")
TAIL = struct.Struct("<QII")
MAGIC = b"KFIDS1"
MANIFEST = "part int, path string, documents bigint, ids bigint, bytes bigint"


class Writer:
    """Appends documents' ids to one file."""

    def __init__(self, stream, vocab: int):
        self.out, self.vocab, self.at = stream, vocab, 0
        self.held, self.n_held = [], 0
        self.docs: list = []
        self.lengths: list[np.ndarray] = []
        self.blocks: list[int] = []
        self._put(HEAD.pack(MAGIC, vocab))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        self._put(range_coder.encode_block(ids, self.vocab))

    def add(self, docs: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs += docs
        self.lengths.append(lengths)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            ids = np.concatenate(self.held)
            full = len(ids) // BLOCK * BLOCK
            for a in range(0, full, BLOCK):
                self._block(ids[a : a + BLOCK])
            self.held, self.n_held = [ids[full:]], len(ids) - full

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        lengths = np.concatenate(self.lengths).astype("<i8")
        keys = np.array([k or 0 for k in self.docs], "<i8")
        none = np.array([k is None for k in self.docs], "u1")
        table = zlib.compress(
            struct.pack("<QQ", len(keys), len(self.blocks)) + keys.tobytes() + none.tobytes() + lengths.tobytes() + np.array(self.blocks, "<i8").tobytes()
        )
        start = self.at
        self._put(table)
        self._put(TAIL.pack(start, len(table), zlib.crc32(table)))


class Reader:
    """Range-reads one file: the table first, then blocks one after another."""

    def __init__(self, source):
        self.src = source
        size = source.size()
        magic, self.vocab = HEAD.unpack(source.read_at(HEAD.size, 0))
        start, length, crc = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        table = source.read_at(length, start)
        if magic != MAGIC or zlib.crc32(table) != crc:
            raise ValueError("not a token-id file, or a damaged one")
        table = zlib.decompress(table)
        n, b = struct.unpack_from("<QQ", table)
        at = 16
        keys = np.frombuffer(table, "<i8", n, at)
        none = np.frombuffer(table, "u1", n, at + 8 * n)
        self.lengths = np.frombuffer(table, "<i8", n, at + 9 * n)
        self.blocks = np.frombuffer(table, "<i8", b, at + 17 * n)
        self.docs = pa.array(keys, pa.int64(), mask=none.astype(bool))

    def ids(self) -> Iterator[np.ndarray]:
        for at in self.blocks.tolist():
            head = self.src.read_at(range_coder.HEAD.size, at)
            rest = self.src.read_at(range_coder.block_length(head), at + len(head))
            yield range_coder.decode_block(head + rest, self.vocab)

    def documents(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First document, lengths and checksums, a block's worth at a time."""
        ends = np.cumsum(self.lengths)
        doc, crc, before = 0, 0, 0
        for block in self.ids():
            data = memoryview(block.astype("<u4").tobytes())
            after = before + len(block)
            last = int(np.searchsorted(ends, after, "right"))
            cuts = (ends[doc:last] - before).tolist()
            out, a = [], 0
            for c in cuts:
                out.append(zlib.crc32(data[4 * a : 4 * c], crc))
                a, crc = c, 0
            if out:
                yield doc, self.lengths[doc:last], np.array(out, np.int64)
            crc = zlib.crc32(data[4 * a :], crc) if a < len(block) else crc
            doc, before = last, after


def _written(batches: Iterator[pa.RecordBatch], base: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    from keyfold.llm.tokens import batches as groups
    from keyfold.llm.tokens import encoder

    enc = encoder(tokenizer)
    vocab = max(max(enc.tok.get_vocab().values()), end_id) + 1
    part = TaskContext.get().partitionId()
    path = f"{base}/part-{part:07d}-{uuid.uuid4().hex[:8]}.ids"
    writer = stream = None
    total = 0
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in groups(texts):
            if writer is None:
                store, at = open_store(path)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                stream = store.open_output_stream(at)
                writer = Writer(stream, vocab)
            ids, counts = enc.encode(texts[a:b])
            ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
            writer.add(keys[a:b], ids, counts + 1)
            total += len(ids)
    if writer:
        writer.close()
        stream.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "documents": len(writer.docs), "ids": total, "bytes": writer.at}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Write the files; returns the manifest, whose parts ascend with the ids."""
    spark = docs.sparkSession
    ship_package(spark)
    base = scratch(spark, "token-ids")
    rows = docs.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t"))
    keys = [F.col("k").asc_nulls_last(), F.xxhash64("t")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialise(ordered.mapInArrow(lambda it: _written(it, base, tokenizer, end_id), MANIFEST), "token-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, at = open_store(path)
            with store.open_input_file(at) as f:
                reader = Reader(f)
                begin = start + np.cumsum(reader.lengths) - reader.lengths
                for doc, lengths, crc in reader.documents():
                    n = len(lengths)
                    yield pa.RecordBatch.from_arrays(
                        [reader.docs.slice(doc, n), pa.array(begin[doc : doc + n]), pa.array(lengths), pa.array(crc)],
                        names=["id", "start", "n_tokens", "ids_crc32"],
                    )


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: id, start (ids of all documents
    before it), n_tokens, ids_crc32.  The starts of the files come from a
    running sum over the manifest, one row per file."""
    ship_package(spark)
    before = F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).cast("bigint").alias("start"))
    # a file a task: the paths are dealt out evenly, not by size
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(_read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
