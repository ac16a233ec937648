"""Benchmark decontamination on a distributed positional inverted index.

**Index.**  ``index`` cuts the documents of each input partition into segments
of about ``SEGMENT`` words and writes, per segment and term, one row with the
gaps between the term's positions; documents follow each other in a segment
with one free position between them, and a row per document holds its first
position.  A frequent term's postings are so spread over all segments, and
nothing is shuffled.  The index is a table in the shared folder.

**Search.**  ``windows`` turns test texts into distinct runs of ``width`` words
(a shorter text is one run).  They go out in blocks of at most ``BLOCK`` runs,
a stated query set against all rows.  Of each segment only the postings of the
block's terms meet in one task, and every run whose terms are all there takes
the positions of its rarest term, less that term's offset, and intersects them
with the next rarest term's offset-adjusted list, until none is left or all
terms agree.  These are exact phrase matches: terms are compared as strings.
With ``within``, a match is instead a span of at most so many words of one
document that holds each distinct term of the run, in any order, and that no
end can leave (proximity).

Words are maximal runs of 0-9, a-z (A-Z lower-cased) and all code points above
127.  Null texts have no words; a test text without words has no run; test rows
without an id mark words but are not listed; equal test texts are all listed;
repeated documents give a row each; texts of any length are one document of one
segment; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.llm.common import materialise, small

#: Words of a segment (a longer document is a segment with what precedes it).
SEGMENT = 1 << 21
#: Runs that are searched in one pass over the index.
BLOCK = 50_000
#: Rows of one batch that a task hands on.
ROWS = 20_000

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def text_words(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


class _Numbers(dict):
    """Words to consecutive numbers, in order of first use."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _segment_rows(segment: int, ids: list, first: list, sizes: list, numbers: _Numbers, parts: list, id_type):
    """The record batches of one segment: its documents, then its postings."""

    def batch(n, **columns):
        empty = {"doc_no": pa.int32(), "doc_id": id_type, "first": pa.int32(), "n_words": pa.int64(),
                 "term": pa.string(), "gaps": pa.list_(pa.int32())}
        arrays = {"segment": pa.array(np.full(n, segment, np.int64))}
        arrays |= {c: columns.get(c, pa.nulls(n, t)) for c, t in empty.items()}
        return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    for a in range(0, len(ids), ROWS):
        b = min(a + ROWS, len(ids))
        yield batch(b - a, doc_no=pa.array(np.arange(a, b, dtype=np.int32)), doc_id=pa.array(ids[a:b], id_type),
                    first=pa.array(first[a:b], pa.int32()), n_words=pa.array(sizes[a:b], pa.int64()))
    if not numbers:
        return
    number = np.concatenate(parts)
    at = np.concatenate([np.arange(f, f + s, dtype=np.int32) for f, s in zip(first, sizes)])
    order = np.argsort(number, kind="stable")
    at, ends = at[order], np.cumsum(np.bincount(number, minlength=len(numbers)))
    starts = ends - np.diff(ends, prepend=0)
    gaps = np.diff(at, prepend=np.int32(0))
    gaps[starts] = at[starts]
    terms = list(numbers)
    for a in range(0, len(terms), ROWS):
        b = min(a + ROWS, len(terms))
        offsets = np.append(starts[a:b], ends[b - 1]) - starts[a]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(gaps[starts[a] : ends[b - 1]]))
        yield batch(b - a, term=pa.array([t.decode() for t in terms[a:b]], pa.string()), gaps=lists)


def _indexer(size: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment, id_type = TaskContext.get().partitionId() << 32, None
        ids, first, sizes, numbers, parts, end = [], [], [], _Numbers(), [], 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids_here = batch.column(0).to_pylist()
            for row, doc in enumerate(ids_here):
                words = text_words(batch.column(1)[row].as_py())
                ids.append(doc)
                first.append(end)
                sizes.append(len(words))
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                end += len(words) + 1
                if end >= size:
                    yield from _segment_rows(segment, ids, first, sizes, numbers, parts, id_type)
                    segment += 1
                    ids, first, sizes, numbers, parts, end = [], [], [], _Numbers(), [], 0
        if ids:
            yield from _segment_rows(segment, ids, first, sizes, numbers, parts, id_type)

    return build


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEGMENT) -> DataFrame:
    """The written index: rows (segment, doc_no, doc_id, first, n_words) per
    document and (segment, term, gaps) per segment and term."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"segment long, doc_no int, doc_id {kind}, first int, n_words long, term string, gaps array<int>"
    return materialise(texts.mapInArrow(_indexer(size), schema), "phrase-index")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10) -> tuple[DataFrame, DataFrame]:
    """The distinct runs (run, terms) of test texts, and whose they are
    (run, item); ``run`` counts from 0 without gaps."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                w = [t.decode() for t in text_words(batch.column(1)[row].as_py())]
                for a in range(0, max(len(w) - width, 0) + 1 if w else 0, ROWS):
                    runs = [w[i : i + width] for i in range(a, min(a + ROWS, max(len(w) - width, 0) + 1))]
                    yield pa.record_batch({
                        "item": pa.array([batch.column(0)[row].as_py()] * len(runs), batch.schema.field(0).type),
                        "terms": pa.array(runs, pa.list_(pa.string()))})

    texts = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    of_items = materialise(texts.mapInArrow(cut, f"item {kind}, terms array<string>").distinct(), "test-runs")
    runs = materialise(of_items.select("terms").distinct().withColumn("at", F.monotonically_increasing_id()), "runs")
    before = runs.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    # one row per partition of the written table
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    runs = runs.join(F.broadcast(before), F.shiftright("at", 33) == F.col("part")).select(
        (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("run"), "terms")
    runs = materialise(runs, "runs")
    return runs, materialise(of_items.join(runs, "terms").select("run", "item"), "run-items")


def _contains(sorted_at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    i = np.searchsorted(sorted_at, wanted)
    return sorted_at[np.minimum(i, len(sorted_at) - 1)] == wanted


def phrase_starts(lists: list[np.ndarray]) -> np.ndarray:
    """Where the terms whose positions are ``lists`` stand one after another."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    start = lists[order[0]] - order[0]
    for k in order[1:]:
        if not len(start):
            break
        start = start[_contains(lists[k], start + k)]
    return start


def near_spans(lists: list[np.ndarray], within: int, firsts: np.ndarray) -> list[tuple[int, int]]:
    """Shortest spans (start, end) of at most ``within`` positions inside one
    document that hold a position of every list."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    anchor = lists[order[0]].astype(np.int64)
    for k in order[1:]:
        i = np.searchsorted(lists[k], anchor - within + 1)
        anchor = anchor[i < np.searchsorted(lists[k], anchor + within)]
    if not len(anchor):
        return []
    at, term = [], []
    for k, held in enumerate(lists):
        i = np.searchsorted(anchor, held - within, "right")
        close = held[(i < len(anchor)) & (anchor[np.minimum(i, len(anchor) - 1)] < held + within)]
        at.append(close)
        term.append(np.full(len(close), k))
    at, term = np.concatenate(at), np.concatenate(term)
    by_place = np.argsort(at, kind="stable")
    at, term = at[by_place], term[by_place]
    doc = np.searchsorted(firsts, at, "right")
    last, out, here = [-1] * len(lists), [], -1
    for p, k, d in zip(at.tolist(), term.tolist(), doc.tolist()):
        if d != here:
            last, here = [-1] * len(lists), d
        before, last[k] = last[k], p
        start = min(last)
        if start >= 0 and before < start and p - start < within:
            out.append((start, p + 1))
    return out


def _searcher(runs, within: int | None):
    """Matches of a block of runs in one segment: rows (segment, doc_no, run)
    per document and run found, and (segment, doc_no, start, stop) per merged
    stretch of hit words, counted from the document's first."""
    runs_b = runs

    def search(table: pa.Table) -> pa.Table:
        numbers, ids, terms = runs_b.value
        docs = table.filter(pa.compute.is_null(table["term"])).sort_by("doc_no")
        firsts = docs["first"].to_numpy().astype(np.int64)
        post = table.filter(pa.compute.is_valid(table["term"]))
        segment = table["segment"][0].as_py()
        held: dict[int, np.ndarray] = {}
        names = post["term"].to_pylist()
        for name, gaps in zip(names, post["gaps"]):
            held[numbers[name]] = np.cumsum(gaps.values.to_numpy(), dtype=np.int64)
        have = np.zeros(len(numbers) + 1, bool)
        have[list(held)] = True
        have[-1] = True  # the filler of runs that are shorter than the longest
        found_doc, found_run, start, stop = [], [], [], []
        for r in np.flatnonzero(have[terms].all(axis=1)):
            run = [t for t in terms[r].tolist() if t >= 0]
            if within is None:
                a = phrase_starts([held[t] for t in run])
                b = a + len(run)
            else:
                spans = np.array(near_spans([held[t] for t in dict.fromkeys(run)], within, firsts), np.int64).reshape(-1, 2)
                a, b = spans[:, 0], spans[:, 1]
            if len(a):
                doc = np.unique(np.searchsorted(firsts, a, "right") - 1)
                found_doc.append(doc)
                found_run.append(np.full(len(doc), ids[r], np.int64))
                start.append(a)
                stop.append(b)
        doc, run = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_doc, found_run))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (start, stop))
        by_start = np.argsort(a, kind="stable")
        a, b = a[by_start], np.maximum.accumulate(b[by_start]) if len(b) else b
        new = np.append(True, a[1:] > b[:-1]) if len(a) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        a, b = a[heads], b[np.append(heads[1:], len(b)) - 1] if len(heads) else b
        hit = np.searchsorted(firsts, a, "right") - 1
        none = pa.nulls(len(hit), pa.int64())
        return pa.table({
            "segment": pa.array(np.full(len(doc) + len(hit), segment, np.int64)),
            "doc_no": pa.array(np.concatenate([doc, hit]).astype(np.int32)),
            "run": pa.concat_arrays([pa.array(run), none]),
            "start": pa.concat_arrays([pa.nulls(len(doc), pa.int64()), pa.array(a - firsts[hit])]),
            "stop": pa.concat_arrays([pa.nulls(len(doc), pa.int64()), pa.array(b - firsts[hit])]),
        })

    return search


def _block(spark, rows):
    """A block of runs as (term numbers, run ids, runs x terms), sent to all tasks."""
    numbers = _Numbers()
    lists = [[numbers[t] for t in r["terms"]] for r in rows]
    terms = np.full((len(lists), max(map(len, lists))), -1, np.int32)
    for i, run in enumerate(lists):
        terms[i, : len(run)] = run
    return spark.sparkContext.broadcast((dict(numbers), np.array([r["run"] for r in rows], np.int64), terms)), list(numbers)


def matches(indexed: DataFrame, runs: DataFrame, within: int | None = None, block: int = BLOCK) -> DataFrame:
    """All matches of ``runs`` in an index, written: (segment, doc_no, run,
    null, null) per document and run it holds, and (segment, doc_no, null,
    start, stop) per stretch of words inside a match of one block."""
    spark = indexed.sparkSession
    schema = "segment long, doc_no int, run long, start long, stop long"
    total, out = runs.count(), None
    for a in range(0, total, block):
        rows = runs.where(F.col("run").between(a, a + block - 1)).orderBy("run").collect()
        sent, vocabulary = _block(spark, rows)
        # at most ten terms a run of a bounded block
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "term string"))
        postings = indexed.where("term IS NOT NULL").select("segment", "doc_no", "first", "term", "gaps").join(
            wanted, "term", "left_semi")
        starts = indexed.where("term IS NULL").select("segment", "doc_no", "first", "term", "gaps")
        got = starts.unionByName(postings).groupBy("segment").applyInArrow(_searcher(sent, within), schema)
        got = materialise(got, "matches")
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], schema) if out is None else out


def contamination(indexed: DataFrame, runs: DataFrame, of_items: DataFrame, within: int | None = None,
                  block: int = BLOCK) -> DataFrame:
    """Per document of the index (doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated)."""
    found = matches(indexed, runs, within, block)
    doc = ["segment", "doc_no"]
    reach = F.max("stop").over(Window.partitionBy(*doc).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("stop") - F.greatest("start", F.coalesce("reach", "start")), F.lit(0))
    hits = found.where("start IS NOT NULL").withColumn("reach", reach).groupBy(*doc).agg(F.sum(fresh).alias("n_hit"))
    items = (
        found.where("run IS NOT NULL").select(*doc, "run").join(small(of_items), "run").where("item IS NOT NULL")
        .select(*doc, F.col("item").cast("string").alias("item")).distinct()
        .groupBy(*doc).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))
        .select(*doc, "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    )
    rows = indexed.where("term IS NULL").select(*doc, "doc_id", "n_words")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return rows.join(hits, doc, "left").join(items, doc, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
