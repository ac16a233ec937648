"""Mixing sources to target weights, block by block.

The words of a source, its documents in id order, form one sequence that is
packed into blocks of ``BLOCK`` words.  A source gets as many slots of the mix
as its target holds blocks; what its target holds beyond whole blocks is one more
slot, which takes that share of its block's words, from the first.  Output shards of ``SHARD`` slots draw their source
counts multinomially: the slots still to give are split between the two halves
of the shard range, and so on down to one shard, each split a seeded
multinomial draw without more than is left of a source.  A shard therefore
finds its counts, and the first slot number of each source, in log2(shards)
draws of its own, and the sum over all shards is exact.  Slot i of a source
with n blocks is block ``permutation(i mod n)`` of round ``i div n``, where
each round has a keyed pseudorandom permutation; the slots are then joined to
the blocks by index.  A block is thus taken floor or ceiling of slots / n times,
one of them perhaps in part, and a source smaller than a block comes as near its
target as a large one.

Weights 5, 2, 1 repeat over the sources by code point, null last; a target
stops at 3 times its source and the rest is shared anew by weight.

Defined cases: null texts have no words and are never taken; null ids come
last; documents are ordered by id, size and hash of the text, so reruns agree,
and rows that repeat all of these count as separate documents; sources without
words have target 0; an empty table gives an empty mix.  The source sizes go
through the driver: at most ``SOURCES`` sources are allowed, more raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.llm.common import WORD, free_name, materialise, row_order
from keyfold.session import ship_package

BLOCK, SHARD, SOURCES = 128, 4096, 100_000
WEIGHTS, MOST = (5, 2, 1), 3
SEED = 20240607


def targets(sizes: list[int], total: float | None = None) -> list[float]:
    """Targets of the sources in order: shares of ``total`` (default: all
    sizes) by weight, none above ``MOST`` times its size."""
    left = float(sum(sizes) if total is None else total)
    out: list[float] = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s]
    while free:
        unit = left / sum(WEIGHTS[i % len(WEIGHTS)] for i in free)
        over = [i for i in free if unit * WEIGHTS[i % len(WEIGHTS)] > MOST * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * WEIGHTS[i % len(WEIGHTS)]
            break
        for i in over:
            out[i] = float(MOST * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: Feistel rounds over a square domain,
    walked until the value is inside."""
    side = max(2, int(np.ceil(np.sqrt(n))))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = np.divmod(out[todo], np.uint64(side))
        for r in range(6):
            h = (b + np.uint64((key + r * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            a, b = b, (a + (h >> np.uint64(33))) % np.uint64(side)
        out[todo] = a * np.uint64(side) + b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


def split_draw(slots: np.ndarray, take: int, key: int) -> np.ndarray:
    """``take`` slots drawn multinomially by what is left, never more than that."""
    rng = np.random.default_rng(key)
    got = np.zeros_like(slots)
    while (need := take - int(got.sum())) > 0:
        left = slots - got
        got = np.minimum(slots, got + rng.multinomial(need, left / left.sum()))
    return got


def shard_counts(slots: np.ndarray, shard: int, shards: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots per source that this shard gets, and how many earlier shards got."""
    low, high, have, before = 0, shards, slots.copy(), np.zeros_like(slots)
    while high - low > 1:
        mid = (low + high) // 2
        left = split_draw(have, min((mid - low) * size, int(have.sum())), _key(seed, low, high))
        if shard < mid:
            high, have = mid, left
        else:
            low, before, have = mid, before + left, have - left
    return have, before


def slot_numbers(goal: np.ndarray, sizes: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots per source, and the share of its block that the last one takes.  A
    slot brings as many words as the source's blocks hold on average."""
    want = np.minimum(goal * blocks / np.maximum(sizes, 1), MOST * blocks)
    slots = np.ceil(want - 1e-9).astype(np.int64)
    return slots, np.where(slots > 0, np.clip(want - slots + 1, 0, 1), 1.0)


def _slots(batches: Iterator[pd.DataFrame], slots: np.ndarray, last: np.ndarray, sizes: np.ndarray, size: int, shards: int, seed: int):
    """Shard numbers to (shard, source, block, words) rows, one per slot."""
    blocks = -(-sizes // size)
    for batch in batches:
        for shard in batch["id"]:
            have, before = shard_counts(slots, int(shard), shards, SHARD, seed)
            for s in np.flatnonzero(have):
                i = before[s] + np.arange(have[s])
                number, index = np.divmod(i, blocks[s])
                block = np.empty(len(i), np.int64)
                for k in np.unique(number):
                    block[number == k] = permuted(index[number == k], int(blocks[s]), _key(seed, "round", int(s), int(k)))
                words = np.minimum(size, sizes[s] - block * size)
                words = np.where(i == slots[s] - 1, np.rint(words * last[s]), words).astype(np.int64)
                yield pd.DataFrame({"shard": shard, "source_no": s, "block": block, "words": words})


def _positions(batches: Iterator[pd.DataFrame]):
    """Rows sorted by source: words before each row in this partition and source."""
    from pyspark import TaskContext

    part, source, done = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if b.empty:
            continue
        total = b["size"].cumsum()
        first = b["source_no"].ne(b["source_no"].shift())
        base = (total - b["size"]).where(first).ffill()
        start = total - b["size"] - base
        same = b["source_no"].eq(source) & first.cumsum().eq(1)
        start = start + np.where(same, done, 0)
        done = int(start.iloc[-1] + b["size"].iloc[-1])
        source = b["source_no"].iloc[-1]
        yield b.assign(part=part, local=start.astype("int64"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Two tables.  Documents: id, mark (hash of the text), size, source_no,
    position (words before it in its source), source_size, target.  Blocks
    taken: source_no, block, times, low, high (the words of the block that are
    taken so often: a block taken in part has a second row)."""
    spark = docs.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = materialise(
        docs.select(
            F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(text).alias("mark"),
        ),
        "mix-sizes",
    )
    found = narrow.groupBy("source").agg(F.sum("size").alias("n")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"]))
    sizes = np.array([r["n"] for r in found], np.int64)
    goal = np.array(targets(sizes.tolist(), total))
    blocks = -(-sizes // block)
    slots, last = slot_numbers(goal, sizes, blocks)
    listed = spark.createDataFrame(
        [(i, r["source"], int(sizes[i]), float(goal[i])) for i, r in enumerate(found)],
        "source_no bigint, source string, source_size bigint, target double",
    )
    ranked = narrow.join(F.broadcast(listed), narrow["source"].eqNullSafe(listed["source"]), "left").drop("source")

    keys = row_order("source_no", "id", "size", "mark")
    ordered = materialise(
        ranked.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(
            _positions, "id bigint, size bigint, mark bigint, source_no bigint, source_size bigint, target double, part int, local bigint"
        ),
        "mix-order",
    )
    # one row for each partition and source in it: partitions + sources rows
    ends = ordered.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("source_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offset = ends.select("source_no", "part", F.sum("words").over(earlier).alias("offset"))
    placed = ordered.join(offset, ["source_no", "part"], "left").withColumn(
        "position", F.col("local") + F.coalesce("offset", F.lit(0))
    )
    shards = -(-int(slots.sum()) // SHARD)
    drawn = spark.range(shards).mapInPandas(
        lambda it: _slots(it, slots, last, sizes, block, shards, seed), "shard bigint, source_no bigint, block bigint, words bigint"
    )
    # only the slot taken in part can have fewer words than the block's others
    counts = drawn.groupBy("source_no", "block").agg(F.count("*").alias("times"), F.min("words").alias("cut"))
    sides = F.array(
        F.struct("times", F.lit(0).cast("bigint").alias("low"), F.col("cut").alias("high")),
        F.struct((F.col("times") - 1).alias("times"), F.col("cut").alias("low"), F.lit(block).cast("bigint").alias("high")),
    )
    taken = counts.select("source_no", "block", F.inline(sides)).where("low < high")
    return placed.select("id", "mark", "size", "source_no", "position", "source_size", "target"), taken


def pieces(placed: DataFrame, taken: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each document's words by block: columns of ``placed`` with start (in
    the document), words and times (0 where the block is not taken)."""
    last = F.expr(f"CASE WHEN size > 0 THEN (position + size - 1) DIV {block} END")
    spread = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"position DIV {block}"), last)))
    edge = F.col("block") * block
    begin = F.greatest(F.col("position"), edge + F.coalesce("low", F.lit(0)))
    end = F.least(F.col("position") + F.col("size"), edge + F.coalesce("high", F.lit(block)))
    return (
        # the blocks taken grow with the input, but come from a small range that
        # Spark would take them to be as small as: never broadcast them
        spread.join(taken.hint("merge"), ["source_no", "block"], "left")
        .withColumn("start", begin - F.col("position")).withColumn("words", end - begin).where("words > 0")
        .withColumn("times", F.coalesce("times", F.lit(0))).drop("low", "high")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    placed, taken = plan(docs, **options)
    keys = ["id", "mark", "size", "source_no", "position", "source_size", "target"]
    with_words = pieces(placed, taken, options.get("block", BLOCK)).groupBy(*keys).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return with_words.unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))).select(
        "id", "size", "source_size", "target", "taken"
    )


def _cut(batches: Iterator[pd.DataFrame], columns: list[str], text_col: str, chars_col: str | None, spans_col: str):
    """Rows with their pieces (start, words, times) to one row per round,
    holding the words that the mix takes in that round."""
    import re

    word = re.compile(WORD)
    for b in batches:
        out = []
        for row, spans in zip(b[columns].itertuples(index=False, name=None), b[spans_col]):
            text = row[columns.index(text_col)] or ""
            spans = sorted((s["start"], s["words"], s["times"]) for s in spans)
            low, high = min(s[2] for s in spans), max(s[2] for s in spans)
            at = [m.span() for m in word.finditer(text)] if low < high else []
            for k in range(1, high + 1):
                value = text
                if k > low:
                    runs: list[list[int]] = []
                    for start, n, times in spans:
                        if times >= k:
                            if runs and runs[-1][1] == start:
                                runs[-1][1] = start + n
                            else:
                                runs.append([start, start + n])
                    value = "\n".join(text[at[x][0] : at[y - 1][1]] for x, y in runs)
                new = dict(zip(columns, row)) | {text_col: value}
                if chars_col:
                    new[chars_col] = len(value)
                out.append(new)
        if out:
            yield pd.DataFrame(out, columns=columns)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it; a row taken
    in part holds the words of the blocks taken.  Columns as in ``docs``."""
    placed, taken = plan(docs, id_col, text_col, source_col, **options)
    spans = (
        pieces(placed, taken, options.get("block", BLOCK))
        .groupBy("id", "mark", "size", "source_no", "position").agg(F.max("times").alias("most"), F.collect_list(F.struct("start", "words", "times")).alias("spans"))
        .withColumn("spans", F.when(F.col("most") > 0, F.col("spans")))
    )
    # rows alike in id and text (of any source) are told apart by their order
    same = W.partitionBy("id", "mark").orderBy("source_no", "position")
    spans = (
        spans.withColumn("nth", F.row_number().over(same)).groupBy("id", "mark")
        .agg(F.map_from_entries(F.collect_list(F.struct("nth", "spans"))).alias("_by"))
        .select(F.xxhash64("id", "mark").alias("_key"), F.col("id").alias("_i"), F.col("mark").alias("_m"), "_by")
    )
    columns = docs.columns
    spans_col = free_name(columns, "spans")
    # the row travels as one column, so that no name of ours meets one of its own
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("_id"), F.col(source_col).cast("string").alias("_source"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_mark"),
    )
    # one shuffle of the texts, by one key: the window stays in its partitions
    both = rows.withColumn("_key", F.xxhash64("_id", "_mark")).join(spans, "_key")
    alike = W.partitionBy("_key", "_id", "_mark", "_i", "_m").orderBy(F.col("_source").asc_nulls_last())
    full = (
        both.withColumn("_nth", F.row_number().over(alike))
        .where(F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_mark") == F.col("_m")))
        .withColumn("_spans", F.try_element_at("_by", "_nth")).where("_spans IS NOT NULL")
        .select(*[F.col("row").getField(c).alias(c) for c in columns], F.col("_spans").alias(spans_col))
    )
    chars = chars_col if chars_col in columns else None
    return full.mapInPandas(lambda it: _cut(it, columns, text_col, chars, spans_col), docs.schema)
