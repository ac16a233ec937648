"""Spelling variants: words one edit apart, by asymmetric q-chunks.

**Words.**  Maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased.
``typos`` plants the contract's deletions: where the period divides the crc32
of ``<id>:<run>``, that run loses one code point.  ``counted`` gives the words
of at least ``shortest`` code points and ``least`` occurrences.

**Join.**  A word x of l code points is cut into two disjoint chunks, x[:m] and
x[m:].  One edit leaves one of them whole in any near word y that is as long or
one longer: an edit behind a chunk leaves it in place, one before it moves it
by d = len(y) - l, which is 0 or 1.  So y writes its positional grams for both
d at the places that a whole chunk can take, and the two meet on (l, place,
gram).  Pairs that meet are verified with an exact edit distance.

**Hot chunks.**  In a key that many words share, the edit lies in the part
[a, b) of x that the key leaves out.  That part is again cut in two: the key of
each half is the word without the other half, so a round doubles the rows of
hot groups only.  At one code point left out, a group has at most a few words
per letter of the alphabet.  No group is capped and no pair is dropped; groups
of up to ``GROUP`` rows are joined at once.

**Forms.**  A word's form is its most frequent near word, if that is ``ratio``
times as frequent; roots follow forms by doubling, so a chain of n steps takes
log2(n) joins.

Null texts have no runs; a null id reads as an empty one; repeated rows count
again; words of any length are taken; an empty table gives no rows; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import materialise, small

RUN = "[a-zÀ-ÿ]"
#: Rows of one key that are joined without a further cut.
GROUP = 256
#: Distinct words that a task counts before it hands them on.
HELD = 400_000


def _tally(shortest: int, period: int | None):
    """Word counts of Arrow batches (id text, text), a partial sum per task."""
    run = re.compile(f"{RUN}{{{shortest},}}")

    def out(held: Counter) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                # bytes.lower changes A-Z alone
                runs = run.findall(text.encode().lower().decode()) if text else ()
                if period is None:
                    held.update(runs)
                    continue
                head = zlib.crc32(f"{batch.column(0)[row].as_py()}:".encode())
                for word, n in Counter(runs).items():
                    h = zlib.crc32(word.encode(), head)
                    if h % period == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    held[word] += n
            if len(held) > HELD:
                yield out(held)
                held = Counter()
        if held:
            yield out(held)

    return tally


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2,
            typos: int | None = None) -> DataFrame:
    """(word, n) over all documents; ``typos`` is the period of planted deletions."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    parts = texts.mapInArrow(_tally(shortest, typos), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _key() -> F.Column:
    """The word without its part [a, b), for a partner of l code points (d = 1
    if the word itself is one longer)."""
    left = F.substring("word", F.lit(1), F.col("a"))
    right = F.substring("word", F.col("b") + F.col("d") + 1, F.char_length("word"))
    return F.xxhash64("l", "a", "b", left, right)


def _chunk_rows(words: DataFrame, shortest: int) -> DataFrame:
    """Each word's two chunks (d = 0, which are its grams for partners of equal
    length too) and its grams for partners one shorter (d = 1)."""
    by_length = words.select("word", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    by_length = by_length.withColumn("l", F.char_length("word") - F.col("d")).where(F.col("l") >= shortest)
    middle = F.floor(F.col("l") / 2).cast("int")
    cut = F.array(F.struct(F.lit(0).alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("l").alias("b")))
    return by_length.select("word", "d", "l", F.explode(cut).alias("s")).select("word", "d", "l", "s.a", "s.b")


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    cut = F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))
    return rows.select("word", "d", "l", F.explode(cut).alias("s")).select("word", "d", "l", "s.a", "s.b")


def _met(rows: DataFrame) -> DataFrame:
    """Verified pairs (x, y) of words that share a key; x is the shorter, or the
    smaller of two of one length."""
    x = rows.where("d = 0").select("key", F.col("word").alias("x"))
    y = rows.select("key", F.col("word").alias("y"), "d")
    near = (F.col("d") == 1) | (F.col("x") < F.col("y"))
    return x.join(y, "key").where(near & (F.levenshtein("x", "y", 1) == 1)).select("x", "y")


def near_pairs(words: DataFrame, shortest: int = 7, group: int = GROUP) -> DataFrame:
    """All pairs (x, y) of distinct ``words`` (one row each, at least
    ``shortest`` code points) that are exactly one edit apart, each once."""
    rows, pairs = _chunk_rows(words, shortest), None
    while True:
        rows = materialise(rows.withColumn("key", _key()), "chunks")
        size = rows.groupBy("key").agg(
            F.count("*").alias("rows"), F.min("d").alias("d"), F.max(F.col("b") - F.col("a")).alias("open"))
        hot = materialise(size.where((F.col("rows") > group) & (F.col("d") == 0) & (F.col("open") > 1)).select("key"), "hot")
        some = not hot.isEmpty()
        hot = small(hot)
        met = _met(rows.join(hot, "key", "left_anti") if some else rows)
        pairs = met if pairs is None else pairs.unionByName(met)
        if not some:
            return pairs.distinct()
        rows = _halved(rows.join(hot, "key", "left_semi"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` without circles to (word, root), by doubling."""
    ends = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(ends.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                F.col("next").isNotNull().alias("moved")), "roots")
        ends = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ends


def variants(words: DataFrame, shortest: int = 7, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words(word, n)``."""
    words = materialise(words, "words")
    pairs = materialise(near_pairs(words.select("word"), shortest), "near")
    links = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    best = (
        links.join(words.select(F.col("word").alias("y"), "n"), "y")
        .groupBy(F.col("x").alias("word"))
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "y")).alias("best"))
    )
    # n * ratio may pass 64 bits; floor(form_n / ratio) >= n says the same
    fits = F.expr(f"-best.less div {int(ratio)}") >= F.col("n")
    told = materialise(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(fits, F.col("best.y")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")),
        "forms",
    )
    ends = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
