"""Phrase collocations: double-array tries of Apriori-safe candidates.

**Shards.**  Texts are lower-cased (A-Z), cut into pieces and words once.  A
task packs the words of one language into shards of about ``SHARD`` words: an
array of shard-local word numbers, 0 between pieces, and a row per distinct
word with its count.  Counts are summed; words of at least ``least``
occurrences get dense numbers, and each shard's numbers are replaced by them in
a join on the shard (a rarer word becomes 0: no candidate holds it).  No
vocabulary is broadcast.

**Levels.**  A phrase of k + 1 words can only reach ``least`` if its first k and
its last k words do.  Each level's pass extends the phrases found so far by the
next word wherever both parts are accepted; the sums of these extensions over
all shards leave the next level's candidates.  Counts go from task to task in
buckets of their keys, as arrays: a row holds a task's share of a bucket, and a
bucket's shares are summed together.  Candidates are numbered and
taken in slices of at most ``SLICE``, each a double-array trie that is sent to
all tasks: bounded, whatever the corpus.  A task advances the states of all
positions of its shards together, level by level, and counts the accepting
states with bincount; Spark sums these counts over the shards.

**Scores.**  Cuts, the lowest score (in decimals, so exact beyond 64 bits),
containment in longer candidates and the first ``top`` of a language are joins
and grouped minima over the candidates.

Null texts are empty, a null language is ``und``; repeated documents count
again; pieces never join documents; texts of any length are taken; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.llm.common import materialise

#: Words of a shard.
SHARD = 1 << 20
#: Candidates of one trie.
SLICE = 400_000
#: Counts that a task holds before it sums them up or hands them on.
HELD = 2_000_000
#: Words that are walked through a trie at a time.
STRETCH = 1 << 18
ROWS = 50_000

#: floor(scale * a / (l + r)) in decimals.
SCORE = "cast(a AS decimal(19)) * cast({} AS decimal(10)) div (cast(l AS decimal(19)) + cast(r AS decimal(19)))"

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256)
)


class _Numbers(dict):
    """Words to consecutive numbers; 0 is a border, -1 the void between spaces."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word):
        self[word] = n = len(self) - 1
        return n


def piece_numbers(text: str, numbers: dict) -> np.ndarray:
    """The word numbers of a text, 0 for each border."""
    tokens = text.encode().translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
    got = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
    return got[got >= 0]


def _shards(size: int):
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("body", pa.binary()), ("word", pa.string()),
                        ("local", pa.int32()), ("n", pa.int64())])

    def close(shard, lang, numbers, parts):
        body = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        yield pa.record_batch([[shard], [lang], [body.tobytes()], [None], [None], [None]], schema=schema)
        count = np.bincount(body, minlength=len(numbers) - 1)
        words = list(numbers)[2:]
        for a in range(0, len(words), ROWS):
            some = words[a : a + ROWS]
            n = len(some)
            yield pa.record_batch(
                [pa.array(np.full(n, shard, np.int64)), pa.array([lang] * n, pa.string()), pa.nulls(n, pa.binary()),
                 pa.array([w.decode() for w in some], pa.string()), pa.array(np.arange(a + 1, a + 1 + n, dtype=np.int32)),
                 pa.array(count[a + 1 : a + 1 + n].astype(np.int64))], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, open_ = TaskContext.get().partitionId() << 32, {}
        border, held = np.zeros(1, np.int32), 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for row, lang in enumerate(langs):
                text = batch.column(1)[row].as_py()
                if not text:
                    continue
                numbers, parts, n = open_.setdefault(lang, (_Numbers(), [], [0]))
                got = piece_numbers(text, numbers)
                parts += [got, border]
                n[0] += len(got) + 1
                held += len(got) + 1
                # the largest goes when all languages together fill two shards
                while n[0] >= size or held >= 2 * size:
                    most = max(open_, key=lambda k: open_[k][2][0])
                    numbers, parts, n = open_.pop(most)
                    held -= n[0]
                    yield from close(shard, most, numbers, parts)
                    shard += 1
                    if most == lang:
                        break
        for lang, (numbers, parts, _) in open_.items():
            yield from close(shard, lang, numbers, parts)
            shard += 1

    return cut


def _numbered(df: DataFrame, name: str, start: int) -> DataFrame:
    """``df``, written, with a column ``no`` that counts from ``start`` without gaps."""
    at = materialise(df.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    # one row per partition of the written table
    before = at.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + start).alias("before"))
    at = at.join(F.broadcast(before), part == F.col("part"))
    in_part = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(at.withColumn("no", (F.col("before") + in_part).cast("long")).drop("at", "part", "before"), name)


def _renumber(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's body with the corpus's word numbers; rare words become 0."""
    if not left.num_rows:
        return pa.table({"body": pa.array([], pa.binary())})
    body = np.frombuffer(left["body"][0].as_py(), np.int32)
    to = np.zeros(int(body.max(initial=0)) + 1, np.int32)
    to[right["local"].to_numpy()] = right["no"].to_numpy()
    return pa.table({"body": pa.array([to[body].tobytes()], pa.binary())})


# ------------------------------------------------------------------ the trie


class Trie:
    """A double-array trie of equally long phrases of word numbers.

    From state s, symbol c leads to t = base[s] + c if check[t] == s.  ``words``
    holds the used word numbers in order; a word's symbol is its place there,
    counted from 1.  ``accept[t]`` is the row of the phrase that ends in t, or
    -1.
    """

    def __init__(self, phrases: np.ndarray):
        self.words = np.unique(phrases).astype(np.int32)
        self.depth = phrases.shape[1]
        n = len(self.words)
        symbols = np.searchsorted(self.words, phrases).astype(np.int64) + 1
        order = np.lexsort(symbols.T[::-1])
        symbols = symbols[order]
        room = 2 * n + 2 * len(symbols) * (self.depth - 1) + 64
        self.base, self.check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        self.check[0] = 0
        # the root's children stand at their symbols
        state = symbols[:, 0].copy()
        self.check[np.unique(state)] = 0
        taken = n + 1
        for level in range(1, self.depth):
            state, taken = self._level(state, symbols[:, level], taken)
        self.base, self.check = self.base[: taken + n + 1].copy(), self.check[: taken + n + 1].copy()
        self.accept = np.full(len(self.check), -1, np.int32)
        self.accept[state] = order

    def _grow(self, room: int) -> None:
        if room > len(self.check):
            more = max(room, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int32))
            self.check = np.append(self.check, np.full(more, -1, np.int32))

    def _level(self, parent: np.ndarray, symbol: np.ndarray, taken: int) -> tuple[np.ndarray, int]:
        """Places the children of one level, those of one parent together and
        large families first; rows are sorted by phrase."""
        new = np.append(True, (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1]))
        p, c = parent[new], symbol[new]
        head = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        size = np.diff(np.append(head, len(p)))
        where = np.empty(len(p), np.int64)
        start, last = 0, 0
        for g in np.flatnonzero(size > 1)[np.argsort(-size[size > 1], kind="stable")].tolist():
            a, k = int(head[g]), int(size[g])
            children = c[a : a + k]
            self._grow(taken + int(children[-1] - children[0]) + 2)
            # a family of this size found no place before the last one's
            start = start if k == last else 0
            at = self._fit(children - children[0], start, taken)
            places = at + children - children[0]
            self.check[places], self.base[p[a]] = p[a], at - children[0]
            where[a : a + k] = places
            start, last, taken = at, k, max(taken, int(places[-1]) + 1)
        # a single child goes to any free slot
        single = head[size == 1]
        free = np.flatnonzero(self.check[:taken] == -1)[: len(single)]
        free = np.append(free, taken + np.arange(len(single) - len(free)))
        taken += max(0, len(single) - int((free < taken).sum()))
        self._grow(taken + 1)
        self.check[free], self.base[p[single]] = p[single], free - c[single]
        where[single] = free
        return where[np.cumsum(new) - 1], taken

    def _fit(self, offsets: np.ndarray, start: int, taken: int) -> int:
        """The first slot from ``start`` on where all offsets are free."""
        while start < taken:
            end = min(start + 4096, taken)
            at = np.flatnonzero(self.check[start:end] == -1) + start
            for o in offsets[1:].tolist():
                if not len(at):
                    break
                at = at[self.check[at + o] == -1]
            if len(at):
                return int(at[0])
            start = end
        return taken

    def walk(self, body: np.ndarray) -> np.ndarray:
        """The state each position reaches after ``depth`` words, or -1."""
        n = len(body) - self.depth + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.words, body), len(self.words) - 1)
        symbol = np.where(self.words[place] == body, place + 1, 0).astype(np.int64)
        at = np.flatnonzero((symbol[:n] > 0) & (self.check[symbol[:n]] == 0))
        state = symbol[at]
        for level in range(1, self.depth):
            c = symbol[at + level]
            to = self.base[state] + c
            ok = (c > 0) & (to >= 0) & (to < len(self.check))
            to = np.where(ok, to, 0)
            ok &= self.check[to] == state
            at, state = at[ok], to[ok]
        out = np.full(n, -1, np.int64)
        out[at] = state
        return out


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all first bytes first: in sorted keys and
    small counts most bytes then repeat, which Spark's compression takes out."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


_SHARES = "bucket int, keys binary, counts binary"


class _Held:
    """Counts by key (candidate << 32 | next word, 0: the candidate itself)
    that a task has not handed on yet."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.n = buckets, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from self.put(*np.unique(keys, return_counts=True))

    def put(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts))
        self.n += len(keys)
        if self.n > HELD:
            self._sum()
            if self.n > HELD // 2:
                yield from self.rows()

    def _sum(self) -> None:
        parts, self.parts = self.parts, []
        self.parts = [_sums(*map(np.concatenate, zip(*parts)))]
        self.n = len(self.parts[0][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        self._sum()
        (k, c), self.parts, self.n = self.parts[0], [], 0
        bucket = ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        k, c, bucket = k[order], c[order], bucket[order]
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(heads, np.append(heads[1:], len(k))):
            yield pa.record_batch({
                "bucket": pa.array(bucket[a : a + 1]), "keys": pa.array([_planes(k[a:b])], pa.binary()),
                "counts": pa.array([_planes(c[a:b])], pa.binary())})


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    from keyfold.llm.common import give_back

    give_back()
    for batch in batches:
        for value in batch.column(0):
            yield np.frombuffer(value.as_buffer(), np.int32)


def _pairs(buckets: int):
    """Level 1 extended: (word, next word, count) of frequent neighbours."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(buckets)
        for body in _bodies(batches):
            at = np.flatnonzero((body[:-1] > 0) & (body[1:] > 0))
            yield from held.add((body[at].astype(np.int64) << 32) | body[at + 1])
        yield from held.rows()

    return pairs


def _counter(sent, extend: bool, buckets: int):
    """A pass with one trie: (row, 0, count) of accepting states and, with
    ``extend``, (row, next word, count) where the last words are accepted too
    (``whole``: the trie holds its whole level, so that they can be)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, whole = sent.value
        total, held = np.zeros(len(trie.check), np.int64), _Held(buckets)
        for body in _bodies(batches):
            # the state of a stretch's last position is walked again by the next
            starts = len(body) - trie.depth + 1
            for a in range(0, starts, STRETCH):
                n = min(STRETCH, starts - a)
                state = trie.walk(body[a : a + n + trie.depth])
                total += np.bincount(state[:n][state[:n] >= 0], minlength=len(total))
                if extend and len(state) > 1:
                    after = body[a + trie.depth : a + trie.depth + len(state) - 1]
                    ok = (state[:-1] >= 0) & (after > 0)
                    if whole:
                        ok &= state[1:] >= 0
                    yield from held.add((trie.accept[state[:-1][ok]].astype(np.int64) << 32) | after[ok])
        seen = np.flatnonzero(total)
        yield from held.put(trie.accept[seen].astype(np.int64) << 32, total[seen])
        yield from held.rows()

    return count


def _summed(bodies: DataFrame, shares, buckets: int, least: int) -> DataFrame:
    """The sums of at least ``least`` over all tasks: (no, word, n), word 0 for
    the candidate itself."""

    def sums(table: pa.Table) -> pa.Table:
        keys = [_unplaned(x.as_buffer()) for x in table["keys"]]
        counts = [_unplaned(x.as_buffer()) for x in table["counts"]]
        k, n = _sums(np.concatenate(keys), np.concatenate(counts))
        k, n = k[n >= least], n[n >= least]
        return pa.table({"no": k >> 32, "word": k & 0xFFFFFFFF, "n": n})

    return bodies.mapInArrow(shares, _SHARES).groupBy("bucket").applyInArrow(sums, "no long, word long, n long")


def _level(bodies: DataFrame, candidates: DataFrame, depth: int, extend: bool, least: int, slice_: int, buckets: int):
    """Counts of a level's candidates (p, f), and the next level's candidates
    (p) or None.  ``candidates`` has ``no`` from 0."""
    spark, total = bodies.sparkSession, candidates.count()
    found, longer = None, None
    for a in range(0, total, slice_):
        rows = candidates.where(F.col("no").between(a, a + slice_ - 1)).orderBy("no").select("p").toArrow()
        phrases = rows["p"].combine_chunks().flatten().to_numpy().reshape(-1, depth)
        sent = spark.sparkContext.broadcast((Trie(phrases), total <= slice_))
        counts = materialise(
            _summed(bodies, _counter(sent, extend, buckets), buckets, least).withColumn("no", F.col("no") + a), "phrase-counts")
        sent.unpersist()
        counts = counts.join(candidates, "no")
        f = counts.where("word = 0").select("p", F.col("n").alias("f"))
        more = counts.where("word > 0").select(F.concat("p", F.array(F.col("word").cast("int"))).alias("p"))
        found = f if found is None else found.unionByName(f)
        longer = more if longer is None else longer.unionByName(more)
    if found is None:
        empty = spark.createDataFrame([], "p array<int>, f long")
        return empty, empty.select("p")
    return found, longer


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 4, least: int = 30,
         shard: int = SHARD, slice_: int = SLICE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): frequent words (no, lang, word, n), candidate
    phrases (p: word numbers, f: occurrences) of 2 to ``longest`` words, and
    (lang, n), the occurrences of all words."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    rows = materialise(
        texts.mapInArrow(_shards(shard), "shard long, lang string, body binary, word string, local int, n long"), "shards")
    counted = rows.where("word IS NOT NULL")
    totals = materialise(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = _numbered(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words", 1)
    to = counted.join(words.select("lang", "word", "no"), ["lang", "word"]).select(
        F.col("shard").alias("of"), "local", F.col("no").cast("int").alias("no"))
    bodies = materialise(
        rows.where("body IS NOT NULL").select("shard", "body").groupBy("shard")
        .cogroup(to.groupBy("of")).applyInArrow(_renumber, "body binary"), "bodies")
    # a bucket holds on average what two shards can hand on, however many there are
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), bodies.count() // 2)
    pairs = _summed(bodies, _pairs(buckets), buckets, least)
    candidates, phrases = pairs.select(F.array(F.col("no").cast("int"), F.col("word").cast("int")).alias("p")), None
    for depth in range(2, longest + 1):
        candidates = _numbered(candidates, f"candidates-{depth}", 0)
        found, candidates = _level(bodies, candidates, depth, depth < longest, least, slice_, buckets)
        phrases = found if phrases is None else phrases.unionByName(found)
    return words, materialise(phrases, "phrases"), totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 4, least: int = 30,
                 scale: int = 2_000_000, part: int = 80, top: int = 2000, shard: int = SHARD, slice_: int = SLICE) -> DataFrame:
    """Each language's first ``top`` phrases: (lang, rank, phrase, a, l, r, n,
    score); see the module."""
    words, phrases, totals = mine(docs, lang_col, text_col, longest, least, shard, slice_)
    f = phrases.unionByName(words.select(F.array(F.col("no").cast("int")).alias("p"), F.col("n").alias("f")))
    cuts = phrases.select("p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("x"),
                       F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("y"))
    cuts = cuts.join(f.select(F.col("p").alias("x"), F.col("f").alias("l")), "x").join(
        f.select(F.col("p").alias("y"), F.col("f").alias("r")), "y")
    scored = cuts.withColumn("score", F.expr(SCORE.format(int(scale))))
    scored = scored.groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    at = F.explode(F.expr("flatten(transform(sequence(2, size(q) - 1), m -> transform(sequence(1, size(q) - m + 1), i -> slice(q, i, m))))"))
    inside = phrases.where(F.size("p") > 2).select(F.col("p").alias("q"), "f").select(at.alias("p"), "f")
    inside = inside.groupBy("p").agg(F.max("f").alias("held"))
    swallowed = F.expr(f"cast(held AS decimal(20)) * 100 >= cast(a AS decimal(20)) * {int(part)}")
    kept = scored.join(inside, "p", "left").where(~F.coalesce(swallowed, F.lit(False)))
    spelt = kept.select("p", "a", "cut", F.posexplode("p").alias("at", "w")).join(
        words.select(F.col("no").cast("int").alias("w"), "lang", "word"), "w")
    spelt = spelt.groupBy("p", "a", "cut").agg(
        F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelt = spelt.select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = spelt.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
