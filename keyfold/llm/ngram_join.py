"""N-gram Jaccard self-join: count vectors in packed R-trees.

A document is its set of distinct 5-word shingles, each a 64-bit hash.  The
hashes fall into ``GROUPS`` groups; the counts per group are a point, and two
sets share at most the sum of their points' coordinate minima.  A link (at
least ``percent`` of the union shared) needs that sum to reach a known size.

1. Equal sets collapse to one node with a number of its own; the node's row is
   that with the smallest id.
2. Sets meet in blocks: a block holds the sets that have one hash among their
   smallest.  The number of hashes taken, k, is that of an exact prefix filter
   or, for large sets, the k at which a linked pair shares none of them with a
   chance below 2**-64 - no more than that of a clash of the hashes themselves.
3. Star rounds: in each block every set is tried against one other, the first
   in a random order; pairs that pass the bound are verified on the full sets,
   and the links give components.  Blocks that still hold several components go
   into the next round, with other orders, while rounds find links.  A round's
   pairs are never more than the rows of its blocks.
4. Tree round: what is left of the blocks is cut into tiles of at most ``TILE``
   rows and about ``SHINGLES`` shingles, in order of set size.  A tile is an
   R-tree packed by median splits: leaves of ``LEAF`` points, ``FAN`` nodes under
   each node above, every node with the least and greatest coordinates, sizes and
   components below it.  Tiles of a block are joined with themselves and each
   other from the roots down, a task per pair of tiles.  A pair counts only in
   the block of the smallest hash that both sets take, and only if its
   components differ.
5. The join hands on the sets that may link, per pair of tiles, never the pairs.
   Each pair of tiles gets those sets and tries them in full; a set that links
   joins its component there, and no pair within one component is tried again.
   What comes out is one link for each two components that meet, so rows stay
   below those of the tiles.

Defined cases: a text without words has an empty set and links with nothing;
shorter texts are one shingle; rows with a null id are returned with their set
size and no component and link with nothing; rows that share an id each get
the component of their own text, which is the smallest id of all rows in it
(texts of one id are told apart by a 64-bit hash, and sets by their digest); an
empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import materialise, shingle_sets, spans, utf8
from keyfold.llm.components import components
from keyfold.session import ship_package

GROUPS, TILE, LEAF, FAN = 256, 2048, 32, 4
#: Shingles at which a tile is closed (its last set may pass them).
SHINGLES = 1 << 20
#: Star rounds at most, and the random orders in which a round's blocks find their first.
STAR_ROUNDS, ORDERS = 1, 8
#: Sets that are held at once to verify the pairs of a star round, about.
SETS = 256


def prefix_length(n: int, percent: int) -> int:
    exact = n - -(-percent * n // 100) + 1
    return min(exact, math.ceil(64 * math.log(2) / -math.log(1 - percent / 100)))


# -------------------------------------------------------------- task helpers


def _counts(s: np.ndarray) -> bytes:
    c = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
    top = int(c.max(initial=0))
    return c.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def points(column) -> np.ndarray:
    """Count vectors of a binary column, one row each."""
    raw = column if isinstance(column, list) else column.to_pylist()
    if not raw:
        return np.zeros((0, GROUPS), np.uint8)
    if all(len(r) == GROUPS for r in raw):
        return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(r, f"<u{len(r) // GROUPS}").astype(np.uint32) for r in raw])


def _may_link(bound: np.ndarray, size_sum: np.ndarray, percent: int) -> np.ndarray:
    return (100 + percent) * bound.astype(np.int64) >= percent * size_sum


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _profiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, at = utf8(batch.column(1))
        for a, b in spans(at):
            sets = shingle_sets(body, at[a : b + 1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(2).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([s[: prefix_length(len(s), percent)].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([_counts(s) for s in sets], pa.binary()),
                ],
                names=["id", "mark", "n", "digest", "keys", "point"],
            )


#: Pairs with the place (block or tile, and batch) that they were found in.
PAIRS = "a bigint, b bigint, place bigint, part bigint"


def _pairs(a: np.ndarray, b: np.ndarray, place: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    columns = (np.minimum(a, b), np.maximum(a, b), place, part)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "place", "part"])


def _stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, rep, n, point, label) sorted by key: each against the first of
    its block, where their components differ."""
    from pyspark import TaskContext

    head, serial = None, TaskContext.get().partitionId() << 20
    for batch in batches:
        serial += 1
        if not batch.num_rows:
            continue
        key, rep, n, label = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
        vec = points(batch.column(3))
        if head:  # the block that the last batch ended in goes on
            key, rep, n, label = (np.concatenate([[h], x]) for h, x in zip(head, (key, rep, n, label)))
            vec = np.concatenate([head[4][None], vec])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lead = np.repeat(first, np.diff(np.append(first, len(key))))
        k = int(first[-1])
        head = (key[k], rep[k], n[k], label[k], vec[k])
        ok = _may_link(np.minimum(vec, vec[lead]).sum(1, dtype=np.int64), n + n[lead], percent) & (label != label[lead])
        yield _pairs(rep[lead][ok], rep[ok], key[ok], (serial << 20) + np.arange(len(key))[ok] // SETS)


def _spatial(vec: np.ndarray) -> np.ndarray:
    """An order of the points in which every ``LEAF`` in a row lie close: median
    splits by the coordinate that varies most."""
    order, todo = np.arange(len(vec)), [(0, len(vec))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            continue
        part = order[a:b]
        by = vec[part, int(vec[part].var(0).argmax())]
        order[a:b] = part[np.argsort(by, kind="stable")]
        mid = a + LEAF * (-(-(b - a) // LEAF) // 2)
        todo += [(a, mid), (mid, b)]
    return order


def _padded(keys: list[np.ndarray]) -> np.ndarray:
    """Lists of hashes as rows of one width; a shorter list repeats its last."""
    width = max(map(len, keys))
    return np.stack([np.concatenate([k, np.full(width - len(k), k[-1])]) for k in keys])


TILES = "key bigint, tile bigint, low bigint, high bigint, first bigint, last bigint, sizes binary, reps binary, labels binary, points binary, hashes binary"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, rep, label, point, keys) sorted by key and n, packed by tile."""
    from pyspark import TaskContext

    serial = TaskContext.get().partitionId() << 40
    names = [c.split()[0] for c in TILES.split(", ")]
    held: list[tuple] = []

    def packed(rows):
        nonlocal serial
        serial += 1
        n, rep, label = (np.concatenate([r[i] for r in rows]) for i in (1, 2, 3))
        vec = points([x for r in rows for x in r[4]])
        own = _padded([k for r in rows for k in r[5]])
        if len(n) > LEAF:
            order = _spatial(vec)
            n, rep, label, vec, own = (x[order] for x in (n, rep, label, vec, own))
        ends = int(n.min()), int(n.max()), int(label.min()), int(label.max())
        return rows[0][0], serial, *ends, *(x.tobytes() for x in (n, rep, label, vec, own))

    def table(out):
        columns = zip(*out) if out else [[]] * len(names)
        kinds = [pa.int64()] * 6 + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, n, rep, label = (batch.column(i).to_numpy() for i in range(4))
        raw = batch.column(4).to_pylist()
        at, hashes = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
        cuts = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)]
        total = np.concatenate([[0], np.cumsum(n)])
        out = []
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0][0] != int(key[a]):
                out.append(packed(held))
                held = []
            while a < b:
                room = TILE - sum(len(h[1]) for h in held)
                weight = SHINGLES - sum(int(h[1].sum()) for h in held)
                # up to the row that fills the tile
                c = min(b, a + room, max(a + 1, int(np.searchsorted(total, total[a] + weight, "left"))))
                held.append((int(key[a]), n[a:c], rep[a:c], label[a:c], raw[a:c], [hashes[at[i] : at[i + 1]] for i in range(a, c)]))
                if c - a == room or total[c] - total[a] >= weight:
                    out.append(packed(held))
                    held = []
                a = c
        yield table(out)
    if held:
        yield table([packed(held)])


class Tree:
    """One tile: its rows and, level by level up to the root, the nodes' least
    and greatest coordinates, sizes and components."""

    def __init__(self, sizes: bytes, reps: bytes, labels: bytes, vecs: bytes, hashes: bytes | None = None):
        self.n, self.rep, self.label = (np.frombuffer(x, np.int64) for x in (sizes, reps, labels))
        width = len(vecs) // max(1, len(self.n) * GROUPS)
        self.vec = np.frombuffer(vecs, f"<u{width or 1}").reshape(-1, GROUPS)
        self.keys = None if hashes is None else np.frombuffer(hashes, np.uint64).reshape(len(self.n), -1)
        self.levels = []
        if len(self.n) > LEAF:
            level = tuple((x, x) for x in (self.vec, self.n, self.label))
            step = LEAF
            while not self.levels or len(level[1][0]) > 1:
                at = np.arange(0, len(level[1][0]), step)
                level = tuple((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)) for low, high in level)
                self.levels.append(level)
                step = FAN


def _tree(*columns: bytes) -> Tree:
    return Tree(*columns)


def _below(node: np.ndarray, fan: int, many: int) -> list[np.ndarray]:
    return [np.arange(i * fan, min((i + 1) * fan, many)) for i in node.tolist()]


def _products(p: list[np.ndarray], q: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (child of p[k], child of q[k])."""
    return (
        np.concatenate([np.repeat(a, len(b)) for a, b in zip(p, q)]),
        np.concatenate([np.tile(b, len(a)) for a, b in zip(p, q)]),
    )


def _nodes_meet(x, y, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """May a point below node p of level ``x`` link with one below q of ``y``?"""
    (x_low, x_high), (nx_low, nx_high), (lx_low, lx_high) = x
    (y_low, y_high), (ny_low, ny_high), (ly_low, ly_high) = y
    shared = np.minimum(x_high[p], y_high[q]).sum(1, dtype=np.int64)
    union = np.maximum(x_low[p], y_low[q]).sum(1, dtype=np.int64)
    ok = _may_link(shared, nx_low[p] + ny_low[q], percent) & (100 * shared >= percent * union)
    ok &= (percent * ny_low[q] <= 100 * nx_high[p]) & (percent * nx_low[p] <= 100 * ny_high[q])
    return ok & ~((lx_low[p] == lx_high[p]) & (ly_low[q] == ly_high[q]) & (lx_low[p] == ly_low[q]))


def _owned(x: Tree, y: Tree, p: np.ndarray, q: np.ndarray, key: int) -> np.ndarray:
    """Pairs whose smallest common hash is ``key``: other blocks leave them alone."""
    out = np.ones(len(p), bool)
    for a in range(0, len(p), 4096):
        kx, ky = x.keys[p[a : a + 4096]], y.keys[q[a : a + 4096]]
        smaller = (kx[:, :, None] == ky[:, None, :]) & (kx < np.uint64(key % 2**64))[:, :, None]
        out[a : a + 4096] = ~smaller.any((1, 2))
    return out


def meeting(x: Tree, y: Tree | None, percent: int, key: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs of two trees (``y`` None: of one) that may link and
    whose components differ, from the roots down."""
    same, y = y is None, x if y is None else y
    p = q = np.zeros(1, np.int64)
    dx, dy = len(x.levels), len(y.levels)
    # points are level 0; the taller tree goes down first
    rows = tuple((v, v) for v in (x.vec, x.n, x.label)), tuple((v, v) for v in (y.vec, y.n, y.label))
    if not dx:
        p = np.arange(len(x.n))
    if not dy:
        q = np.arange(len(y.n))
    p, q = np.repeat(p, len(q)), np.tile(q, len(p))
    while len(p):
        lx = x.levels[dx - 1] if dx else rows[0]
        ly = y.levels[dy - 1] if dy else rows[1]
        if same and dx == dy:
            keep = p <= q if dx else p < q
            p, q = p[keep], q[keep]
        if not dx and not dy:
            break
        ok = _nodes_meet(lx, ly, p, q, percent)
        p, q = p[ok], q[ok]
        if not len(p):
            return
        down_x, down_y = dx >= dy and dx > 0, dy >= dx and dy > 0
        fan_x = (FAN if dx > 1 else LEAF) if down_x else 1
        fan_y = (FAN if dy > 1 else LEAF) if down_y else 1
        many_x = len(x.levels[dx - 2][1][0]) if dx > 1 else len(x.n)
        many_y = len(y.levels[dy - 2][1][0]) if dy > 1 else len(y.n)
        px = _below(p, fan_x, many_x) if down_x else [np.array([i]) for i in p.tolist()]
        qy = _below(q, fan_y, many_y) if down_y else [np.array([i]) for i in q.tolist()]
        dx, dy = dx - down_x, dy - down_y
        p, q = _products(px, qy)
    for a in range(0, len(p), 1 << 14):
        i, j = p[a : a + (1 << 14)], q[a : a + (1 << 14)]
        ok = x.label[i] != y.label[j]
        i, j = i[ok], j[ok]
        bound = np.minimum(x.vec[i], y.vec[j]).sum(1, dtype=np.int64)
        ok = _may_link(bound, x.n[i] + y.n[j], percent)
        i, j = i[ok], j[ok]
        if key is not None and len(i):
            ok = _owned(x, y, i, j, key)
            i, j = i[ok], j[ok]
        if len(i):
            yield i, j


def tree_join(x: Tree, y: Tree | None, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The nodes of the pairs that ``meeting`` finds."""
    return [(x.rep[i], (x if y is None else y).rep[j]) for i, j in meeting(x, y, percent)]


#: Sets that a pair of tiles (p, q; q is p for one alone) needs to settle its links.
NEEDS = "p bigint, q bigint, key bigint, side int, rep bigint, label bigint"


def _needs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, tile, its tree[, another tile, its tree]) to the rows of the
    tiles that may link with one another."""
    names = [c.split()[0] for c in NEEDS.split(", ")]
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            key, p, q = row[0], row[1], row[7] if len(row) > 7 else row[1]
            x = Tree(*row[2:7])
            y = Tree(*row[8:]) if len(row) > 7 else None
            used = np.zeros(len(x.n), bool), np.zeros(len(x.n if y is None else y.n), bool)
            for i, j in meeting(x, y, percent, key):
                used[0][i] = True
                used[0 if y is None else 1][j] = True
            for side, tree in enumerate((x, y)):
                at = np.flatnonzero(used[side]) if tree is not None else ()
                if len(at):
                    fixed = [pa.array(np.full(len(at), v, np.int64)) for v in (p, q, key)]
                    columns = [*fixed, pa.array(np.full(len(at), side, np.int32)), pa.array(tree.rep[at]), pa.array(tree.label[at])]
                    yield pa.RecordBatch.from_arrays(columns, names=names)


def settled(key: int, side: np.ndarray, rep: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all components that links between the two sides (or
    within side 0, if there is no other) join; pairs whose smallest common hash
    is not ``key`` belong to other blocks."""
    size = np.array([len(s) for s in sets])
    label, links = label.copy(), []
    alone = not side.any()
    small = len(sets) <= 4
    if not small:
        tree = Tree(size.tobytes(), rep.tobytes(), label.tobytes(), points([_counts(s) for s in sets]).tobytes(), None)
        tree.keys = _padded([s[: prefix_length(len(s), percent)] for s in sets])
        values, number = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(size)])
        seen = np.zeros(len(values), np.int8)
    for i in np.flatnonzero(side == 0).tolist():
        other = label != label[i]
        if alone:
            other[: i + 1] = False
        else:
            other &= side == 1
        other &= (percent * size <= 100 * size[i]) & (percent * size[i] <= 100 * size)
        j = np.flatnonzero(other)
        if small:
            shared = np.array([len(np.intersect1d(sets[i], sets[k], assume_unique=True)) for k in j.tolist()], np.int64)
        elif len(j):
            bound = np.minimum(tree.vec[i], tree.vec[j]).sum(1, dtype=np.int64)
            j = j[_may_link(bound, size[i] + size[j], percent)]
            j = j[_owned(tree, tree, np.full(len(j), i), j, key)]
            if not len(j):
                continue
            mine = number[at[i] : at[i + 1]]
            seen[mine] = 1
            hit = seen[np.concatenate([number[at[k] : at[k + 1]] for k in j.tolist()])]
            shared = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[j])[:-1]]), dtype=np.int64)
            seen[mine] = 0
        if not len(j):
            continue
        for k in j[(shared > 0) & (100 * shared >= percent * (size[i] + size[j] - shared))].tolist():
            if label[k] != label[i]:
                links.append((int(rep[i]), int(rep[k])))
                label[label == label[k]] = label[i]
    return links


def _settled(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (p, q, key, side, rep, label, set) sorted by p, q and side to links.
    A pair of tiles is held at once, which tiles bound."""
    held: list[tuple] = []

    def links(rows):
        side, rep, label = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
        return settled(rows[0][2], side, rep, label, [np.frombuffer(r[6], np.uint64) for r in rows], percent)

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        out = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if held and held[0][:2] != row[:2]:
                out += links(held)
                held = []
            held.append(row)
        yield table(out)
    if held:
        yield table(links(held))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text, digest) to the sets that have that digest."""
    for batch in batches:
        body, at = utf8(batch.column(1))
        for a, b in spans(at):
            sets = shingle_sets(body, at[a : b + 1])
            own = pa.array([_digest(s) == d for s, d in zip(sets, batch.column(2).slice(a, b - a).to_pylist())], pa.bool_())
            out = [batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.filter(own) for c in out], names=["id", "set"])


def _verified(percent: int):
    def verify(pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        sets = {i: np.frombuffer(x, np.uint64) for i, x in zip(members["id"], members["set"])}
        keep = np.zeros(len(pairs), bool)
        for k, (a, b) in enumerate(zip(pairs["a"], pairs["b"])):
            x, y = sets.get(a), sets.get(b)
            if x is None or y is None:
                continue
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(y, x)
            shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            keep[k] = shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)
        return pairs.loc[keep, ["a", "b"]]

    return verify


# ------------------------------------------------------------------ operator


def mark(text) -> F.Column:
    """A text's hash, by which rows that share an id are told apart."""
    return F.xxhash64(text)


def _sets_of(rows: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set) of the nodes ``wanted`` (rep)."""
    wanted = wanted.distinct().join(reps.select("rep", "id", "mark", "digest"), "rep")
    sets = rows.join(wanted, ["id", "mark"]).select("rep", "text", "digest").mapInArrow(_sets, "id bigint, set binary")
    return materialise(sets, "join-sets")


def _links(rows: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs of a star round whose full sets reach the threshold.

    A pair found in several places is checked in the first of them.  Pairs of
    one place share a set: each group of places gets every set that it needs
    once, not once per pair.
    """
    pairs = materialise(
        pairs.groupBy("a", "b").agg(F.min(F.struct("place", "part")).alias("at")).select("a", "b", F.xxhash64("at.place", "at.part").alias("at")),
        "join-pairs",
    )
    need = pairs.select("at", F.col("a").alias("id")).union(pairs.select("at", "b")).distinct()
    sets = _sets_of(rows, reps, need.select(F.col("id").alias("rep")))
    groups = max(1, -(-need.count() // SETS))
    group = F.pmod("at", F.lit(groups)).alias("group")
    members = need.select(group, "id").distinct().join(sets, "id")
    return materialise(
        pairs.select(group, "a", "b").groupBy("group").cogroup(members.groupBy("group"))
        .applyInPandas(_verified(percent), "a bigint, b bigint"),
        "join-links",
    )


def _settle(rows: DataFrame, reps: DataFrame, needs: DataFrame, percent: int) -> DataFrame:
    """Links between components, settled per pair of tiles on the full sets."""
    sets = _sets_of(rows, reps, needs.select("rep")).withColumnRenamed("id", "rep")
    full = needs.join(sets, "rep").select("p", "q", "key", "side", "rep", "label", "set")
    return materialise(
        full.repartition("p", "q").sortWithinPartitions("p", "q", "side", "rep").mapInArrow(lambda it: _settled(it, percent), "a bigint, b bigint"),
        "join-links",
    )


def _open(blocks: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of blocks that hold several components, with their labels."""
    marked = blocks.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    return marked.join(mixed, "key").select("key", "rep", "n", "label")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, mark_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n (set size), component (smallest linked
    id); ``mark_col``: also the ``mark`` of its text."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), mark(F.col(text_col)).alias("mark"))
    profile = materialise(
        rows.mapInArrow(
            lambda it: _profiles(it, percent), "id bigint, mark bigint, n bigint, digest binary, keys array<bigint>, point binary"
        ),
        "join-profiles",
    )
    reps = materialise(
        profile.where("n > 0 AND id IS NOT NULL").groupBy("digest")
        .agg(F.min(F.struct("id", "mark")).alias("at"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("point").alias("point"))
        .select("digest", "at.id", "at.mark", F.monotonically_increasing_id().alias("rep"), "n", "keys", "point"),
        "join-reps",
    )
    keyed = reps.select("rep", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    # points are many times as wide: they join the rows of open blocks only
    blocks = materialise(keyed.join(shared, "key").select("key", "rep", "n"), "join-blocks")

    label = spark.createDataFrame([], "node bigint, label bigint")
    links = spark.createDataFrame([], "a bigint, b bigint")
    for turn in range(STAR_ROUNDS):
        order = F.xxhash64("rep", F.lit(turn), F.pmod("key", F.lit(ORDERS)))
        stars = (
            _open(blocks, label).join(reps.select("rep", "point"), "rep").select("key", "rep", "n", "point", "label")
            .repartitionByRange(F.col("key"), order).sortWithinPartitions("key", order)
            .mapInArrow(lambda it: _stars(it, percent), PAIRS)
        )
        found = _links(rows, reps, stars, percent)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        label = materialise(components(links), "join-labels")

    open_rows = _open(blocks, label).join(reps.select("rep", "point", "keys"), "rep").select("key", "n", "rep", "label", "point", "keys")
    tiles = materialise(
        open_rows.repartitionByRange("key", "n", "rep").sortWithinPartitions("key", "n", "rep").mapInArrow(_tiles, TILES), "join-tiles"
    )
    tree = ["sizes", "reps", "labels", "points", "hashes"]
    # a tile that is one component has nothing to settle
    alone = tiles.where("first < last").select("key", "tile", *tree).repartition(F.xxhash64("tile"))
    at = tiles.select("key", "tile", "low", "high", "first", "last")
    meet = (
        at.alias("p").join(at.alias("q"), F.col("p.key") == F.col("q.key"))
        .where((F.col("p.tile") < F.col("q.tile")) & (percent * F.col("p.low") <= 100 * F.col("q.high")) & (percent * F.col("q.low") <= 100 * F.col("p.high")))
        .where(F.least("p.first", "q.first") < F.greatest("p.last", "q.last"))
        .select(F.col("p.tile").alias("p"), F.col("q.tile").alias("q"))
    )
    across = (
        meet.join(tiles.select("key", F.col("tile").alias("p"), *tree), "p")
        .join(tiles.select(F.col("tile").alias("q"), *[F.col(c).alias(f"{c}_q") for c in tree]), "q")
        .select("key", "p", *tree, "q", *[f"{c}_q" for c in tree])
    )
    needs = materialise(
        alone.mapInArrow(lambda it: _needs(it, percent), NEEDS).unionByName(across.mapInArrow(lambda it: _needs(it, percent), NEEDS)), "join-needs"
    )
    more = _settle(rows, reps, needs, percent)
    if not more.isEmpty():
        # the components so far are stars already: few rounds are left
        stars = label.select(F.col("label").alias("a"), F.col("node").alias("b"))
        label = materialise(components(stars.unionByName(more)), "join-labels")

    label = label.withColumnRenamed("node", "rep")
    least = label.join(reps.select("rep", "id"), "rep").groupBy("label").agg(F.min("id").alias("least"))
    of_set = reps.select("digest", "rep", "id").join(label.join(least, "label"), "rep", "left").select(
        "digest", F.coalesce("least", "id").alias("component")
    )
    marked = [F.col("mark").alias(mark_col)] if mark_col else []
    return profile.select("id", "mark", "n", "digest").join(of_set, "digest", "left").select(
        "id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"), *marked
    )
