"""Exact top-k search by columnar branch and bound.

Vectors become integers floor(scale * x); the score is the inner product.
Candidates are packed into blocks in vertical layout: one row of numbers per
dimension.  A task accumulates the scores of its candidates one block of
dimensions after another.  Behind each block the unread dimensions can add at
most |q_rest| * |c_rest| (the remaining mass, Cauchy-Schwarz); a candidate whose
bound is under a query's k-th best score so far is dropped, and the survivors
are compacted: first whole columns that no query of the tile still needs, then,
once few pairs are left, the single pairs.  Sums of integers below 2**53 are
exact in doubles, which holds for any two vectors with less than ``HEAVY`` as sum
of squares.  Only pairs with a heavier vector are summed as Python integers.

Queries are a stated set.  They are dealt into chunks of about ``CHUNK`` by a
hash; each chunk (a bounded number of vectors) is sent to all tasks, which
report their k best per query; the final k come from a window per query.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; vectors of another length than the query's are not
compared with it; a row's id and vector make it a candidate (repeated rows are
candidates each); a query id that repeats gives one query per distinct vector,
and rows with a query's own id are never its answers; rows without an id take
no part; ties go to the smaller id; scores beyond 64 bits are ranked by their exact
value and returned as the nearest 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.llm.common import materialise, scratch
from keyfold.session import ship_package

CHUNK, BLOCK_ROWS, TILE, DIMS = 2048, 4096, 64, 16
HEAVY = 2.0**51
#: Share of live pairs under which pairs are handled one by one.
SPARSE = 0.05


def _tile_scores(q: np.ndarray, c: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, candidate, score) that may reach ``floor`` (per query);
    every pair that does is among them.  ``c`` has dimensions as rows."""
    n_q, dims = q.shape
    cuts = [*range(0, dims, DIMS), dims]
    # mass of the dimensions from each cut on
    rest_q = np.sqrt(np.stack([(q[:, a:] ** 2).sum(1) for a in cuts]))
    rest_c = np.sqrt(np.stack([(c[a:] ** 2).sum(0) for a in cuts]))
    cols = np.arange(c.shape[1])
    score = np.zeros((n_q, len(cols)))
    for step, (a, b) in enumerate(zip(cuts, cuts[1:])):
        score += q[:, a:b] @ c[a:b]
        if b == dims:
            break
        # a hair is added for the rounding of the roots
        live = score + rest_q[step + 1][:, None] * rest_c[step + 1][cols] * (1 + 1e-9) + 1e-6 >= floor[:, None]
        need = live.any(0)
        if not need.all():
            cols, c, score, live = cols[need], c[:, need], score[:, need], live[:, need]
        if not len(cols):
            break
        if live.mean() < SPARSE:
            qi, ci = np.nonzero(live)
            part = score[qi, ci]
            for step2, (a, b) in enumerate(zip(cuts[step + 1 :], cuts[step + 2 :]), step + 1):
                part = part + np.einsum("ij,ji->i", q[qi, a:b], c[a:b, ci])
                keep = part + rest_q[step2 + 1][qi] * rest_c[step2 + 1][cols[ci]] * (1 + 1e-9) + 1e-6 >= floor[qi]
                qi, ci, part = qi[keep], ci[keep], part[keep]
            return qi, cols[ci], part
    qi, ci = np.nonzero(score >= floor[:, None])
    return qi, cols[ci], score[qi, ci]


def _best(qi, ids, score, k: int):
    """The k best (score down, id up) of each query."""
    order = np.lexsort((ids, -score, qi))
    qi, ids, score = qi[order], ids[order], score[order]
    first = np.searchsorted(qi, qi)
    keep = np.arange(len(qi)) - first < k
    return qi[keep], ids[keep], score[keep]


class _Search:
    """The k best of one chunk of queries over the blocks fed to it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        none = np.zeros(0, np.int64)
        self.best = none, none, np.zeros(0)
        self.floor = np.full(len(ids), -np.inf)

    def feed(self, ids: np.ndarray, c: np.ndarray) -> None:
        order = np.argsort(-(c**2).sum(0), kind="stable")  # heavy vectors first raise the floors early
        ids, c = ids[order], c[:, order]
        for start in range(0, len(ids), 1024):
            sub = slice(start, start + 1024)
            found = [self.best]
            for a in range(0, len(self.ids), TILE):
                qi, ci, s = _tile_scores(self.q[a : a + TILE], c[:, sub], self.floor[a : a + TILE])
                who = ids[sub][ci]
                other = who != self.ids[a + qi]
                found.append((a + qi[other], who[other], s[other]))
            self.best = _best(*(np.concatenate(x) for x in zip(*found)), self.k)
            qi, _, s = self.best
            last = np.append(qi[1:] != qi[:-1], True) if len(qi) else np.zeros(0, bool)
            full = np.bincount(qi, minlength=len(self.ids)) == self.k
            at = np.flatnonzero(last)
            self.floor[qi[at]] = np.where(full[qi[at]], s[at], -np.inf)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def usable(vec: Column, scale: int) -> Column:
    """The vector scaled, as doubles, its components floored where a double has
    a fraction at all; null where it takes no part."""
    scaled = F.transform(vec, lambda x: x.cast("double") * scale)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.when((F.size(vec) > 0) & F.coalesce(fine, F.lit(False)), whole)


def _integers(whole: np.ndarray, raw: np.ndarray, scale: int) -> list[int]:
    """Exact components; those whose scaled double is infinite are scaled here."""
    return [int(x) * scale if np.isinf(w) else int(w) for w, x in zip(whole, raw)]


def _wide(score: int) -> str:
    """Orders, as text, scores that are the same when cut to 64 bits."""
    if -(2**63) <= score < 2**63:
        return "" if score >= 0 else "~"
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):04d}{digits}"
    return f"{9999 - len(digits):04d}" + "".join(str(9 - int(d)) for d in digits)


def _exact(asked: list[tuple[int, int, list[int]]], others: list[tuple[int, list[int]]], k: int):
    """Python integers throughout: (query number, candidate, score), k best each."""
    for number, own, v in asked:
        found = sorted((-sum(a * b for a, b in zip(v, c)), r) for r, c in others if r != own)[:k]
        yield from ((number, r, -s) for s, r in found)


FOUND = "query_id bigint, query_no bigint, id bigint, score bigint, wide string"


class _Asked:
    """The queries of one length in a chunk, light and heavy ones."""

    def __init__(self, rows: pd.DataFrame, scale: int):
        self.ids, self.heavy = rows["id"].to_numpy(), rows["heavy"].to_numpy(bool)
        vec = _matrix(rows["vec"])
        self.light_at = np.flatnonzero(~self.heavy)
        self.light = vec[self.light_at]
        self.raw, self.vec, self.scale = list(rows["raw"]), vec, scale

    def integers(self, at) -> list[tuple[int, int, list[int]]]:
        return [(int(i), int(self.ids[i]), _integers(self.vec[i], self.raw[i], self.scale)) for i in at]


def _searched(batches: Iterator[pd.DataFrame], chunk: dict[int, _Asked], k: int):
    searches = {n: _Search(a.ids[a.light_at], a.light, k) for n, a in chunk.items()}
    held: dict[int, list[tuple[int, int, int]]] = {n: [] for n in chunk}

    def others(part, scale):
        return [(int(i), _integers(np.asarray(v, float), x, scale)) for i, v, x in zip(part["id"], part["vec"], part["raw"])]

    for batch in batches:
        for n, rows in batch.groupby("n", sort=False):
            if n not in chunk:
                continue
            asked = chunk[n]
            light, heavy = rows[~rows["heavy"].astype(bool)], rows[rows["heavy"].astype(bool)]
            for at in range(0, len(light), BLOCK_ROWS):
                part = light.iloc[at : at + BLOCK_ROWS]
                searches[n].feed(part["id"].to_numpy(), np.ascontiguousarray(_matrix(part["vec"]).T))
            # pairs with a heavy vector: heavy candidates with all queries, heavy queries with the rest
            found = held[n]
            if len(heavy):
                found += _exact(asked.integers(range(len(asked.ids))), others(heavy, asked.scale), k)
            if asked.heavy.any() and len(light):
                found += _exact(asked.integers(np.flatnonzero(asked.heavy)), others(light, asked.scale), k)
            found.sort(key=lambda f: (f[0], -f[2], f[1]))
            seen: dict[int, int] = {}
            held[n] = [f for f in found if seen.setdefault(f[0], 0) < k and not seen.update({f[0]: seen[f[0]] + 1})]
    for n, s in searches.items():
        asked, (qi, ids, score) = chunk[n], s.best
        rows = [*zip(asked.light_at[qi].tolist(), ids.tolist(), map(int, score)), *held[n]]
        yield pd.DataFrame(
            [(int(asked.ids[q]), q, i, min(max(x, -(2**63)), 2**63 - 1), _wide(x)) for q, i, x in rows],
            columns=["query_id", "query_no", "id", "score", "wide"],
        )


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, id, score: each query's ``k`` best among all other rows."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = materialise(
        vectors.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("id"), is_query.alias("asks"), usable(F.col(vec_col), scale).alias("vec"), F.col(vec_col).cast("array<double>").alias("raw"))
        .where("vec IS NOT NULL").withColumn("n", F.size("vec"))
        .withColumn("heavy", F.aggregate("vec", F.lit(0.0), lambda have, x: have + x * x) >= HEAVY)
        # only the components of heavy vectors are read again unscaled
        .withColumn("raw", F.when(F.col("heavy"), F.col("raw")).otherwise(F.col("vec"))),
        "search-vectors",
    )
    queries = rows.where("asks").select("id", "n", "vec", "raw", "heavy").distinct()
    chunks = -(-queries.count() // chunk)
    base = scratch(spark, "search-found")
    for number in range(chunks):
        # about ``chunk`` vectors: the bound on what goes to the driver and every task
        got = queries.where(F.pmod(F.xxhash64("id", "vec"), F.lit(chunks)) == number).toPandas().sort_values("id", kind="stable")
        sent = {int(n): _Asked(g, scale) for n, g in got.groupby("n")}
        found = rows.select("id", "n", "vec", "raw", "heavy").mapInPandas(lambda it, s=sent: _searched(it, s, k), FOUND)
        found.write.parquet(f"{base}/chunk={number}")
    if not chunks:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    found = spark.read.schema(f"{FOUND}, chunk int").parquet(base)
    order = W.partitionBy("chunk", "query_id", "query_no").orderBy(F.desc("score"), F.desc("wide"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
