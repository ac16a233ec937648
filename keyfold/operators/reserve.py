"""Stock reservation per item (J1, P8, P9, W1a, W1b, A5; rules R1-R4, R12).

A request for ``q`` is all-or-nothing: with stock ``s >= q`` it is granted
and ``s -= q`` (INSTOCK), otherwise nothing changes (OUTOFSTOCK).  A restock
adds when the profile applies it.  Events of an item are settled in the
total order ``(ts, event_id)``.

* W1a, unit demand (every request <= 1): the stock is a counter floored at
  zero, so it is a running sum and a running minimum -- pure window work via
  the skew-safe two-level scan of ``scan.reflected_level``.
* W1b, any demand: not associative.  Rows are range-partitioned by item and
  time.  Every item that starts inside a range is folded there at once; what a
  range continues from the one before (its first group) waits for its incoming
  stock.  These groups are then folded in parallel from guessed stocks, and
  again where a guess proves wrong, until all agree: see ``reserve_fold_ranged``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.operators import scan
from keyfold.profiles import Profile
from keyfold.session import ship_package, write_table

KEY = "item_id"
INSTOCK, OUTOFSTOCK = "INSTOCK", "OUTOFSTOCK"

SETTLED_COLS = [
    "event_id", "ts", "ts_ms", "kind", "user_id", "item_id", "requested", "restock", "status", "stock_after",
]


def requested_quantity(q, demand: str):
    """What the cart asks the stock for."""
    q = F.col(q) if isinstance(q, str) else q
    if demand == "unit":
        return F.when(q < 0, q).otherwise(F.lit(1)).cast("int")
    return q.cast("int")


def stock_rows(domain: DataFrame, profile: Profile, keep: tuple[str, ...] = (), wrap=None) -> DataFrame:
    """Rows the stock function sees: adds (as requests) and, if applied, restocks.

    ``keep`` carries extra columns through (e.g. a watermarked event time);
    ``wrap`` transforms the filter predicate (see ``pipeline.after_watermark``).
    """
    kinds = ["add", "restock"] if profile.restock_applies else ["add"]
    pred = F.col("kind").isin(*kinds) & F.col("item_id").isNotNull()
    return (
        domain.where(wrap(pred) if wrap else pred)
        .select(
            "event_id", "ts", "ts_ms", "kind", "user_id", "item_id",
            F.when(F.col("kind") == "add", requested_quantity("quantity", profile.demand)).alias("requested"),
            F.when(F.col("kind") == "restock", F.col("quantity")).cast("int").alias("restock"),
            *keep,
        )
    )


def reserve(
    domain: DataFrame,
    profile: Profile,
    method: str = "auto",
    chunking: scan.Chunking | None = None,
) -> DataFrame:
    """Settle every add against the stock of its item; returns SETTLED_COLS.

    ``status`` is NULL on restock rows; ``stock_after`` is the stock after
    the row.  ``method``: "unit" (W1a), "fold" (W1b) or "auto" (W1a for
    unit-demand profiles, W1b otherwise).
    """
    if profile.demand == "echo":
        raise ValueError("echo profiles reserve nothing")
    if method == "auto":
        method = "unit" if profile.demand == "unit" else "fold"
    if method == "unit" and profile.demand != "unit":
        raise ValueError("the unit method settles requests of at most one item only")
    if profile.restock_applies and profile.restock_qty < 0 or profile.initial_stock < 0:
        raise ValueError("stocks and restocks must not be negative")
    rows = stock_rows(domain, profile)
    if chunking is None:
        chunking = scan.choose_chunking(rows)
    if method == "unit":
        return reserve_unit(rows, profile.initial_stock, chunking)
    if method == "fold":
        if chunking.single:
            return reserve_fold(rows, profile.initial_stock)
        return reserve_fold_ranged(rows, profile.initial_stock, chunking.ranges)
    raise ValueError(method)


def reserve_unit(rows: DataFrame, init: int, chunking: scan.Chunking) -> DataFrame:
    """W1a.  Valid only when every request is <= 1 (unit demand, R12 negatives)."""
    delta = F.when(F.col("kind") == "add", -F.col("requested")).otherwise(F.col("restock"))
    lv = scan.reflected_level(rows, [KEY], delta, init, chunking)
    status = F.when(
        F.col("kind") == "add",
        F.when(F.col("_m") == F.col("_m_prev"), F.lit(INSTOCK)).otherwise(F.lit(OUTOFSTOCK)),
    )
    return lv.select(
        *[c for c in SETTLED_COLS if c not in ("status", "stock_after")],
        status.alias("status"),
        (F.col("_level") - F.col("_m")).alias("stock_after"),
    )


_FOLD_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("requested", T.IntegerType()),
        T.StructField("restock", T.IntegerType()),
        T.StructField("_granted", T.BooleanType()),
        T.StructField("stock_after", T.LongType()),
    ]
)


def _status_from_granted(df: DataFrame) -> DataFrame:
    """Status text from the fold's boolean (kept JVM-side)."""
    st = F.when(
        F.col("kind") == "add", F.when(F.col("_granted"), F.lit(INSTOCK)).otherwise(F.lit(OUTOFSTOCK))
    )
    return df.withColumn("status", st).drop("_granted")


FOLD_BLOCK = 64
FOLD_BLOCK_MAX = 8192


def settle_run(s: int, delta: np.ndarray, is_add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordered all-or-nothing settling of one run of rows from stock ``s``.

    ``delta`` is what a row does to the stock if granted.  While every request
    is granted the stock is a cumulative sum; the first add at which that sum
    falls below zero is refused, and the sum begins anew behind it.  Work is
    vectorized between refusals, and over those that follow one another, in
    blocks that double while the run goes on.  Returns (granted, stock after each row).
    """
    n = len(delta)
    ok, after = np.zeros(n, dtype=bool), np.empty(n, dtype=np.int64)
    i, step = 0, FOLD_BLOCK
    while i < n:
        j = min(n, i + step)
        level = s + np.cumsum(delta[i:j])
        refused = np.flatnonzero(is_add[i:j] & (level < 0))
        if len(refused):
            t = i + int(refused[0])
            step = FOLD_BLOCK
        else:
            t = j
            step = min(step * 2, FOLD_BLOCK_MAX)
        after[i:t], ok[i:t] = level[: t - i], is_add[i:t]
        if t > i:
            s = int(level[t - i - 1])
        if t < j:
            # the refused add, and all that ask for more than the same stock
            width = FOLD_BLOCK
            while t < n:
                more = is_add[t : t + width] & (s + delta[t : t + width] < 0)
                k = len(more) if more.all() else int(np.argmin(more))
                after[t : t + k] = s
                t += k
                if k < len(more):
                    break
                width = min(width * 2, FOLD_BLOCK_MAX)
        i = t
    return ok, after


def _deltas(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    is_add = pdf["_add"].to_numpy(dtype=bool)
    req = pdf["requested"].fillna(0).to_numpy(dtype=np.int64)
    rst = pdf["restock"].fillna(0).to_numpy(dtype=np.int64)
    return np.where(is_add, -req, rst), is_add


def _changes(pdf: pd.DataFrame, keys: list[str], last: tuple | None) -> np.ndarray:
    """True on the first row of each run of equal keys."""
    out = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        x = pdf[k].to_numpy()
        out[1:] |= x[1:] != x[:-1]
    out[0] = last is None or last != tuple(pdf[k].iloc[0] for k in keys)
    return out


def _fold_partition(batches: Iterator[pd.DataFrame], keys: tuple[str, ...] = (KEY,)) -> Iterator[pd.DataFrame]:
    """Ordered fold over rows sorted by (keys, ts, event_id).

    ``_S`` on the first row of a group is its incoming stock.  The carried
    state (current group, stock) crosses batch borders.
    """
    last, s = None, 0
    for pdf in batches:
        if pdf.empty:
            continue
        delta, is_add = _deltas(pdf)
        start = pdf["_S"].to_numpy(dtype=np.int64)
        first = _changes(pdf, list(keys), last)
        cuts = [0, *(int(i) for i in np.flatnonzero(first) if i), len(pdf)]
        ok, after = np.zeros(len(pdf), dtype=bool), np.empty(len(pdf), dtype=np.int64)
        for i, j in zip(cuts, cuts[1:]):
            if first[i]:
                s = int(start[i])
            ok[i:j], after[i:j] = settle_run(s, delta[i:j], is_add[i:j])
            s = int(after[j - 1])
        last = tuple(pdf[k].iloc[-1] for k in keys)
        out = pdf.drop(columns=["_S", "_add"])
        out["_granted"] = ok
        out["stock_after"] = after
        yield out


def reserve_fold(rows: DataFrame, init: int) -> DataFrame:
    """W1b as one fold per item (the reference form; an item is one task)."""
    ship_package(rows.sparkSession)
    cols = [c for c in SETTLED_COLS if c not in ("status", "stock_after")]
    return _status_from_granted(
        rows.select(*cols, F.lit(int(init)).cast("long").alias("_S"), (F.col("kind") == "add").alias("_add"))
        .repartition(KEY)
        .sortWithinPartitions(KEY, *scan.ORDER)
        .mapInPandas(_fold_partition, _FOLD_SCHEMA)
    ).select(*SETTLED_COLS)


def item_outcomes(settled: DataFrame) -> DataFrame:
    """A5 + counts: per item accepted / rejected adds and final stock.

    ``max_by`` over the total order is a plain aggregate: partial aggregation
    runs map-side, so a hot item costs one small row per task.
    """
    return settled.groupBy(KEY).agg(
        F.sum(F.when(F.col("status") == INSTOCK, 1).otherwise(0)).cast("long").alias("n_accepted"),
        F.sum(F.when(F.col("status") == OUTOFSTOCK, 1).otherwise(0)).cast("long").alias("n_rejected"),
        F.max_by("stock_after", F.struct(*scan.ORDER)).cast("long").alias("final_stock"),
    )


# ------------------------------------------------------------ range layout
def _fold_ranged_fn(init: int):
    """Per-partition pass over rows range-partitioned and sorted by
    (item, ts, event_id): every item group that starts in this partition is
    folded from ``init`` (exact); the partition's first group may continue an
    item from earlier partitions, so it is left pending with its local
    all-granted prefix ``_lD``."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, s, pending, carry = None, 0, False, 0
        for pdf in batches:
            if pdf.empty:
                continue
            n = len(pdf)
            delta, is_add = _deltas(pdf)
            first = _changes(pdf, [KEY], last)
            cuts = [0, *(int(i) for i in np.flatnonzero(first) if i), n]
            ok, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
            pend, ld = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
            for i, j in zip(cuts, cuts[1:]):
                if first[i]:
                    pending = last is None and i == 0
                    s, carry = int(init), 0
                if pending:
                    ld[i:j] = np.cumsum(delta[i:j]) + carry
                    carry = int(ld[j - 1])
                    pend[i:j] = True
                else:
                    ok[i:j], after[i:j] = settle_run(s, delta[i:j], is_add[i:j])
                    s = int(after[j - 1])
            last = (pdf[KEY].iloc[-1],)
            out = pdf.copy(deep=False)
            out["_granted"], out["stock_after"] = ok, after
            out["_pid"], out["_pending"], out["_lD"], out["_D"] = pid, pend, ld, delta
            yield out

    return fn


_GUESS = f"{KEY} long, _pid int, _S long, _known boolean"


def _walk_fn(init: int):
    def walk(groups: pd.DataFrame, tried: pd.DataFrame) -> pd.DataFrame:
        """One item's border groups in range order: incoming stock of each
        pending group.  A group whose stock covers its requests is granted
        whole; one that was folded from this very stock gives the stock it
        ended with; else its end is guessed (from another try, or as if all
        were granted) and the group is marked as not known."""
        ends = {(p, s): e for p, s, e in zip(tried["_pid"], tried["_S"], tried["_end"])}
        near = {p: e for p, e in zip(tried["_pid"], tried["_end"])}
        s, out = int(init), []
        for g in groups.sort_values("_pid").itertuples():
            if not g.pending:
                s = int(g.ended)
                continue
            covered = s + int(g.low) >= 0
            known = covered or (g.pid, s) in ends
            out.append((g.item, g.pid, s, known))
            if covered:
                s += int(g.total)
            else:
                s = int(ends.get((g.pid, s), near.get(g.pid, max(0, s + int(g.total)))))
        return pd.DataFrame(out, columns=[KEY, "_pid", "_S", "_known"])

    return walk


def _group_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last row of each (item, range) group of a fold."""
    held = None
    for pdf in _fold_partition(batches, (KEY, "_pid")):
        both = pdf if held is None else pd.concat([held, pdf])
        last = ~both.duplicated([KEY, "_pid"], keep="last")
        ends = both[last]
        held = ends.iloc[-1:]
        yield ends.iloc[:-1][[KEY, "_pid", "_from", "stock_after"]]
    if held is not None:
        yield held[[KEY, "_pid", "_from", "stock_after"]]


def reserve_fold_ranged(rows: DataFrame, init: int, partitions: int) -> DataFrame:
    """W1b on the range layout: no task ever holds an item, only a range.

    The border groups (each range's first group and last item, at most two
    rows a range) are walked per item with a guess for every group that is not
    settled; all groups with a new guess are folded in parallel; and so on
    until the walk meets only known ends.  Each turn settles at least the next
    unknown group of every item, and folds from different stocks tend to meet,
    so few turns are needed; there is no limit on them.
    """
    ship_package(rows.sparkSession)
    spark = rows.sparkSession
    cols = [c for c in SETTLED_COLS if c not in ("status", "stock_after")]
    schema = T.StructType(
        [f for f in _FOLD_SCHEMA.fields]
        + [
            T.StructField("_add", T.BooleanType()),
            T.StructField("_pid", T.IntegerType()),
            T.StructField("_pending", T.BooleanType()),
            T.StructField("_lD", T.LongType()),
            T.StructField("_D", T.LongType()),
        ]
    )
    local = write_table(
        rows.select(*cols, (F.col("kind") == "add").alias("_add"))
        .repartitionByRange(partitions, KEY, *scan.ORDER)
        .sortWithinPartitions(KEY, *scan.ORDER)
        .mapInPandas(_fold_ranged_fn(init), schema),
        "reserve-pass",
    )
    last = local.groupBy("_pid").agg(F.max(KEY).alias("_last"))
    groups = write_table(
        local.join(F.broadcast(last), "_pid")  # one row per range
        .where(F.col("_pending") | (F.col(KEY) == F.col("_last")))
        .groupBy(KEY, "_pid")
        .agg(
            F.max("_pending").alias("pending"),
            F.sum("_D").alias("total"),
            F.coalesce(F.min(F.when(F.col("_add"), F.col("_lD"))), F.lit(0).cast("long")).alias("low"),
            F.max_by("stock_after", F.struct(*scan.ORDER)).alias("ended"),
        )
        .withColumns({"item": F.col(KEY), "pid": F.col("_pid")}),
        "reserve-groups",
    )
    waiting = write_table(local.where("_pending").select(*cols, "_add", "_pid", "_lD"), "reserve-waiting")
    tried = spark.createDataFrame([], f"{KEY} long, _pid int, _S long, _end long")
    fold_schema = T.StructType([*_FOLD_SCHEMA.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_from", T.LongType())])

    def laid_out(guess: DataFrame) -> DataFrame:
        # at most one row per range on the right: small beside the rows
        return (
            waiting.drop("_lD").join(guess.select(KEY, "_pid", "_S"), [KEY, "_pid"])
            .select(*cols, "_pid", F.col("_S").alias("_from"), "_S", "_add")
            .repartition(KEY, "_pid").sortWithinPartitions(KEY, "_pid", *scan.ORDER)
        )

    while True:
        guess = write_table(
            groups.groupBy(KEY).cogroup(tried.groupBy(KEY)).applyInPandas(_walk_fn(init), _GUESS), "reserve-guess"
        )
        todo = guess.where(~F.col("_known"))
        if todo.isEmpty():
            break
        ends = laid_out(todo).mapInPandas(_group_end, f"{KEY} long, _pid int, _from long, stock_after long")
        tried = write_table(
            tried.unionByName(ends.select(KEY, "_pid", F.col("_from").alias("_S"), F.col("stock_after").alias("_end"))),
            "reserve-tried",
        )
    marked = guess.join(groups.select(KEY, "_pid", "low"), [KEY, "_pid"])
    covered = F.col("_S") + F.col("low") >= 0
    whole = waiting.join(marked.where(covered).select(KEY, "_pid", "_S"), [KEY, "_pid"]).select(
        *cols, F.when(F.col("_add"), F.lit(INSTOCK)).alias("status"), (F.col("_S") + F.col("_lD")).alias("stock_after")
    )
    folded = _status_from_granted(
        laid_out(marked.where(~covered)).mapInPandas(lambda it: _fold_partition(it, (KEY, "_pid")), fold_schema)
    ).select(*SETTLED_COLS)
    done = _status_from_granted(local.where(~F.col("_pending"))).select(*SETTLED_COLS)
    return done.unionByName(whole).unionByName(folded)
