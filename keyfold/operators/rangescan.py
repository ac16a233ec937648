"""Range-partitioned prefix scans: skew-safe for hot keys and hot time buckets.

Rows are range-partitioned on ``(keys..., ts, event_id)`` -- Spark samples
the keys and cuts equal-sized contiguous ranges, so a hot key spans many
partitions and a burst of one key at one instant is split too (``event_id``
breaks timestamp ties).  Then:

1. one pass per partition (rows sorted within it) computes, per key, the
   local inclusive / exclusive prefix sums and the running minimum of a
   prefix -- vectorized pandas group-wise ``cumsum`` / ``cummin`` over Arrow
   batches, state carried across batch borders;
2. a summary per ``(key, partition)`` gives totals and the lowest local
   prefix.  Only keys that span a partition border need an offset, and each
   partition has at most two border keys (its first and last), so only
   those rows are aggregated and the offset table has at most
   ``2 * partitions`` rows: a proven bound, broadcast;
3. offsets (sum of earlier partitions' totals, lowest prefix before) are
   joined back; rows of all other keys keep offset 0.

Steps 2 and 3 both read the pass output, and range bounds come from a
sample whose seed depends on the plan instance -- two evaluations would cut
different ranges.  The pass output is therefore written once to the shared
folder (``session.write_table``) and both consumers read that table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PID = "_pid"


def _prefix_fn(keys: list[str], vals: list[str], excl: set[str], min_of: str | None):
    """Per-partition pass over rows sorted by (keys, ts, event_id).

    Pure numpy per Arrow batch: segmented cumulative sums subtract each
    group's starting total; segmented running minima shift every later group
    down by more than the batch's value range, so one running minimum
    restarts at each group.  State of the open key crosses batch borders.
    """

    def fn(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_key = None
        carry = {v: 0 for v in vals}  # inclusive sums of the open key
        carry_min = None  # running min of the open key's min_of prefix
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            change = np.zeros(n, dtype=bool)
            for c in keys:
                a = pdf[c].to_numpy()
                change[1:] |= a[1:] != a[:-1]
            first_key = tuple(pdf[c].iloc[0] for c in keys)
            cont = last_key is not None and first_key == last_key
            change[0] = not cont
            gidx = np.cumsum(change) - (1 if change[0] else 0)  # 0-based group index
            starts = np.flatnonzero(change)
            first = gidx == 0
            res = pdf.copy(deep=False)
            res[PID] = np.int32(pid)
            inc_of = {}
            for v in vals:
                x = pdf[v].fillna(0).to_numpy(dtype=np.int64)
                cs = np.cumsum(x)
                base = np.zeros(gidx[-1] + 1, dtype=np.int64)
                # total before each group's first row (group 0 starts the batch unless it continues)
                base_rows = cs[starts] - x[starts]
                base[gidx[starts]] = base_rows
                inc = cs - base[gidx]
                if cont:
                    inc[first] += carry[v]
                inc_of[v] = inc
                res[f"_l{v}"] = inc - x if v in excl else inc
                carry[v] = int(inc[-1])
            if min_of is not None:
                lv = inc_of[min_of]
                span = int(np.abs(lv).max()) + 1
                if cont and carry_min is not None:
                    span = max(span, abs(int(carry_min)) + 1)
                big = 4 * span
                shifted = lv - big * gidx
                if cont and carry_min is not None:
                    shifted[0] = min(shifted[0], carry_min)  # group 0 has shift 0
                lmin = np.minimum.accumulate(shifted) + big * gidx
                prev = np.empty(n, dtype=np.int64)
                prev[1:] = lmin[:-1]
                mask = change.copy()  # a group's first row has no earlier prefix
                if cont and carry_min is not None:
                    prev[0] = carry_min
                    mask[0] = False
                else:
                    prev[0] = 0
                res["_lmin"] = lmin
                res["_lmin_prev"] = pd.arrays.IntegerArray(prev, mask)
                carry_min = int(lmin[-1])
            last_key = tuple(pdf[c].iloc[-1] for c in keys)
            yield res

    return fn


def range_prefix(
    df: DataFrame,
    keys: list[str],
    vals: dict[str, "F.Column"],
    excl: set[str],
    min_of: str | None,
    partitions: int,
    order=("ts", "event_id"),
) -> DataFrame:
    """Rows of ``df`` with, per value ``n``: ``_ln`` its running sum per key
    (inclusive, or exclusive when ``n in excl``) and, with ``min_of``,
    ``_lmin`` / ``_lmin_prev`` (running minimum of that inclusive sum, at and
    before the row) -- all global per key, not per partition.
    """
    from keyfold.session import ship_package, write_table

    d = df
    for n, e in vals.items():
        d = d.withColumn(f"_v{n}", e.cast("long"))
    vnames = [f"_v{n}" for n in vals]
    vexcl = {f"_v{n}" for n in excl}
    vmin = f"_v{min_of}" if min_of is not None else None
    extra = [T.StructField(PID, T.IntegerType())] + [T.StructField(f"_l{v}", T.LongType()) for v in vnames]
    if vmin is not None:
        extra += [T.StructField("_lmin", T.LongType()), T.StructField("_lmin_prev", T.LongType())]
    schema = T.StructType(list(d.schema.fields) + extra)
    ship_package(df.sparkSession)
    local = write_table(
        d.repartitionByRange(partitions, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .mapInPandas(_prefix_fn(keys, vnames, vexcl, vmin), schema),
        "range-pass",
    )

    # per (key, partition): totals and lowest inclusive prefix of min_of
    aggs = [F.sum(v).alias(f"_t{v}") for v in vnames]
    if vmin is not None:
        incl = f"_l{vmin}" if vmin not in vexcl else None
        low = F.col(incl) if incl else F.col(f"_l{vmin}") + F.col(vmin)
        aggs.append(F.min(low).alias("_low"))
    # only a partition's first and last key can cross a border: aggregate
    # just those rows (at most two groups per partition reach the shuffle)
    kst = F.struct(*keys)
    bounds = local.groupBy(PID).agg(F.min(kst).alias("_kfirst"), F.max(kst).alias("_klast"))
    border = local.join(F.broadcast(bounds), PID).where(  # one row per partition
        (kst == F.col("_kfirst")) | (kst == F.col("_klast"))
    )
    summ = border.groupBy(*keys, PID).agg(*aggs)
    span = summ.withColumn("_np", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_np") > 1)
    wc = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    sel = [*keys, PID] + [F.coalesce(F.sum(f"_t{v}").over(wc), F.lit(0)).alias(f"_o{v}") for v in vnames]
    offs = span.select(*sel, *(["_low"] if vmin is not None else []))
    if vmin is not None:
        offs = offs.withColumn("_g", F.min(F.col(f"_o{vmin}") + F.col("_low")).over(wc)).drop("_low")
    # at most two border keys per partition: bounded by 2 * partitions rows
    out = local.join(F.broadcast(offs), [*keys, PID], "left")
    for v in vnames:
        o = F.coalesce(F.col(f"_o{v}"), F.lit(0))
        out = out.withColumn(f"_l{v}", F.col(f"_l{v}") + o)
    if vmin is not None:
        o = F.coalesce(F.col(f"_o{vmin}"), F.lit(0))
        out = (
            out.withColumn("_lmin", F.least(F.col("_lmin") + o, F.col("_g")))
            .withColumn("_lmin_prev", F.least(F.col("_lmin_prev") + o, F.col("_g")))
        )
    drop = [PID, *vnames, *[f"_o{v}" for v in vnames]] + (["_g"] if vmin is not None else [])
    out = out.drop(*drop)
    return out.withColumnsRenamed({f"_l{f'_v{n}'}": f"_l_{n}" for n in vals})


def _carry_fn(keys: list[str], value: str):
    """Per-partition pass over rows sorted by (keys, order): the last defined
    ``value`` of the key at each row, carried across batch borders."""

    def fn(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_key, carry = None, None
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            change = np.zeros(n, dtype=bool)
            for c in keys:
                a = pdf[c].to_numpy()
                change[1:] |= a[1:] != a[:-1]
            change[0] = last_key is None or tuple(pdf[c].iloc[0] for c in keys) != last_key
            start = np.maximum.accumulate(np.where(change, np.arange(n), 0))
            held = pdf[value].to_numpy(dtype=object)
            at = np.maximum.accumulate(np.where(pd.notna(held), np.arange(n), -1))
            open_ = at < start  # nothing defined since the key began in this batch
            filled = held[np.maximum(at, 0)]
            filled[open_] = None
            if not change[0]:
                filled[open_ & (start == 0)] = carry
            res = pdf.copy(deep=False)
            res[PID] = np.int32(pid)
            res[value] = filled
            last_key, carry = tuple(pdf[c].iloc[-1] for c in keys), filled[-1]
            yield res

    return fn


def range_carry(df: DataFrame, keys: list[str], value: str, partitions: int, order=("ts", "event_id")) -> DataFrame:
    """``df`` with each null of the string column ``value`` replaced by the last
    value before it in its key's order (null where there is none).

    "The latest defined one" is associative like a sum: a local pass per range,
    then for keys that cross a border the last value of the ranges before.  The
    pass is written once, as in ``range_prefix``, and the border table has at
    most two rows a range.
    """
    from keyfold.session import ship_package, write_table

    ship_package(df.sparkSession)
    schema = T.StructType(list(df.schema.fields) + [T.StructField(PID, T.IntegerType())])
    local = write_table(
        df.repartitionByRange(partitions, *keys, *order).sortWithinPartitions(*keys, *order)
        .mapInPandas(_carry_fn(keys, value), schema),
        "range-carry",
    )
    kst = F.struct(*keys)
    bounds = local.groupBy(PID).agg(F.min(kst).alias("_kfirst"), F.max(kst).alias("_klast"))
    border = local.join(F.broadcast(bounds), PID).where(  # one row per partition
        (kst == F.col("_kfirst")) | (kst == F.col("_klast"))
    )
    ends = border.groupBy(*keys, PID).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    before = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, PID, F.last("_end", ignorenulls=True).over(before).alias("_before"))
    out = local.join(F.broadcast(carried), [*keys, PID], "left")  # at most two rows per partition
    return out.withColumn(value, F.coalesce(value, "_before")).select(*df.columns)
