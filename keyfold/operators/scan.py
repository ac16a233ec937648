"""Skew-safe ordered scans per key (the building block of W1a, W2, W3, W4).

A running sum over ``partitionBy(key).orderBy(ts, event_id)`` puts every row
of one key into one task.  With power-law keys one key may hold a third of
all rows, so that plan does not scale.  Running sums and running minima are
associative, so they are computed over range-partitioned rows: a local prefix
per partition, then offsets for the keys that cross a partition border (see
``rangescan``).  Hot keys and hot instants are both split.

There is one layout for every input size.  ``Chunking(ranges=n)`` sets the
number of ranges, by default the session's ``spark.sql.shuffle.partitions``;
``Chunking(ranges=None)`` is the plain per-key window, kept as the reference
form that tests compare with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")


@dataclass(frozen=True)
class Chunking:
    """How rows of a key are cut: into ``ranges`` ranges, or not at all."""

    ranges: int | None = None

    @property
    def single(self) -> bool:
        return self.ranges is None


def choose_chunking(df: DataFrame) -> Chunking:
    """The layout of every query: as many ranges as the session shuffles to."""
    return Chunking(ranges=int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_sums(
    df: DataFrame,
    keys: list[str],
    sums: dict[str, Column],
    chunking: Chunking,
    order=ORDER,
    exclusive: bool | set[str] = False,
) -> DataFrame:
    """Add one column per entry of ``sums``: the running sum per key in order.

    ``exclusive`` (all sums, or a set of names) sums rows strictly before
    the current one.  All sums share one pass.
    """
    excl = set(sums) if exclusive is True else set(exclusive or ())
    if not chunking.single:
        from keyfold.operators.rangescan import range_prefix

        out = range_prefix(df, keys, sums, excl, None, chunking.ranges, order)
        return out.withColumnsRenamed({f"_l_{n}": n for n in sums})
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumns({f"_v_{n}": e for n, e in sums.items()})
    for n in sums:
        over = w.rowsBetween(Window.unboundedPreceding, -1 if n in excl else Window.currentRow)
        out = out.withColumn(n, F.coalesce(F.sum(f"_v_{n}").over(over), F.lit(0)))
    return out.drop(*[f"_v_{n}" for n in sums])


def reflected_level(
    df: DataFrame,
    keys: list[str],
    delta: Column,
    init: int,
    chunking: Chunking,
    order=ORDER,
) -> DataFrame:
    """Level of a counter floored at zero: ``s_t = max(s_{t-1} + d_t, 0)``, ``s_0 = init``.

    With ``P`` the unfloored running level ``init + sum(d)`` and
    ``m = min(0, running min of P)``, the floored level is ``P - m`` and a
    step was floored (a unit request refused) exactly when ``m`` moved.

    Adds: ``_level`` (P), ``_m`` and ``_m_prev``.
    """
    init_c = F.lit(int(init)).cast("long")
    zero = F.lit(0).cast("long")
    if not chunking.single:
        from keyfold.operators.rangescan import range_prefix

        out = range_prefix(df, keys, {"d": delta}, set(), "d", chunking.ranges, order)
        level, low, low_prev, spare = "_l_d", "_lmin", "_lmin_prev", ()
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
        now = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = df.withColumn("_d", delta.cast("long")).withColumn("_l_d", F.sum("_d").over(now))
        out = out.withColumn("_lmin", F.min("_l_d").over(now)).withColumn(
            "_lmin_prev", F.min("_l_d").over(w.rowsBetween(Window.unboundedPreceding, -1))
        )
        level, low, low_prev, spare = "_l_d", "_lmin", "_lmin_prev", ("_d",)
    return (
        out.withColumn("_level", init_c + F.col(level))
        .withColumn("_m", F.least(zero, init_c + F.col(low)))
        .withColumn("_m_prev", F.least(zero, init_c + F.col(low_prev)))
        .drop(level, low, low_prev, *spare)
    )
