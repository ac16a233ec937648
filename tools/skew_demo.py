"""Skew check: one item holds a third of all add requests.

Builds N synthetic requests as a Spark job (spark.range + column
expressions), then settles them with unit demand and with real quantities,
each as a plain per-key window or fold (the hot item is one task) and on the
range layout.  Prints one JSON line with the times and whether the results are
identical.  Usage: python tools/skew_demo.py [N]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from keyfold.functions import synth  # noqa: E402
from keyfold.operators import reserve, scan  # noqa: E402
from keyfold.profiles import get_profile  # noqa: E402
from keyfold.session import local_session  # noqa: E402


def events(spark, n: int):
    seq = F.col("id")
    hot = synth.uniform(seq, seed=9) < F.lit(1.0 / 3)
    item = F.when(hot, F.lit(0)).otherwise(synth.power_law_index(seq, 10_000, 3.0, seed=2) + 1)
    kind = F.when(synth.uniform_int(seq, 0, 20, seed=4) == 0, F.lit("restock")).otherwise(F.lit("add"))
    ts_ms = F.lit(1_704_067_200_000) + seq * 3
    return spark.range(0, n, numPartitions=32).select(
        seq.alias("event_id"),
        F.timestamp_millis(ts_ms).cast("timestamp_ntz").alias("ts"),
        ts_ms.alias("ts_ms"),
        kind.alias("kind"),
        synth.power_law_index(seq, 1_000_000, 3.0, seed=1).alias("user_id"),
        item.cast("long").alias("item_id"),
        F.when(kind == "add", F.lit(1)).otherwise(F.lit(300)).cast("int").alias("quantity"),
    )


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 6_000_000
    spark = local_session(8, shuffle_partitions=32, app="keyfold-skew")
    p = get_profile("remote", initial_stock=1000, restock_qty=300, demand="unit")
    d = events(spark, n).cache()
    d.count()

    def timed(choose, method="unit"):
        t0 = time.perf_counter()
        ch = choose()
        out = reserve.reserve(d, p, method=method, chunking=ch)
        agg = out.agg(F.sum(F.when(F.col("status") == "INSTOCK", 1).otherwise(0)).alias("g"),
                      F.sum("stock_after").alias("s")).first()
        return time.perf_counter() - t0, (agg.g, agg.s), ch

    t_single, r_single, _ = timed(lambda: scan.Chunking())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t_rng, r_rng, _ = timed(lambda: scan.Chunking(ranges=parts))
    f_single, q_single, _ = timed(lambda: scan.Chunking(), "fold")
    f_rng, q_rng, _ = timed(lambda: scan.Chunking(ranges=parts), "fold")
    print(json.dumps({"rows": n, "range_partitions": parts,
                      "single_task_s": round(t_single, 2), "range_scan_s": round(t_rng, 2),
                      "identical": r_single == r_rng,
                      "fold_single_task_s": round(f_single, 2), "fold_range_s": round(f_rng, 2),
                      "fold_identical": q_single == q_rng}))
    spark.stop()


if __name__ == "__main__":
    main()
