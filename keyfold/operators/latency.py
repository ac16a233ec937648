"""Latency and throughput analytics over latency logs (evaluator notebooks).

P19-P23, A6-A11, A14-A17, J4-J6, F10-F12, O1, U2.  Every step is a column
expression or a grouped aggregate with map-side partial aggregation; the
only per-run values carried back to rows (the run's first input time) form a
table of one row per run, broadcast with that bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions.timefns import bucket, ms_from_string, ten_bucket
from keyfold.operators import scan


def _case(col: str, mapping: dict, default=0):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v)))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def run_origins(log: DataFrame) -> DataFrame:
    """First input time per run (one row per run)."""
    return log.groupBy("run").agg(F.min(ms_from_string("inputKafkaTimestamp")).alias("t0"))


def latency_rows(log: DataFrame) -> DataFrame:
    """Run, in_ms, out_ms, latency -- one scan, no join."""
    return log.select(
        "run",
        ms_from_string("inputKafkaTimestamp").alias("in_ms"),
        F.col("outputKafkaTimestamp").cast("long").alias("out_ms"),
    ).withColumn("latency", F.col("out_ms") - F.col("in_ms"))


def latency_frame(log: DataFrame, bucket_ms: int, shifts: dict | None = None) -> DataFrame:
    """Latency and start / end buckets relative to the run's origin.

    Columns: run, in_ms, out_ms, latency, start_bucket, end_bucket.
    """
    origins = F.broadcast(run_origins(log))  # one row per run: bounded by the run list
    d = latency_rows(log).join(origins, "run")
    shift = _case("run", shifts or {}, 0)
    return d.select(
        "run", "in_ms", "out_ms", "latency",
        bucket("in_ms", "t0", bucket_ms, shift).alias("start_bucket"),
        bucket("out_ms", "t0", bucket_ms, shift).alias("end_bucket"),
    )


def latency_by_start_bucket(lf: DataFrame) -> DataFrame:
    """A6 + O1: mean latency per start bucket and run, ordered."""
    return (
        lf.groupBy("run", "start_bucket")
        .agg(F.avg("latency").alias("mean_latency"), F.count(F.lit(1)).alias("n_events"))
        .orderBy("run", "start_bucket")
    )


def throughput_by_end_bucket(lf: DataFrame) -> DataFrame:
    """Events per end bucket and run."""
    return lf.groupBy("run", "end_bucket").agg(F.count(F.lit(1)).alias("n_events"))


def throughput_gap_filled(lf: DataFrame, include_last: bool = False, max_buckets: int = 10_000_000) -> DataFrame:
    """J4 + A10 + A11: complete bucket spine 0 .. x_max-1 per run, missing -> 0.

    ``x_max`` is the largest end bucket over all runs (the reference uses two
    of three).  As in the reference the spine stops before ``x_max``, and
    buckets below 0 are left out, unless ``include_last``: then it runs from
    the smallest bucket (0 at most) to ``x_max``, so that no event is lost.
    The spine is generated inside the plan from one row of limits; a clock
    value that would make it longer than ``max_buckets`` fails the query.
    """
    counts = throughput_by_end_bucket(lf)
    limits = counts.agg(
        F.max("end_bucket").alias("x"), F.least(F.lit(0).cast("long"), F.min("end_bucket")).alias("low"),
        F.collect_set("run").alias("runs"),  # the run list: one value per run
    ).where("x IS NOT NULL")
    first = F.col("low") if include_last else F.lit(0).cast("long")
    last = F.col("x") if include_last else F.col("x") - 1
    too_long = F.raise_error(F.concat(F.lit("bucket spine too long: "), (last - first).cast("string")))
    last = F.when(last - first >= max_buckets, too_long.cast("long")).otherwise(last)
    spine = (
        limits.where(first <= (F.col("x") if include_last else F.col("x") - 1))
        .select(F.explode("runs").alias("run"), first.alias("_a"), last.alias("_b"))
        .select("run", F.explode(F.sequence("_a", "_b")).alias("end_bucket"))
    )
    return spine.join(counts, ["run", "end_bucket"], "left").select(
        "run", "end_bucket", F.coalesce(F.col("n_events"), F.lit(0)).cast("long").alias("n_events")
    )


def view_range(per_bucket: DataFrame, bucket_col: str, lo: int, hi: int) -> DataFrame:
    """the buckets of a plot's view, both ends included."""
    return per_bucket.where(F.col(bucket_col).between(lo, hi))


def latency_ten_bucket(lf: DataFrame, width: int = 10) -> DataFrame:
    """Mean latency per ten-bucket (floored) and run."""
    return (
        lf.withColumn("ten_bucket", ten_bucket("start_bucket", width))
        .groupBy("run", "ten_bucket")
        .agg(F.avg("latency").alias("mean_latency"), F.count(F.lit(1)).alias("n_events"))
    )


def warm_window_stats(lf: DataFrame, lo: int, hi: int, divisor: int, prefix_limit: int) -> DataFrame:
    """Warm-window mean and throughput, plus the prefix form.

    Warm window: ``start_bucket BETWEEN lo AND hi`` (both ends), throughput =
    count / ``divisor`` (the reference divides 401 buckets by 400).  Prefix:
    ``start_bucket < prefix_limit``, divided by ``prefix_limit``.  One pass.
    """
    warm = F.col("start_bucket").between(lo, hi)
    pre = F.col("start_bucket") < prefix_limit
    return lf.groupBy("run").agg(
        F.avg(F.when(warm, F.col("latency"))).alias("warm_mean_latency"),
        (F.count(F.when(warm, F.lit(1))) / F.lit(float(divisor))).alias("warm_throughput"),
        F.avg(F.when(pre, F.col("latency"))).alias("prefix_mean_latency"),
        (F.count(F.when(pre, F.lit(1))) / F.lit(float(prefix_limit))).alias("prefix_throughput"),
    )


def latency_percentiles(rows: DataFrame) -> DataFrame:
    """A14 + A15: exact p50, p99, min, max and count per run.

    From a histogram (run, latency): latencies are whole ms, so it is bounded
    by their range, and it is built with map-side aggregation.  A running
    count over the histogram, cut into ranges of values (so one run is many
    tasks), finds the two values around each percentile's rank, which are
    interpolated linearly.
    """
    hist = rows.where(F.col("latency").isNotNull()).groupBy("run", "latency").agg(F.count(F.lit(1)).alias("n"))
    h = scan.running_sums(hist, ["run"], {"_c": F.col("n")}, scan.choose_chunking(hist), order=("latency",))
    totals = h.groupBy("run").agg(F.sum("n").alias("_n"))
    h = h.join(F.broadcast(totals), "run")  # one row per run: bounded by the run list

    def at(rank):
        """The value at a 0-based rank: the first whose running count exceeds it."""
        return F.min(F.when(F.col("_c") > rank, F.col("latency")))

    def percentile(q: float):
        rank = (F.col("_n") - 1) * F.lit(q)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        part = F.max(rank - F.floor(rank))
        return (low + (high - low) * part).cast("double")

    return h.groupBy("run").agg(
        percentile(0.5).alias("p50"),
        percentile(0.99).alias("p99"),
        F.min("latency").alias("min_latency"),
        F.max("latency").alias("max_latency"),
        F.sum("n").cast("long").alias("n_events"),
    )


def recovery_spans(spark: SparkSession, rows: list[tuple], run_labels: dict) -> DataFrame:
    """Span table (run, plot, lo, hi) with the run id; a small literal table."""
    inv = {v: k for k, v in run_labels.items()}
    return spark.createDataFrame(
        [(inv[r], r, p, lo, hi) for r, p, lo, hi in rows],
        "run long, run_label string, plot string, lo long, hi long",
    )


def tag_recovery(per_bucket: DataFrame, spans: DataFrame, plot: str, bucket_col: str) -> DataFrame:
    """Flag buckets that fall in a run's recovery span (range join).

    ``spans`` is a literal table of a few rows per run, broadcast; the join
    is an equi-join on run plus a ``between`` condition.
    """
    s = F.broadcast(spans.where(F.col("plot") == plot).select("run", "lo", "hi"))
    cond = (per_bucket["run"] == s["run"]) & per_bucket[bucket_col].between(s["lo"], s["hi"])
    return per_bucket.join(s, cond, "left").select(
        per_bucket["*"], s["lo"].isNotNull().alias("in_recovery")
    )


def latency_pivot(lf: DataFrame, run_labels: dict, width: int = 10) -> DataFrame:
    """U2 + A16: runs side by side, one column per run label (explicit values:
    no extra job to find them)."""
    label = _case("run", run_labels, "other")
    return (
        lf.withColumn("ten_bucket", ten_bucket("start_bucket", width))
        .withColumn("run_label", label)
        .groupBy("ten_bucket")
        .pivot("run_label", list(run_labels.values()))
        .agg(F.avg("latency"))
    )


def achieved_rate(rows: DataFrame) -> DataFrame:
    """Events per second over the run's input time span."""
    return rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_events"),
        ((F.max("in_ms") - F.min("in_ms")) / F.lit(1000.0)).alias("elapsed_s"),
    ).withColumn(
        "events_per_s",
        F.when(F.col("elapsed_s") > 0, F.col("n_events") / F.col("elapsed_s")),
    )


def recovery_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A16 source: (state_size, method, ms) rows, e.g. the published recovery times."""
    return spark.createDataFrame(rows, "state_size string, method string, ms int")


def recovery_pivot(recovery: DataFrame, methods: list[str]) -> DataFrame:
    """Recovery time by state size x method."""
    return recovery.groupBy("state_size").pivot("method", methods).agg(F.first("ms"))


def series_label(path, sep: str = " latency  ", prefix_sub: tuple[str, str] | None = None):
    """Dashboard series label from a metric path ``root.series.stat``.

    Path parts 2 and 1 are joined with ``.`` (``stat.series``), then the dot
    is replaced by ``sep``; ``prefix_sub`` first replaces a regex (the count
    panel strips ``benchmark.``).
    """
    c = F.col(path) if isinstance(path, str) else path
    parts = F.split(c, r"\.")
    label = F.concat_ws(".", F.try_element_at(parts, F.lit(3)), F.try_element_at(parts, F.lit(2)))
    if prefix_sub is not None:
        label = F.regexp_replace(label, prefix_sub[0], prefix_sub[1])
    return F.regexp_replace(label, r"\.", sep)


# Dashboard panel texts.
LATENCY_SEP = " latency  "
COUNT_SEP = " for "


def latency_series(rows: DataFrame, run_labels: dict, root: str = "benchmark") -> DataFrame:
    """A14 + A15 + P24: per-run max / p99 / p50 / min latency and count in
    long form (one row per series and stat), labelled as on the dashboard."""
    p = latency_percentiles(rows)
    long = p.select(
        "run",
        F.expr(
            "stack(5, 'max', CAST(max_latency AS DOUBLE), 'p99', p99, 'p50', p50, "
            "'min', CAST(min_latency AS DOUBLE), 'count', CAST(n_events AS DOUBLE)) AS (stat, value)"
        ),
    )
    path = F.concat_ws(".", F.lit(root), _case("run", run_labels, "other"), F.col("stat"))
    label = F.when(F.col("stat") == "count", series_label(path, COUNT_SEP)).otherwise(series_label(path, LATENCY_SEP))
    return long.select("run", "stat", "value", path.alias("metric"), label.alias("label"))
