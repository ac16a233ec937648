from keyfold.operators import latency as lat
from keyfold.plans import params as P


def _log(spark, rows):
    return spark.createDataFrame(rows, "run long, inputKafkaTimestamp string, outputKafkaTimestamp long")


def test_gap_fill_and_last_bucket(spark):
    # FIXTURES case 5: bucket 1 empty between 0 and 2; bucket 3 is x_max.
    rows = [(0, "1000", 1100), (0, "1200", 1300), (0, "1000", 3100), (0, "1000", 4500)]
    lf = lat.latency_frame(_log(spark, rows), 1000)
    got = {r.end_bucket: r.n_events for r in lat.throughput_gap_filled(lf).collect()}
    assert got == {0: 2, 1: 0, 2: 1}  # bucket 3 (x_max) dropped as in the reference
    got2 = {r.end_bucket: r.n_events for r in lat.throughput_gap_filled(lf, include_last=True).collect()}
    assert got2[3] == 1


def test_a_wild_clock_fails_instead_of_making_billions_of_rows(spark):
    import pytest

    lf = lat.latency_frame(_log(spark, [(0, "0", 10), (0, "1", 10**14)]), 1000)
    with pytest.raises(Exception, match="spine too long"):
        lat.throughput_gap_filled(lf).collect()


def test_shift_ten_bucket_warm_window(spark):
    rows = [(1, str(1000 + i * 1000), 1000 + i * 1000 + 10 * i) for i in range(30)]
    lf = lat.latency_frame(_log(spark, rows), 1000, {1: 8})
    b = {r.start_bucket for r in lf.collect()}
    assert min(b) == 8 and max(b) == 37
    ten = {r.ten_bucket for r in lat.latency_ten_bucket(lf).collect()}
    assert ten == {0, 10, 20, 30}
    w = lat.warm_window_stats(lf, 10, 20, 10, 15).first()
    assert w.warm_throughput == 11 / 10  # both ends inclusive
    assert w.prefix_throughput == 7 / 15


def test_percentiles_and_rate(spark):
    rows = [(0, str(i * 1000), i * 1000 + i) for i in range(101)]
    lf = lat.latency_frame(_log(spark, rows), 1000)
    p = lat.latency_percentiles(lf).first()
    assert p.p50 == 50.0 and p.min_latency == 0 and p.max_latency == 100 and p.n_events == 101
    q = lat.latency_percentiles(_log(spark, [(0, "0", v) for v in (1, 2, 2, 10)]).transform(lat.latency_rows)).first()
    assert q.p50 == 2.0 and abs(q.p99 - 9.76) < 1e-9
    r = lat.achieved_rate(lf).first()
    assert r.events_per_s == 101 / 100.0


def test_recovery_spans_and_pivot(spark):
    rows = [(0, "0", 10), (1, str(505 * 1000), 505 * 1000 + 7)]
    lf = lat.latency_frame(_log(spark, rows), 1000, {0: 504, 1: 505})
    per = lat.latency_by_start_bucket(lf)
    spans = lat.recovery_spans(spark, P.RECOVERY_SPANS, P.RUN_LABELS)
    tagged = {(r.run, r.start_bucket): r.in_recovery for r in lat.tag_recovery(per, spans, "latency", "start_bucket").collect()}
    assert tagged == {(0, 504): True, (1, 505): True}
    piv = lat.latency_pivot(lf, P.RUN_LABELS).collect()
    assert set(piv[0].asDict()) == {"ten_bucket", "eager", "lazy", "disk"}


def test_recovery_pivot_published_values(spark):
    # Recovery times (ms) as published with the reference.
    rows = [("4 GB", "disk", 1793), ("8 GB", "disk", 2986), ("4 GB", "lazy", 874),
            ("8 GB", "lazy", 1182), ("4 GB", "eager", 3704), ("8 GB", "eager", 8503)]
    piv = {r.state_size: r.asDict() for r in lat.recovery_pivot(lat.recovery_table(spark, rows),
                                                                ["disk", "eager", "lazy"]).collect()}
    assert piv["8 GB"]["eager"] == 8503 and piv["4 GB"]["lazy"] == 874


def test_latency_log_json_round_trip(spark, tmp_path):
    from keyfold.sources import latencylog

    p = str(tmp_path / "log")
    latencylog.write_json(_log(spark, [(0, "1", 5), (1, "2", 9)]), p)
    back = latencylog.read_json(spark, p + "/run=0", run=0).collect()
    assert [(r.inputKafkaTimestamp, r.outputKafkaTimestamp) for r in back] == [("1", 5)]
    # a cut-off last line is dropped
    f = tmp_path / "cut.json"
    f.write_text('{"inputKafkaTimestamp":"1","outputKafkaTimestamp":2}\n{"inputKafkaTimestamp":"3","outp')
    assert latencylog.read_json(spark, str(f)).count() == 1


def test_series_label(spark):
    df = spark.createDataFrame([("benchmark.run_a_v0_s1_l2.p50",), ("benchmark.run_a.count",)], "p string")
    a = df.select(lat.series_label("p").alias("x")).collect()
    assert a[0].x == "p50 latency  run_a_v0_s1_l2"
    b = df.select(lat.series_label("p", " for ").alias("x")).collect()
    assert b[1].x == "count for run_a"
