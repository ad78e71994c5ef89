"""Streams against their batch forms, fed file by file."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from conftest import rows
from fleetwright import registry
from fleetwright.operators import alerts, lookups, sizing
from fleetwright.sources import fixtures
from fleetwright.streaming import flows
from fleetwright.streaming.reorder import in_event_order, turns_on


@pytest.fixture(scope="module")
def feed(spark, sf_dir, tmp_path_factory):
    """Events in five files by time, as one file per micro-batch."""
    root = tmp_path_factory.mktemp("feed")
    events = fixtures.table(spark, sf_dir, "events")
    for i in range(5):
        span = f"ts >= timestamp_ntz'2024-01-{1 + 6 * i:02d}'" + (
            f" AND ts < timestamp_ntz'2024-01-{7 + 6 * i:02d}'" if i < 4 else "")
        events.filter(span).coalesce(1).write.mode("append").parquet(str(root))

    def stream(columns):
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(root))
        return fixtures._project(source, columns)

    return stream


def run(df, name, mode, tmp_path):
    query = (df.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / name)).start())
    try:
        query.processAllAvailable()
        assert query.lastProgress["batchId"] >= 4
    finally:
        query.stop()
    return df.sparkSession.table(name)


def test_debounce(spark, sf_dir, feed, tmp_path):
    stream = flows.debounce(feed(fixtures.USAGE_SAMPLES), "cluster_id", ["metric", "value"], "sample_id",
                            "6 hours")
    got = run(stream, "bursts", "append", tmp_path)
    samples = fixtures.usage_samples(spark, sf_dir)
    batch = flows.debounce_batch(samples, "cluster_id", ["metric", "value"], "sample_id", "6 hours")
    end = samples.selectExpr("max(ts) - INTERVAL '1' HOUR AS t").first()["t"]
    closed = batch.filter(F.col("last_ts") + F.expr("INTERVAL '6' HOUR") <= F.lit(end))
    assert got.count() == 578
    columns = ["cluster_id", "first_ts", "last_ts", "edits", "metric", "value"]
    as_ntz = got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})
    assert rows(as_ntz, *columns) == rows(closed, *columns)


def test_gap_is_inclusive(spark, tmp_path):
    at = [0, 55, 111]
    df = spark.createDataFrame([(1, i, ms * 1000) for i, ms in enumerate(at)],
                               "cluster_id bigint, sample_id bigint, us bigint").selectExpr(
        "cluster_id", "sample_id", "CAST(timestamp_micros(us) AS TIMESTAMP_NTZ) AS ts", "sample_id AS value")
    got = flows.debounce_batch(df, "cluster_id", ["value"], "sample_id")
    assert rows(got, "edits", "value") == [(1, 2), (2, 1)]
    same = flows.debounce(df, "cluster_id", ["value"], "sample_id")
    assert rows(same, "edits", "value") == [(1, 2), (2, 1)]


def test_latest_spec(spark, sf_dir, feed, tmp_path):
    columns = ["cluster_id", "exec_c", "exec_m", "total_exec", "mem_util"]
    stream = flows.latest_spec(feed(fixtures.SPEC_CHANGES)).select(*columns)
    updates = run(stream, "specs", "complete", tmp_path)
    batch = flows.latest_spec(fixtures.spec_changes(spark, sf_dir))
    assert rows(updates, *columns) == rows(batch, *columns)


def test_latest_spec_in_update_mode(spark, sf_dir, feed, tmp_path):
    columns = ["cluster_id", "exec_c", "exec_m", "total_exec", "mem_util"]
    got = flows.run_updates(flows.latest_spec(feed(fixtures.SPEC_CHANGES)).select(*columns), ["cluster_id"], str(tmp_path / "updates"))
    assert rows(got, *columns) == rows(flows.latest_spec(fixtures.spec_changes(spark, sf_dir)), *columns)


def steps(spark, root, build, parts, schema="cluster_id long, sample_id long, s long, value double"):
    """Rows in parts, each run as it arrives; returns what the stream gives."""
    made = [spark.createDataFrame(p, schema).selectExpr(
        "*", "'core' AS metric", "CAST(timestamp_seconds(s) AS TIMESTAMP_NTZ) AS ts") for p in parts]
    return flows.run_in_steps(made, lambda arrived: build(arrived()), str(root))


def test_edge_alerts_in_steps_equal_the_batch(spark, sf_dir):
    """Five arrivals out of order: the alerts are R4's up to the last watermark."""
    samples = fixtures.usage_samples(spark, sf_dir)
    mark = samples.selectExpr("date_trunc('MILLISECOND', max(ts)) - INTERVAL '1' HOUR AS t").first()["t"]
    batch = alerts.edge_alerts(samples, alerts.too_hot(40.0)).filter(F.col("ts") < F.lit(mark))
    columns = ("cluster_id", "metric", "sample_id", "value", "ts")
    got = registry.QUERIES["v3_edge_alerts_stream"](spark, sf_dir)
    assert got.count() > 100 and rows(got, *columns) == rows(batch, *columns)


def test_late_samples_within_the_allowance_count(spark, tmp_path):
    parts = [[(1, 0, 10, 99.0), (1, 1, 3000, 99.0)],
             # 5 comes before 10 and takes its alert; 1500 lies between 10 and 3000 and re-arms.
             [(1, 2, 5, 99.0), (1, 3, 1500, 1.0), (1, 4, 5000, 1.0)],
             # The watermark stands at 1400: 1300 is too late, 1450 is not, and keeps 3000 from firing alone.
             [(1, 5, 1300, 1.0), (1, 6, 1450, 99.0), (1, 7, 9000, 99.0)], [(1, 8, 20000, 1.0)]]
    got = steps(spark, tmp_path, lambda df: flows.edge_alerts_stream(df), parts)
    assert [r["sample_id"] for r in got.orderBy("ts").collect()] == [2, 1, 7]


def test_only_touched_keys_are_read_and_quiet_keys_have_no_state(spark, tmp_path):
    first = [(c, c, 100, 99.0 if c < 10 else 1.0) for c in range(200)]
    parts = [first, [(500, 1000, 8000, 1.0)], [(3, 1001, 8100, 1.0), (500, 1002, 90000, 1.0)], [(500, 1003, 200000, 1.0)]]
    seen = []

    def build(df):
        return flows.edge_alerts_stream(df)

    made = [spark.createDataFrame(p, "cluster_id long, sample_id long, s long, value double").selectExpr(
        "*", "'core' AS metric", "CAST(timestamp_seconds(s) AS TIMESTAMP_NTZ) AS ts") for p in parts]
    root = str(tmp_path)
    for part in made:
        part.write.mode("append").parquet(f"{root}/arrived")
        stream = build(spark.readStream.schema(part.schema).parquet(f"{root}/arrived"))
        query = (stream.writeStream.format("parquet").option("path", f"{root}/rows").option(
            "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
        seen.append([(p["stateOperators"][0]["numRowsTotal"], p["stateOperators"][0]["numRowsUpdated"])
                     for p in query.recentProgress if p["stateOperators"]])
    assert seen[0][-1][0] == 200  # all samples wait
    assert seen[1][-1][0] == 11  # 100 is passed: the ten keys that are on, and the one that waits
    assert seen[2][0][1] <= 2 and seen[2][-1][0] == 10  # key 3 is off again, 500 waits
    assert spark.read.parquet(f"{root}/rows").count() == 10


def test_remembered_keys_expire(spark, tmp_path):
    parts = [[(1, 0, 100, 99.0), (2, 1, 8000, 1.0)], [(2, 2, 20000, 1.0)], [(2, 3, 30000, 1.0)], [(1, 4, 30001, 99.0)],
             [(2, 5, 50000, 1.0)]]
    kept = steps(spark, tmp_path / "kept", lambda df: flows.edge_alerts_stream(df), parts)
    assert [r["sample_id"] for r in kept.collect()] == [0]
    expired = steps(spark, tmp_path / "expired", lambda df: flows.edge_alerts_stream(df, forget_ms=10_000_000), parts)
    assert sorted(r["sample_id"] for r in expired.collect()) == [0, 4]


@pytest.mark.parametrize("forget_ms", [None, 5_000_000])
def test_keys_of_a_share_take_one_call_and_keep_their_own_memory(spark, tmp_path, forget_ms):
    """Hundreds of keys, three shares: three state rows at most, and the alerts of one share for each key."""
    inf = float("inf")
    parts = [[(c if c else None, 1000 * i + c, 1000 * i + 7 * (c % 5) + s, [1.0, 99.0, inf, float("nan"), None, -inf, 96.5][(c + i + s) % 7])
              for c in range(300) for s in (900, 100)] for i in (1, 2, 4, 9, 14)]
    parts.append([(400, 90_000, 90_000, 1.0)])
    made = [spark.createDataFrame(p, "cluster_id long, sample_id long, s long, value double").selectExpr(
        "cluster_id", "sample_id", "value", "value > 95 AS is_on", "CAST(timestamp_seconds(s) AS TIMESTAMP) AS ts") for p in parts]
    got = []
    for shares in (3, 65_537):
        totals = []

        class Seen(StreamingQueryListener):
            def onQueryStarted(self, event): pass
            def onQueryIdle(self, event): pass
            def onQueryTerminated(self, event): pass
            def onQueryProgress(self, event): totals.append(event.progress.stateOperators[0].numRowsTotal)

        spark.streams.addListener(seen := Seen())
        try:
            found = flows.run_in_steps(made, lambda arrived: in_event_order(
                arrived(), ["cluster_id"], ["sample_id"], ["value", "is_on"], turns_on, ["cluster_id", "sample_id", "ts", "value"],
                late="20 minutes", forget_ms=forget_ms, shares=shares), str(tmp_path / str(shares)))
            got.append(rows(found))
            deadline = time.monotonic() + 20
            while not totals and time.monotonic() < deadline:
                time.sleep(0.1)
        finally:
            spark.streams.removeListener(seen)
        assert totals and (max(totals) <= 3) == (shares == 3)
    assert len(got[0]) > 300 and got[0] == got[1]
    assert {r[0] for r in got[0]} >= {None, 1, 299} and any(inf in r for r in got[0])


@pytest.mark.parametrize("name", ["r5_change_alerts", "r6_muted_alerts"])
def test_muted_streams_equal_the_batch(spark, sf_dir, name):
    mark = fixtures.usage_samples(spark, sf_dir).selectExpr(
        "date_trunc('MILLISECOND', max(ts)) - INTERVAL '1' HOUR AS t").first()["t"]
    batch = registry.QUERIES["r5_change_alerts_muted" if name == "r5_change_alerts" else name](spark, sf_dir)
    got = registry.QUERIES[f"{name}_stream"](spark, sf_dir)
    batch = batch.filter(F.col("ts") < F.lit(mark)).select(*got.columns)
    assert got.count() > 50 and rows(got) == rows(batch)


def test_switches_and_samples_of_one_time(spark, tmp_path):
    """A switch counts before samples of its time, also if it comes later; muting twice forgets twice."""
    at = "CAST(timestamp_seconds(s) AS TIMESTAMP_NTZ) AS ts"
    samples = [(1, 0, 10, 99.0), (1, 1, 20, 99.0), (1, 2, 30, 99.0), (1, 3, 40, 99.0)]
    switches = [(1, 7, 20, True), (1, 8, 25, True), (1, 9, 30, False), (1, 10, 40, None)]
    spark.createDataFrame(samples, "cluster_id long, sample_id long, s long, value double").selectExpr(
        "cluster_id", "'core' AS metric", "sample_id", at, "value").write.parquet(str(tmp_path / "samples"))
    spark.createDataFrame(switches, "cluster_id long, seq long, s long, muted boolean").selectExpr(
        "cluster_id", "seq", at, "muted").write.parquet(str(tmp_path / "switches"))

    def read(name):
        return spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))

    stream = flows.muted_alerts_stream(read("samples"), read("switches"), late="0 seconds")
    got = flows.run_to_table(stream, str(tmp_path / "out"))
    assert sorted((r["sample_id"], r["span"]) for r in got.collect()) == [(0, 0), (2, 2)]


def test_overridden_specs(spark, sf_dir, feed, tmp_path):
    """Both logs file by file; the state is the newest spec with the overrides that are in force."""
    columns = ["cluster_id", "exec_c", "exec_pn", "exec_m", "drv_m", "total_exec", "mem_util"]
    stream = flows.overridden_spec(feed(fixtures.SPEC_CHANGES), feed(fixtures.OVERRIDE_LOG)).select(*columns)
    got = flows.run_updates(stream, ["cluster_id"], str(tmp_path / "specs"))
    newest = flows.latest_spec(fixtures.spec_changes(spark, sf_dir))
    specs = newest.select("cluster_id", *flows.SPEC_FIELDS)
    batch = sizing.size_fleet(specs, lookups.apply_overrides(fixtures.override_log(spark, sf_dir)))
    assert rows(got, *columns) == rows(batch, *columns)


def test_a_late_value_does_not_undo_a_reset(spark, tmp_path):
    at = "CAST(timestamp_seconds(s) AS TIMESTAMP_NTZ) AS ts"
    spec = spark.createDataFrame([(1, 1, 10, 8.0, 16.0, 64.0, "etl", "yarn", "client")],
                                 "cluster_id long, seq long, s long, nodes double, cpn double, rpn double, workload string, "
                                 "rm string, deploy_mode string").selectExpr("*", at).drop("s")
    kinds = "cluster_id long, seq long, s long, field string, is_reset boolean, value double"
    spec.write.parquet(str(tmp_path / "specs"))
    seen = []
    for part in ([(1, 5, 50, "execC", False, 3.0), (2, 5, 50, "execC", False, 3.0)], [(1, 9, 90, "execC", True, None)],
                 [(1, 7, 70, "execC", False, 7.0)], [(1, 11, 95, "execC", False, 2.0)]):
        spark.createDataFrame(part, kinds).selectExpr("*", at).drop("s").write.mode("append").parquet(str(tmp_path / "log"))

        def read(name):
            return spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))

        stream = flows.overridden_spec(read("specs"), read("log")).select("cluster_id", "exec_c")
        seen.append([tuple(r) for r in flows.run_updates(stream, ["cluster_id"], str(tmp_path / "out")).collect()])
    assert seen == [[(1, 3.0)], [(1, 5.0)], [(1, 5.0)], [(1, 2.0)]]


def test_usage_windows(spark, sf_dir, feed, tmp_path):
    stream = flows.usage_windows(feed(fixtures.USAGE_SAMPLES), late="1 hour")
    got = run(stream, "windows", "append", tmp_path)
    samples = fixtures.usage_samples(spark, sf_dir)
    end = samples.selectExpr("max(ts) - INTERVAL '1' HOUR AS t").first()["t"]
    batch = flows.usage_windows(samples).filter(F.col("window_end") <= F.lit(end))
    columns = ["cluster_id", "metric", "window_start", "samples", "average", "peak", "band"]
    as_ntz = got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    assert got.count() > 1000
    assert rows(as_ntz, *columns) == rows(batch, *columns)


@pytest.mark.parametrize("name", ["v1_debounce_stream", "v3_edge_alerts_stream", "v4_usage_windows_stream"])
def test_registered_streams_over_files_that_overlap_in_time(spark, sf_dir, name, tmp_path):
    events = fixtures.table(spark, sf_dir, "events")
    events.repartition(6, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    query = registry.QUERIES[name]
    assert rows(query(spark, str(tmp_path))) == rows(query(spark, sf_dir))
