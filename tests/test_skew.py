"""Hot groups: the sliced forms must give exactly what the plain forms give."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetwright import registry
from fleetwright.operators import alerts, jobs, reservations
from fleetwright.operators.reservations import reservation_profile
from fleetwright.operators.sizing import size_fleet
from fleetwright.operators.slices import _window_scan, open_positions, ordered_scan, positions
from fleetwright.plans import conf, documents
from fleetwright.sources import fixtures
from fleetwright.streaming.flows import debounce_batch


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows belong to cluster 7."""
    rng = random.Random(3)
    data = []
    for i in range(3000):
        cluster = 7 if rng.random() < 0.34 else rng.randint(100, 140)
        data.append((cluster, i, rng.randint(0, 10_000_000), rng.choice(["a", "b"]),
                     float(rng.randint(0, 100)), rng.random() < 0.02))
    df = spark.createDataFrame(
        data, "cluster_id bigint, sample_id bigint, us bigint, metric string, value double, muted boolean")
    ts = F.expr("CAST(timestamp_micros(us * 10000) AS TIMESTAMP_NTZ)")
    return df.withColumn("ts", ts).drop("us")


def test_scan(skewed):
    marked = skewed.withColumns({"n": F.lit(1), "seen": F.when(F.col("value") > 90, F.col("value"))})
    spec = {"lag": {"before": "value"}, "total": {"upto": "n"}, "last": {"peak": "seen"}}
    plain = _window_scan(marked, ["cluster_id"], ["ts", "sample_id"], tuple(spec.values()))
    for width in (1, 60, 3600, 10**6):
        sliced = ordered_scan(marked, ["cluster_id"], ["ts", "sample_id"], bucket_seconds=width, **spec)
        assert rows(sliced) == rows(plain)


def test_scan_without_times(spark):
    df = spark.createDataFrame([(1, 1, 5.0, None), (1, 2, 6.0, 10), (1, 3, None, 20)], "cluster_id long, sample_id long, value double, s long")
    df = df.selectExpr("cluster_id", "sample_id", "value", "CAST(timestamp_seconds(s) AS TIMESTAMP_NTZ) AS ts")
    got = ordered_scan(df, ["cluster_id"], ["ts", "sample_id"], lag={"b": "value"}, last={"l": "value"})
    assert [(r["b"], r["l"]) for r in got.orderBy("sample_id").collect()] == [(None, 5.0), (5.0, 6.0), (6.0, 6.0)]


def test_positions_of_hashed_ids(skewed):
    """Sparse ids: every row is a block of its own, and blocks are added up level by level."""
    hashed = skewed.selectExpr("cluster_id", "xxhash64(sample_id) AS id")
    plain = hashed.withColumn("at", F.expr("row_number() OVER (PARTITION BY cluster_id ORDER BY id) - 1"))
    for bits in (4, 20):
        assert rows(positions(hashed, ["cluster_id"], "id", ["id"], "at", bits=bits)) == rows(plain)


def test_nothing_opens_without_a_count(spark):
    df = spark.createDataFrame([(1, 0), (2, -3), (3, 2)], "k long, n long")
    assert rows(open_positions(df, "0L", "n", "i"), "k", "i") == [(3, 0), (3, 1)]


def test_positions(skewed):
    plain = skewed.withColumn("at", F.expr(
        "row_number() OVER (PARTITION BY cluster_id ORDER BY sample_id) - 1")).select(
        "cluster_id", "sample_id", "at")
    for bits in (3, 8, 20):
        got = positions(skewed, ["cluster_id"], "sample_id", ["sample_id"], "at", bits=bits)
        assert rows(got, "cluster_id", "sample_id", "at") == rows(plain, "cluster_id", "sample_id", "at")


@pytest.mark.parametrize("width", [7, 10**7])
def test_alerts(skewed, width):
    hot = alerts.too_hot(80)
    assert rows(alerts.edge_alerts(skewed, hot, bucket_seconds=width)) == rows(alerts.edge_alerts(skewed, hot))
    keys = skewed.selectExpr("cluster_id", "sample_id AS seq", "ts",
                             "CASE WHEN value > 50 THEN 'OE' WHEN value > 30 THEN 'OC' ELSE '' END AS alert_key")
    assert rows(alerts.change_alerts(keys, bucket_seconds=width)) == rows(alerts.change_alerts(keys))
    log = skewed.filter("sample_id % 20 = 0").selectExpr("cluster_id", "sample_id AS seq", "ts", "muted")
    samples = skewed.filter("sample_id % 20 <> 0")
    assert rows(alerts.muted_alerts(samples, log, hot, width)) == rows(
        alerts.muted_alerts(samples, log, hot))


def test_debounce(skewed):
    args = ("cluster_id", ["metric", "value"], "sample_id", "200 seconds")
    plain = debounce_batch(skewed, *args)
    assert plain.count() > 500
    assert rows(debounce_batch(skewed, *args, bucket_seconds=100)) == rows(plain)


def test_change_alert_rules(spark):
    keys = ["", "A", "A", "OC", "A", "AOE", "AOE", "", "AOE"]
    df = spark.createDataFrame([(1, i, f"2024-01-01 00:00:{i:02d}", k) for i, k in enumerate(keys)],
                               "cluster_id bigint, seq bigint, t string, alert_key string")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    assert [r[0] for r in rows(alerts.change_alerts(df), "seq")] == [1, 4, 5, 8]


def test_mute_rules(spark):
    line = [(0, 99, None), (1, 99, None), (2, None, True), (3, 99, None), (4, None, False), (5, 99, None),
            (6, 99, None), (7, 1, None), (8, 99, None), (9, None, True), (10, None, False), (11, 99, None)]
    at = "CAST(timestamp_seconds(t) AS TIMESTAMP_NTZ) AS ts"
    samples = spark.createDataFrame([(1, t, float(v)) for t, v, m in line if v is not None],
                                    "cluster_id bigint, t bigint, value double").selectExpr(
        "cluster_id", "t AS sample_id", at, "'core' AS metric", "value")
    log = spark.createDataFrame([(1, t, m) for t, v, m in line if m is not None],
                                "cluster_id bigint, t bigint, muted boolean").selectExpr(
        "cluster_id", "t AS seq", at, "muted")
    assert [r[0] for r in sorted(rows(alerts.muted_alerts(samples, log), "sample_id"))] == [0, 5, 8, 11]


def test_golden_edges(spark, sf_dir):
    samples = fixtures.usage_samples(spark, sf_dir)
    assert samples.filter("value > 95").count() == 155
    assert alerts.edge_alerts(samples, keys=("cluster_id",)).count() == 137
    assert debounce_batch(samples, "cluster_id", ["value"], "sample_id", "6 hours").count() == 585


def test_reservation_blocks(spark, sf_dir):
    res, sized = fixtures.numbered_reservations(spark, sf_dir), size_fleet(fixtures.clusters(spark, sf_dir))
    wanted = ("cluster_id", "res_idx", "res_pct", "res_oh_gb")
    plain = rows(reservation_profile(res, sized), *wanted)
    assert rows(reservation_profile(res, sized, bits=1), *wanted) == plain
    bare = rows(reservation_profile(res, sized, pyspark_overhead=False), "cluster_id", "res_idx", "res_oh")
    assert all(oh >= 384 for *_, oh in bare)


def test_gaps_in_positions(spark, sf_dir):
    """Removals leave gaps; no row may get lost over them."""
    res = fixtures.numbered_reservations(spark, sf_dir).withColumn("res_idx", F.expr("res_idx * 5000"))
    sized = size_fleet(fixtures.clusters(spark, sf_dir))
    assert reservation_profile(res, sized, bits=3).count() == res.count()
    jobs_ = spark.createDataFrame([(1, 10, 0, None), (1, 11, 5000, None)], "cluster_id long, job_id long, job_idx long, manual_pct int")
    pool = registry.pool(spark, sf_dir)
    allocs = jobs.allocate(jobs_, pool)
    docs = documents.plan_documents(pool, allocs, reservation_profile(res, sized))
    assert docs.filter("kind = 'job'").count() == 2 and docs.filter("kind = 'reservation'").count() == res.count()


def test_many_additions_and_jobs(spark, sf_dir):
    """25,000 additions and 5,000 jobs of one cluster: all are rows, in one shape."""
    props = spark.range(25_000).selectExpr("1L AS cluster_id", "CAST(id AS INT) AS pos", "concat('k', id) AS key", "'v' AS val")
    sized = size_fleet(fixtures.clusters(spark, sf_dir).filter("cluster_id = 1"))
    lines = conf.cluster_texts(sized, props)
    assert lines.filter("file_name = 'cluster-1-custom.conf'").count() == 25_000
    own = lines.filter("file_name = 'cluster-1-spark-defaults.conf'").count()
    assert own == conf.cluster_texts(sized).count() > 20
    many = spark.range(5000).selectExpr("1L AS cluster_id", "id AS job_id", "id AS job_idx", "CAST(NULL AS INT) AS manual_pct")
    res = fixtures.numbered_reservations(spark, sf_dir).filter("cluster_id = 1")
    pool = reservations.remaining_pool(sized, res)
    docs = documents.plan_documents(pool, jobs.allocate(many, pool), reservation_profile(res, sized), props, many)
    assert dict(docs.groupBy("kind").count().collect()) == {
        "cluster": 1, "job": 5000, "input": 5000, "property": 25_000, "reservation": res.count()}


def test_muted_changes(spark):
    """While muted nothing is shown and the remembered key stays."""
    at = "CAST(timestamp_seconds(seq) AS TIMESTAMP_NTZ) AS ts"
    keys = spark.createDataFrame([(1, 0, "A"), (1, 2, "B"), (1, 4, "A"), (1, 5, "B")], "cluster_id long, seq long, alert_key string")
    log = spark.createDataFrame([(1, 1, True), (1, 3, False)], "cluster_id long, seq long, muted boolean")
    shown = alerts.change_alerts(keys.selectExpr("*", at), log.selectExpr("*", at))
    assert [r["seq"] for r in shown.orderBy("seq").collect()] == [0, 5]
