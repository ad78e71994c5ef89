"""Mute spans against switches and against a plain loop."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from fleetwright.operators import alerts
from fleetwright.operators.slices import spans_at
from fleetwright.sources import fixtures

AT = "CAST(timestamp_seconds({0}) AS TIMESTAMP_NTZ)"


def samples_of(spark, points):
    return spark.createDataFrame(points, "cluster_id long, sample_id long, s long, value double").selectExpr(
        "cluster_id", "'core' AS metric", "sample_id", f"{AT.format('s')} AS ts", "value")


def spans_of(spark, spans):
    return spark.createDataFrame(spans, "cluster_id long, a long, b long").selectExpr(
        "cluster_id", f"{AT.format('a')} AS ts", f"{AT.format('b')} AS until")


@pytest.mark.parametrize("seconds", [3600, 50])
def test_counts_equal_a_plain_loop(spark, seconds):
    rng = random.Random(1)
    points = [(rng.randrange(3), i, rng.randrange(2000), 1.0) for i in range(400)]
    spans = [(rng.randrange(3), rng.choice([None, rng.randrange(2000)]), rng.choice([None, rng.randrange(2000)])) for _ in range(60)]
    got = spans_at(samples_of(spark, points), spans_of(spark, spans), ["cluster_id"], "sample_id", bucket_seconds=seconds)
    want = []
    for c, i, s, _ in points:
        begun = [(a, b) for k, a, b in spans if k == c and (a is None or a <= s)]
        want.append((i, sum(b is None or s < max(a or 0, b) for a, b in begun), len(begun)))
    assert rows(got, "sample_id", "open_spans", "begun_spans") == sorted(want, key=repr)


def test_spans_of_switches_give_the_switch_form(spark, sf_dir):
    samples = fixtures.usage_samples(spark, sf_dir).filter("metric <> 'evictions'")
    log = fixtures.mute_log(spark, sf_dir)
    after = Window.partitionBy("cluster_id").orderBy("ts", "seq")
    spans = log.withColumn("until", F.lead("ts").over(after)).filter("muted").select("cluster_id", "ts", "until")
    by_spans = alerts.span_alerts(samples, spans, alerts.too_hot(20.0))
    by_switches = alerts.muted_alerts(samples, log, alerts.too_hot(20.0))
    assert by_spans.count() > 50
    assert rows(by_spans, *by_switches.columns) == rows(by_switches, *by_switches.columns)


def test_one_cluster_with_very_many_spans(spark):
    """100,000 spans of one cluster, many of them long and overlapping, cost two marks each."""
    spans = spark.range(100_000).selectExpr(
        "1L AS cluster_id", f"{AT.format('id * 10')} AS ts",
        f"IF(id % 1000 = 0, NULL, {AT.format('id * 10 + IF(id % 100 = 0, 500000, 3)')}) AS until")
    points = spark.range(3000).selectExpr("1L AS cluster_id", "'core' AS metric", "id AS sample_id",
                                          f"{AT.format('id * 333 + 1')} AS ts", "99D AS value")
    got = {r["sample_id"]: (r["open_spans"], r["begun_spans"])
           for r in spans_at(points, spans, ["cluster_id"], "sample_id").collect()}
    for i in range(0, 3000, 97):
        s = i * 333 + 1
        begun = min(100_000, s // 10 + 1)
        open_ = sum(1 for k in range(begun) if k % 1000 == 0 or s < k * 10 + (500_000 if k % 100 == 0 else 3))
        assert got[i] == (open_, begun)


def test_nothing_to_mute(spark):
    points = samples_of(spark, [(1, 0, 10, 99.0), (1, 1, 20, 99.0)])
    none = spans_of(spark, [(2, 0, 100)])
    assert [r["sample_id"] for r in alerts.span_alerts(points, none).collect()] == [0]
    assert alerts.span_alerts(points.limit(0), none).collect() == []
