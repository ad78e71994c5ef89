"""Largest-remainder split by real weights, against a plain loop."""

import math
import random

import pytest

from fleetwright.operators.weights import apportion_weights


def plain(rows, totals, floor=1.0, whole=100.0):
    groups, out = {}, []
    for group, idx, weight in rows:
        clean = weight if weight is not None and weight > 0 and weight < math.inf else 0.0
        groups.setdefault(group, []).append((idx, clean))
    for group, held in groups.items():
        total = totals.get(group)
        if total is None:
            continue
        share = {i: total * w / (whole or 1) for i, w in held}
        base = {i: max(floor, math.floor(s)) for i, s in share.items()}
        left = max(0.0, total - sum(base.values()))
        order = sorted(share, key=lambda i: (-(share[i] - math.floor(share[i])), i))
        out += [(group, i, base[i], float(turn < left)) for turn, i in enumerate(order)]
    return sorted(out)


def run(spark, rows, totals, **options):
    frame = spark.createDataFrame(rows, "cluster_id long, job_idx long, weight double").repartition(7)
    given = spark.createDataFrame(list(totals.items()), "cluster_id long, rem_exec double")
    got = apportion_weights(frame, given, **options)
    assert got.columns == ["cluster_id", "job_idx", "weight", "base", "extra", "assigned"]
    return sorted((r["cluster_id"], r["job_idx"], r["base"], r["extra"]) for r in got.collect() if r["assigned"] == r["base"] + r["extra"])


def some_rows(seed):
    rng = random.Random(seed)
    rows, totals = [], {}
    for group in range(25):
        n = rng.choice([1, 2, 5, 40])
        rows += [(group, i, rng.choice([rng.random() * 9, 12.5, 0.0, rng.random() * 1e-12, 5e-300 * (1 + i), None, -1.0, math.nan, math.inf, 33.3]))
                 for i in rng.sample(range(10**6), n)]
        totals[group] = rng.choice([0.0, 1.0, 7.0, 100.0, 2.5, 30.25, 1e6, None])
    return rows, totals


@pytest.mark.parametrize("options", [{}, {"bits": 3, "digits": 2}, {"digits": 30}])
def test_equals_a_plain_loop(spark, options):
    rows, totals = some_rows(1)
    assert run(spark, rows, totals, **options) == plain(rows, totals)
    assert run(spark, rows, totals, floor=0.0, **options) == plain(rows, totals, 0.0)


def test_one_hot_group(spark):
    """Most rows in one group, and most of these with equal fractions: the leftover ends among the equal ones."""
    rng = random.Random(2)
    rows = [(1, i, 0.0005 if i % 3 else 0.0001 + rng.random() / 1000) for i in range(30_000)] + [(2, 0, 50.0), (2, 1, 50.0)]
    totals = {1: 15_000.0, 2: 3.0}
    want = plain(rows, totals, 0.0)
    marginal = [r for r in want if r[0] == 1 and rows[r[1]][2] == 0.0005]
    assert {r[3] for r in marginal} == {0.0, 1.0}
    assert run(spark, rows, totals, floor=0.0, bits=8) == want


def test_shares_of_the_groups_own_sum(spark):
    rows = [(1, i, float(w)) for i, w in enumerate([3, 1, 1, 1])] + [(2, 0, 0.0), (2, 1, None)]
    got = run(spark, rows, {1: 7.0, 2: 5.0}, whole=None, floor=0.0)
    assert got == [(1, 0, 3.0, 1.0), (1, 1, 1.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 1.0, 0.0), (2, 0, 0.0, 1.0), (2, 1, 0.0, 1.0)]


def test_does_not_depend_on_the_order_of_rows(spark):
    rows, totals = some_rows(5)
    first = run(spark, rows, totals)
    random.Random(3).shuffle(rows)
    assert run(spark, rows, totals) == first


def test_empty(spark):
    assert run(spark, [], {1: 5.0}) == [] and run(spark, [(1, 0, 5.0)], {}) == []
