"""The distributed split against a plain loop, over random plans and tiny blocks."""

import math
import random

import pytest

from fleetwright.operators import jobs


def round_up(x):
    return math.floor(x) + (1 if x - math.floor(x) >= 0.5 else 0)


def shares(manual):
    manual = [None if p is None else min(100, max(0, p)) for p in manual]
    given = [p for p in manual if p is not None]
    autos = len(manual) - len(given)
    even = round_up(max(0, 100 - sum(given)) / autos) if autos else 0
    return [float(even if p is None else p) for p in manual]


def split(remaining, manual, basis, floor):
    pct = shares(manual)
    base = [max(floor, 1.0, math.floor(remaining * (p / 100) if basis == "screen" else remaining * p / 100))
            for p in pct]
    left = max(0.0, remaining - sum(base))
    frac = [remaining * p / 100 - math.floor(remaining * p / 100) for p in pct]
    out = list(base)
    for i in sorted(range(len(pct)), key=lambda i: -frac[i]):
        if left <= 0:
            break
        out[i] += 1
        left -= 1
    return base, out


@pytest.fixture(scope="module")
def plans():
    rng = random.Random(7)
    cases = []
    for i in range(300):
        n = rng.choice([1, 2, 3, 5, 9, 17, 40])
        manual = [rng.choice([None, None, rng.randint(0, 60), rng.randint(0, 60), rng.choice([-1, -7, 150])]) for _ in range(n)]
        cases.append((i, float(rng.randint(0, 400)) + rng.choice([0, 0, 0.5]), manual))
    # One plan far larger than the rest, spread over many blocks.
    cases.append((999, 12345.0, [rng.choice([None, 0, 1, 2]) for _ in range(3000)]))
    return cases


@pytest.fixture(scope="module")
def frames(spark, plans):
    pool = spark.createDataFrame([(i, r) for i, r, _ in plans], "cluster_id bigint, rem_exec double")
    flat = [(i, i * 10_000 + j, j, p) for i, _, manual in plans for j, p in enumerate(manual)]
    random.Random(1).shuffle(flat)
    table = spark.createDataFrame(flat, "cluster_id bigint, job_id bigint, job_idx bigint, manual_pct int")
    return table, pool


@pytest.mark.parametrize("bits", [2, 20])
@pytest.mark.parametrize("basis", ["screen", "export"])
@pytest.mark.parametrize("floor", [None, 3])
def test_split_equals_loop(frames, plans, basis, bits, floor):
    options = jobs.JobOptions(enforce_executors=floor is not None, min_executors=floor or 1)
    got = {(r["cluster_id"], r["job_idx"]): r["assigned_exec"]
           for r in jobs.apportion(*frames, basis, options, bits).collect()}
    expected = {}
    for i, remaining, manual in plans:
        base, out = split(remaining, manual, basis, floor or 1)
        expected.update({(i, j): e for j, e in enumerate(out)})
        extras = [o - b for o, b in zip(out, base, strict=True)]
        assert set(extras) <= {0, 1}
    assert got == expected


@pytest.mark.parametrize("bits", [2, 20])
def test_shares_equal_loop(frames, plans, bits):
    got = {(r["cluster_id"], r["job_idx"]): r["pct"]
           for r in jobs.balance_shares(frames[0], bits).collect()}
    assert got == {(i, j): p for i, _, manual in plans for j, p in enumerate(shares(manual))}


@pytest.mark.parametrize("bits", [2, 20])
def test_diff_equals_loop(frames, plans, bits):
    got = {(r["cluster_id"], r["job_idx"]): (r["screen_exec"], r["export_exec"])
           for r in jobs.allocation_diff(*frames, bits=bits).collect()}
    expected = {}
    for i, remaining, manual in plans:
        both = zip(split(remaining, manual, "screen", 1)[1], split(remaining, manual, "export", 1)[1], strict=True)
        expected.update({(i, j): pair for j, pair in enumerate(both) if pair[0] != pair[1]})
    assert got == expected and expected


def test_enforced_minimums_hold(spark, frames):
    options = jobs.JobOptions(cores_per_executor=3, enforce_executors=True, min_executors=2,
                              enforce_tasks=True, min_tasks=10)
    table, pool = frames
    full = pool.selectExpr("*", "4D AS exec_c", "8D AS exec_m", "true AS pyspark")
    allocs = jobs.allocate(table, full, options=options)
    assert allocs.filter("job_exec < 2 OR job_cores < 10").count() == 0
    one = allocs.filter("cluster_id = 0").first()
    assert one["job_oh"] == 819 + 1024 and one["job_jvm_gb"] == 8 + 1.8


@pytest.mark.parametrize("bits", [1, 20])
def test_materialised_positions(spark, bits):
    clusters = spark.createDataFrame([(1, 5.0), (2, 0.0), (3, None), (4, 1.0), (5, 9.0)],
                                     "cluster_id bigint, num_jobs double")
    present = spark.createDataFrame([(1, 10 + j, j, None) for j in range(8)] + [(5, 90, 0, 40)],
                                    "cluster_id bigint, job_id bigint, job_idx bigint, manual_pct int")
    got = jobs.materialise_jobs(clusters, present, bits).collect()
    count = {}
    for r in got:
        count.setdefault(r["cluster_id"], []).append(r["job_idx"])
    assert {c: sorted(v) for c, v in count.items()} == {
        1: [0, 1, 2, 3, 4], 2: [0, 1], 3: [0, 1], 4: [0], 5: list(range(9))}
    created = {(r["cluster_id"], r["job_idx"]): r["initial_pct"] for r in got if r["created"]}
    assert (1, 0) not in created and (5, 0) not in created
    assert created[(5, 1)] == 11.0 and created[(2, 0)] == 50.0


def test_odd_job_counts(spark):
    """A fraction counts whole, zero means two, and there is at least one job."""
    clusters = spark.createDataFrame([(1, 0.5), (2, -3.0), (3, 3.9), (4, 0.0), (5, None)], "cluster_id long, num_jobs double")
    none = spark.createDataFrame([], "cluster_id long, job_id long, job_idx long, manual_pct int")
    got = jobs.materialise_jobs(clusters, none).groupBy("cluster_id").count().orderBy("cluster_id").collect()
    assert [r["count"] for r in got] == [2, 1, 3, 2, 2]


def test_hand_set_zeros_fail_nothing(spark):
    """No cores per executor: a minimum of tasks cannot be met, and the job keeps its executors."""
    from fleetwright.operators import accounting, reservations
    from fleetwright.operators.sizing import size_fleet

    clusters = spark.createDataFrame([(1,)], "cluster_id long")
    zeros = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "cluster_id long, set_exec_c double, set_exec_m double, set_exec_oh double")
    sized = size_fleet(clusters, zeros)
    res = spark.createDataFrame([], "cluster_id long, exec_count double, exec_cores double, exec_mem_gb double")
    table = spark.createDataFrame([(1, 1, 0, None)], "cluster_id long, job_id long, job_idx long, manual_pct int")
    options = jobs.JobOptions(enforce_tasks=True, min_tasks=20)
    row = jobs.allocate(table, reservations.remaining_pool(sized, res), options=options).first()
    assert row["job_exec"] == row["assigned_exec"] and row["job_cores"] == 0
    assert accounting.executor_memory_breakdown(sized).count() == 4


def test_settings_of_each_cluster(spark):
    from fleetwright.operators import reservations
    from fleetwright.operators.sizing import size_fleet

    clusters = spark.createDataFrame([(1, 3.0, 2.0, True, 5.0), (2, None, None, None, None)],
                                     "cluster_id long, job_ec double, gb_per_core double, enf_je boolean, min_je double")
    res = spark.createDataFrame([], "cluster_id long, exec_count double, exec_cores double, exec_mem_gb double")
    pool = reservations.remaining_pool(size_fleet(clusters), res)
    table = spark.createDataFrame([(c, j, j, 1) for c in (1, 2) for j in range(2)], "cluster_id long, job_id long, job_idx long, manual_pct int")
    got = jobs.allocate(table, pool, options=jobs.JobOptions(cores_per_executor=4)).orderBy("cluster_id", "job_idx").collect()
    assert [(r["job_exec_c"], r["job_heap"]) for r in got[:2]] == [(3.0, 6.0)] * 2 and min(r["job_exec"] for r in got[:2]) >= 5
    assert [r["job_exec_c"] for r in got[2:]] == [4.0, 4.0] and got[2]["job_exec"] < 5
