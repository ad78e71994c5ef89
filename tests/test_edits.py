"""Logs of edits against a plain fold."""

import random

import pytest

from fleetwright.operators.edits import fold_edits, jobs_from, reservations_from

SCHEMA = "cluster_id long, s long, seq long, op string, entry long, name string, exec_count double, exec_cores double, exec_mem_gb double"
FIELDS = ["name", "exec_count", "exec_cores", "exec_mem_gb"]


def log_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "CAST(timestamp_seconds(s) AS TIMESTAMP_NTZ) AS ts").drop("s").repartition(5)


def plain(rows):
    state, numbers = {}, {}
    for cluster, _, _, op, entry, *values in sorted(rows, key=lambda r: (r[1], r[2])):
        key = (cluster, entry)
        if op == "add" and key not in state:
            numbers[cluster] = numbers.get(cluster, 0) + 1
            state[key] = {"no": numbers[cluster], "removed": False, **dict.fromkeys(FIELDS)}
        if key not in state:
            continue
        if op == "remove":
            state[key]["removed"] = True
        for field, value in zip(FIELDS, values, strict=True):
            if value is not None:
                state[key][field] = value
    out, places = [], {}
    for (cluster, entry), held in sorted(state.items(), key=lambda x: (x[0][0], x[1]["no"])):
        if not held["removed"]:
            out.append((cluster, entry, held["no"], places.get(cluster, 0), *(held[f] for f in FIELDS)))
            places[cluster] = places.get(cluster, 0) + 1
    return out


def some_log(seed, n, hot=0.0):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        cluster = 1 if rng.random() < hot else rng.randrange(4)
        op = rng.choice(["add", "add", "update", "update", "remove"]) if rng.random() < 0.9 else "update"
        values = [rng.choice([None, f"n{seq}"]), *(rng.choice([None, float(rng.randrange(9))]) for _ in range(3))]
        rows.append((cluster, rng.randrange(n // 3 + 1) * 40, seq, op, rng.randrange(n // 2 + 1), *values))
    return rows


@pytest.mark.parametrize("seconds", [3600, 100])
def test_equals_a_plain_fold(spark, seconds):
    rows = some_log(1, 600)
    got = reservations_from(log_of(spark, rows), bucket_seconds=seconds)
    assert got.columns == ["cluster_id", "entry", "res_no", "res_idx", *FIELDS]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_one_busy_cluster(spark):
    rows = some_log(2, 20_000, hot=0.9)
    assert sorted(map(tuple, reservations_from(log_of(spark, rows)).collect())) == sorted(plain(rows))


def test_numbers_are_not_used_again(spark):
    def row(s, op, entry, name=None):
        return (1, s, s, op, entry, name, None, None, None)

    rows = [row(1, "add", 10), row(2, "add", 11), row(3, "remove", 11), row(4, "add", 12), row(5, "update", 13, "before its add"),
            row(6, "add", 13), row(7, "add", 11), row(8, "update", 10, "x"), row(9, "update", 99, "never added")]
    got = reservations_from(log_of(spark, rows)).orderBy("res_idx").collect()
    # 11 was removed for good, so its second add gives neither a row nor a number.
    assert [(r["entry"], r["res_no"], r["res_idx"], r["name"]) for r in got] == [(10, 1, 0, "x"), (12, 3, 1, None), (13, 4, 2, None)]


def test_a_reset_makes_a_share_automatic(spark):
    rows = [(1, 1, "add", 7, None), (1, 2, "update", 7, 30), (1, 3, "add", 8, 40), (1, 4, "reset", 8, None), (1, 5, "reset", 7, None),
            (1, 6, "update", 7, 20)]
    log = spark.createDataFrame(rows, "cluster_id long, seq long, op string, entry long, manual_pct int").selectExpr(
        "*", "CAST(timestamp_seconds(seq) AS TIMESTAMP_NTZ) AS ts")
    assert sorted((r["job_id"], r["job_idx"], r["manual_pct"]) for r in jobs_from(log).collect()) == [(7, 0, 20), (8, 1, None)]


def test_empty(spark):
    assert fold_edits(log_of(spark, []), FIELDS, "no", "idx").collect() == []
