"""Shape of the physical plans."""

import re

import pytest

from fleetwright import registry
from fleetwright.registry import QUERIES

NO_SHUFFLE = ["s1_read_specs", "z1_size_fleet", "z2_scaling_curve", "z3_what_if", "u1_utilisation",
              "u3_memory_ledger", "u5_capacity_bars", "r1_evaluate_warnings", "x3_derivation_trace",
              "t5_submit_commands", "t6_scheduler_properties"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("s4_") and not n.endswith("_stream")])
def test_stays_in_the_jvm_without_products(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search(r"EvalPython|InPandas|InArrow", text)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_narrow(spark, sf_dir, name):
    assert not re.search(r"Exchange (hash|range|single|RoundRobin)", plan(QUERIES[name](spark, sf_dir)))


def test_one_shuffle_each(spark, sf_dir):
    for name in ("p5_apply_overrides", "u8_fleet_rollup", "r7_tuning_hints", "v4_usage_windows"):
        assert plan(QUERIES[name](spark, sf_dir)).count("Exchange hashpartitioning") == 1, name


def test_overrides_combine_before_the_shuffle(spark, sf_dir):
    assert "partial_max_by" in plan(QUERIES["p5_apply_overrides"](spark, sf_dir))


def test_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["a3_remaining_pool"](spark, sf_dir))
    scan = next(s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_partkey" in s)
    assert set(re.findall(r"l_\w+", scan)) == {"l_orderkey", "l_partkey", "l_suppkey"}
    split = plan(QUERIES["n3_apportion_export"](spark, sf_dir))
    assert "exec_m" not in split and "drv_m" not in split


def test_ranking_is_narrow(spark, sf_dir):
    """What is sorted to rank jobs carries the job, its share and the cluster's few numbers only."""
    text = plan(QUERIES["n4_finalise_allocs"](spark, sf_dir))
    window = next(x for x in text.splitlines() if "row_number()" in x and "Window" in x)
    assert "exec_m" not in window and "drv_m" not in window


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


@pytest.mark.parametrize("name", ["a4_plan_totals", "a5_capacity_summary", "r2_job_plan_status", "x1_pool_segments",
                                  "x2_job_chart_series"])
def test_one_allocation_per_query(spark, sf_dir, name):
    """Allocation and pool come from stored stages: what remains reads neither lineitem nor customer."""
    text = final_plan(QUERIES[name](spark, sf_dir))
    assert "l_orderkey" not in text and "c_custkey" not in text
    assert len(re.findall(r"FileScan parquet|Scan parquet", text)) >= 1


@pytest.mark.parametrize("name", ["n4_finalise_allocs", "r3_job_floor_alerts"])
def test_the_pool_is_stored_once(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "l_orderkey" not in text and "c_custkey" not in text


def test_stored_plans_are_narrow(spark, sf_dir):
    allocated, _ = registry.planned(spark, sf_dir)
    assert len(allocated.columns) <= 25


@pytest.mark.parametrize("name", ["n3_apportion_export", "n4_finalise_allocs", "t4_render_job_text", "n8_job_share", "n7_allocation_diff"])
def test_jobs_are_numbered_once(spark, sf_dir, name):
    """The split reads the stored, numbered jobs: twice, and not a third time for the pool's columns."""
    text = plan(QUERIES[name](spark, sf_dir))
    scans = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "job_idx" in s]
    assert "o_orderkey" not in text and 1 <= len(scans) <= 3, scans


@pytest.mark.parametrize("name", ["x4_job_trace", "s5_plan_documents", "s6_report_tables"])
def test_reservations_and_clusters_are_read_once(spark, sf_dir, name):
    text = final_plan(QUERIES[name](spark, sf_dir))
    assert "l_orderkey" not in text and "o_orderkey" not in text
    assert text.count("c_custkey") == 0 or name == "s5_plan_documents"  # which lists each cluster's additions


def test_entries_are_written_by_generated_code(spark, sf_dir):
    """Reading JSON is not generated code: what it reads must be a column, not all fields of the entry."""
    text = plan(QUERIES["s5_plan_documents"](spark, sf_dir))
    reads = [line for line in text.splitlines() if "from_json(" in line]
    assert len(reads) >= 4 and not any("StructsToJsonEvaluator" in line for line in reads)


def test_reservations_are_not_broadcast(spark, sf_dir):
    """Neither to their owners nor the owners to them, whichever side looks small."""
    text = plan(registry.profile_of(registry.reserved(spark, sf_dir), registry.sized(spark, sf_dir)))
    assert re.search(r"SortMergeJoin \[cluster_id#\d+L, slice#\d+L\]", text)


def test_lines_are_summed_up_before_numbering(spark, sf_dir, monkeypatch):
    """Numbering reads its rows twice: it must find them stored."""
    seen = []
    number = registry.fixtures.number_reservations
    monkeypatch.setattr(registry.fixtures, "number_reservations", lambda rows: seen.append(plan(rows)) or number(rows))
    registry.reserved(spark, sf_dir)
    assert len(seen) == 1 and "l_orderkey" not in seen[0]


def test_clusters_are_dealt_before_they_are_sized(spark, sf_dir):
    """The pool shuffles specs, not sized rows, and properties come from dealt clusters."""
    lines = plan(QUERIES["a3_remaining_pool"](spark, sf_dir)).splitlines()
    dealt = next(i for i, line in enumerate(lines) if "REPARTITION_BY_COL" in line)
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "c_custkey" in line)
    assert dealt < scan and not any("FLOOR" in line for line in lines[dealt:scan])
    assert "REPARTITION_BY_COL" in plan(registry.fixtures.custom_props(spark, sf_dir, dealt=True))
