"""Totals, status and series of a cluster's job plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.bands import band
from fleetwright.functions.columns import derive, open_rows, records
from fleetwright.functions.numbers import at_least, floor_d, half_up, one_decimal, percent
from fleetwright.operators.jobs import JobOptions, with_settings


def _sums(allocs: DataFrame) -> DataFrame:
    # Overhead adds up figures rounded to a tenth; whole tenths keep the sum order-free.
    return allocs.groupBy("cluster_id").agg(*[F.expr(e) for e in (
        "CAST(count(1) AS DOUBLE) AS jobs", "sum(job_exec) AS used_exec",
        "sum(job_cores) AS job_used_cores", "sum(job_mem) AS used_mem",
        f"sum({half_up('job_oh_gb * 10')}) / 10 AS used_oh")])


def _with_sums(pool: DataFrame, allocs: DataFrame) -> DataFrame:
    return derive(pool.join(_sums(allocs), "cluster_id", "left"), {
        name: f"coalesce({name}, 0D)"
        for name in ("jobs", "used_exec", "job_used_cores", "used_mem", "used_oh")})


def plan_totals(allocs: DataFrame, pool: DataFrame) -> DataFrame:
    """A4: what the jobs take of each pool, with the signed remainder.

    The free percentage mixes two bases (pool and remaining pool) and is kept that way.
    """
    return _with_sums(pool, allocs).selectExpr(
        "cluster_id", "jobs", "pool_exec", "pool_cores", "pool_mem", "pool_oh", "pool_total",
        "res_exec", "res_cores", "res_mem", "res_oh", "rem_exec", "rem_cores", "rem_mem",
        "used_exec", "job_used_cores", "used_mem", "used_oh",
        "rem_exec - used_exec AS left_exec", "rem_cores - job_used_cores AS left_cores",
        "rem_mem - used_mem AS left_mem",
        f"{percent('used_exec', 'rem_exec')} AS exec_used_pct",
        f"{percent('job_used_cores', 'rem_cores')} AS core_used_pct",
        f"{percent('used_mem', 'rem_mem')} AS mem_used_pct",
        f"{percent('res_cores', 'pool_cores')} AS core_reserved_pct",
        f"{percent('res_mem', 'pool_mem')} AS mem_reserved_pct",
        f"{at_least(0, '100 - core_reserved_pct - core_used_pct')} AS core_free_pct")


def capacity_summary(totals: DataFrame) -> DataFrame:
    """A5: headline figures and the split into jobs, reserved and free, per cluster."""
    def row(section, item, value, of="NULL", pct="NULL"):
        return {"section": f"'{section}'", "item": f"'{item}'", "value": value,
                "of": f"CAST({of} AS DOUBLE)", "pct": f"CAST({pct} AS DOUBLE)",
                "band": band("capacity", pct) if section == "headline" and pct != "NULL"
                else "CAST(NULL AS STRING)"}

    df = derive(totals, {f"free_{x}": at_least(0, f"left_{x}") for x in ("exec", "cores", "mem")})
    rows = [
        row("headline", "executors", "used_exec", "rem_exec", "exec_used_pct"),
        row("headline", "tasks", "job_used_cores", "rem_cores", "core_used_pct"),
        row("headline", "heap_gb", "used_mem", "rem_mem", "mem_used_pct"),
        row("headline", "overhead_gb", "used_oh"),
        row("headline", "unallocated_tasks", "free_cores"),
        row("headline", "reserved_executors", "res_exec"),
    ]
    splits = {
        "executors": ("pool_exec", "used_exec", "res_exec", "free_exec"),
        "tasks": ("pool_cores", "job_used_cores", "res_cores", "free_cores"),
        "heap_gb": ("pool_mem", "used_mem", "res_mem", "free_mem"),
    }
    rows += [row(section, item, value, whole, percent(value, whole))
             for section, (whole, *values) in splits.items()
             for item, value in zip(("jobs", "reserved", "free"), values, strict=True)]
    return open_rows(df, ["cluster_id"], records(rows))


def job_plan_status(totals: DataFrame, options: JobOptions = JobOptions()) -> DataFrame:
    """R2: over-allocated, under-used or fine, with what to change."""
    df = derive(totals.filter("jobs > 0"), {
        "_over": "left_exec < 0 OR left_cores < 0 OR left_mem < 0",
        "_under": "NOT _over AND left_exec > rem_exec * 0.25D AND rem_exec > 0"})
    hits = {"J1": "left_exec < 0", "J2": "left_cores < 0", "J3": "left_mem < 0", "J4": "_over",
            "J5": "_under", "J6": "NOT _over AND NOT _under"}
    rules = ", ".join(f"IF({cond}, '{rule}', NULL)" for rule, cond in hits.items())
    enforced = "enf_je" if "enf_je" in totals.columns else str(options.enforce_executors).lower()
    lower = f"IF({enforced} AND left_exec < 0, {at_least(1, floor_d('rem_exec / jobs'))}, NULL)"
    return df.selectExpr(
        "cluster_id", "CASE WHEN _over THEN 'over' WHEN _under THEN 'under' ELSE 'ok' END AS status",
        f"concat_ws(',', {rules}) AS rules",
        *[f"IF(left_{x} < 0, -left_{x}, 0D) AS short_{x}" for x in ("exec", "cores", "mem")],
        f"CAST({lower} AS DOUBLE) AS fix_min_executors",
        "_over AND left_cores < 0 AS fix_reduce_shares", "_over AS fix_drop_reservation",
        "IF(_over, greatest(1D, jobs - 1), NULL) AS fix_jobs",
        f"IF(_under, {percent('left_exec', 'rem_exec')}, NULL) AS unused_pct", "core_used_pct")


def job_floor_alerts(allocs: DataFrame, options: JobOptions = JobOptions()) -> DataFrame:
    """Pools that cannot give every job its minimum.

    J7 and J8 count jobs below a minimum; enforcement has already raised those, so both
    stay zero. The alert key is what `change_alerts` compares over time.
    """
    min_exec, min_tasks, je, jt = "_min_je", "_min_jc", "_enf_je", "_enf_jc"
    settled = allocs if "_enf_je" in allocs.columns else with_settings(allocs, options)
    kept = ("rem_exec", "rem_cores", min_exec, min_tasks, je, jt)
    joined = settled.groupBy("cluster_id").agg(*[F.expr(e) for e in (
        "CAST(count(1) AS DOUBLE) AS jobs", f"count_if({je} AND job_exec < {min_exec}) AS j7",
        f"count_if({jt} AND job_cores < {min_tasks}) AS j8",
        *[f"any_value({name}) AS {name}" for name in kept])])
    return derive(joined, {
        "need_exec": f"jobs * {min_exec}", "need_tasks": f"jobs * {min_tasks}",
        "over_exec": f"{je} AND rem_exec < need_exec",
        "over_tasks": f"{jt} AND rem_cores < need_tasks",
        "alert_key": "concat(IF(j7 + j8 > 0, 'BELOW', ''), IF(over_exec, 'OE', ''),"
                     " IF(over_tasks, 'OC', ''))",
        "fires": "over_exec OR j7 + j8 > 0",
        "feasible_min": f"IF(over_exec, {floor_d('rem_exec / jobs')}, NULL)",
        "feasible_jobs": f"IF(over_exec, {floor_d(f'rem_exec / {min_exec}')}, NULL)",
    }).drop(min_exec, min_tasks, je, jt)


def _series(df: DataFrame, pos: str, label: str, rows: list[dict[str, str]]) -> DataFrame:
    return df.selectExpr("cluster_id", f"CAST({pos} AS BIGINT) AS pos", f"{label} AS label",
                         f"inline({records(rows)})")


def pool_segments(allocs: DataFrame, pool: DataFrame) -> DataFrame:
    """Reserved, each job and what is left, as parts of the pool's cores and heap."""
    def part(resource, value, total, keep="true"):
        return {"resource": f"'{resource}'", "value": value, "total": total, "keep": keep}

    jobs = _series(allocs, "job_idx + 1", "job_name", [
        part("cores", "job_cores", "pool_cores"), part("heap_gb", "job_mem", "pool_mem")])
    ends = _with_sums(pool, allocs)
    reserved = [part("cores", "res_cores", "pool_cores", "res_cores > 0"),
                part("heap_gb", "res_mem", "pool_mem", "res_mem > 0")]
    free_cores = "pool_cores - res_cores - job_used_cores"
    free_mem = "pool_mem - res_mem - used_mem"
    free = [part("cores", free_cores, "pool_cores", f"jobs > 0 AND {free_cores} > 0"),
            part("heap_gb", free_mem, "pool_mem", f"jobs > 0 AND {free_mem} > 0")]
    rows = records(
        [{"label": "'reserved'", "pos": "0L", **r} for r in reserved]
        + [{"label": "'available'", "pos": "CAST(jobs + 1 AS BIGINT)", **r} for r in free])
    both = ends.selectExpr("cluster_id", f"inline({rows})").unionByName(jobs).filter("keep")
    return both.selectExpr("cluster_id", "pos", "label AS segment", "resource", "value", "total",
                           f"{percent('value', 'total')} AS pct")


def job_chart_series(allocs: DataFrame, pool: DataFrame) -> DataFrame:
    """Long series behind the job charts; reserved overhead includes the Python share."""
    def points(tasks, heap, overhead):
        return [{"measure": "'tasks'", "value": tasks, "whole": "pool_cores"},
                {"measure": "'heap_gb'", "value": heap, "whole": "pool_mem"},
                {"measure": "'overhead_gb'", "value": overhead, "whole": "pool_mem"}]

    executors = {"measure": "'executors'", "value": "job_exec", "whole": "CAST(NULL AS DOUBLE)"}
    jobs = _series(allocs, "job_idx + 1", "job_name",
                   [*points("job_cores", "job_mem", "job_oh_gb"), executors])
    ends = derive(_with_sums(pool, allocs), {
        "_res_oh": one_decimal("(res_oh_mb + IF(pyspark, res_exec * 1024, 0D)) / 1024")})
    reserved = points("res_cores", "res_mem", "_res_oh")
    unused = points(at_least(0, "rem_cores - job_used_cores"), at_least(0, "rem_mem - used_mem"),
                    "0D")
    first = records([{"label": "'reserved'", "pos": "0L", **r} for r in reserved])
    last = records([{"label": "'unused'", "pos": "CAST(jobs + 1 AS BIGINT)", **r} for r in unused])
    rows = ends.selectExpr("cluster_id", f"inline(IF(jobs > 0, concat({first}, {last}), {first}))")
    return rows.unionByName(jobs).selectExpr(
        "cluster_id", "pos", "label AS series", "measure", "value",
        f"IF(whole IS NULL, NULL, {percent('value', 'whole')}) AS pct")
