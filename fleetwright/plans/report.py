"""Report sections as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetwright.functions.bands import band
from fleetwright.functions.columns import derive, records
from fleetwright.functions.numbers import half_up, one_decimal, overhead_mb, pyspark_mb
from fleetwright.functions.text import say
from fleetwright.operators.sizing import ON_CLUSTER

DRIVER_PLACE = f"IF({ON_CLUSTER}, 'on a worker node', 'outside the worker pool')"


def _switch(flag: str) -> str:
    return f"IF({flag}, 'on', 'off')"


# Section -> (key, value, note); `_…` columns are prepared by the operator.
SECTIONS = {
    "spec": [
        ("hardware", say("{nodes} x {cpn} cores x {rpn} GB"), "''"),
        ("total", say("{total_cores} cores, {total_ram} GB"), "''"),
        ("deploy mode", "upper(deploy_mode)", "''"),
        ("resource manager", "upper(rm)", "''"),
        ("spark version", "sv", "''"),
        ("workload", "upper(workload)", "''"),
    ],
    "derivation": [
        ("usable cores per node", say("{_usable}"), say("{cpn} - {os_cr}")),
        ("executor cores", say("{exec_c}"), say("{wl}, minimum {min_ec}", wl="workload")),
        ("executors per node", say("{exec_pn}"), say("floor({_usable} / {exec_c})")),
        ("memory per node", say("{avail_ram} GB"), say("{rpn} - {os_r} - {rm_r}")),
        ("executor memory", say("{exec_m} GB"), say("floor({avail_ram} / {exec_pn} * 0.875)")),
        ("memory overhead", say("{exec_oh} MB"), say("max(384, 10% of {exec_m} GB)")),
        ("executor nodes", say("{exec_nodes}"),
         f"IF({ON_CLUSTER}, {say('{nodes} - 1')}, {say('all {nodes}')})"),
        ("executors", say("{total_exec}"), say("{exec_nodes} * {exec_pn}")),
        ("concurrent tasks", say("{total_ec}"), say("{total_exec} * {exec_c}")),
        ("default parallelism", say("{para}"),
         say("{total_ec} * {factor}", factor="IF(workload = 'ml', '3', '2')")),
    ],
    "utilisation": [
        ("cores", say("{used_cores} / {total_cores} ({core_util}%)"), band("report", "core_util")),
        ("memory", say("{_used} / {total_ram} GB ({mem_util}%)"), band("report", "mem_util")),
        ("concurrent tasks", say("{total_ec}"), "''"),
        ("parallelism", say("{para}, shuffle {shuf_p}"), "''"),
        ("features", say("aqe {aqe}, dynamic allocation {dyn}, pyspark {py}", aqe=_switch("aqe"),
                         dyn=_switch("dyn_alloc"), py=_switch("pyspark")), "''"),
    ],
    "memory": [
        ("executor heap", say("{pool_mem} GB"), say("{total_exec} * {exec_m}")),
        ("executor overhead", say("{pool_oh} GB"), say("{total_exec} * {exec_oh} MB")),
        ("driver", f"IF({ON_CLUSTER}, {say('{drv_m} GB + {drv_oh} MB')}, 'outside the worker pool')",
         f"IF({ON_CLUSTER}, 'one worker node', '')"),
        ("reserves", say("{_reserves} GB"), say("{nodes} * ({os_r} + {rm_r})")),
        ("unused", say("{_free} GB, {unused_cores} cores"), "''"),
    ],
    "summary": [
        ("os reserve per node", say("{os_r} GB"), "''"),
        ("rm reserve per node", say("{rm_r} GB"), "''"),
        ("os cores per node", say("{os_cr}"), "''"),
        # Both percentages are of installed capacity; the amounts name what is usable.
        ("core use", say("{core_util}%"), say("{used_cores} used, {usable_total_cores} usable")),
        ("memory use", say("{mem_util}%"), say("{_executors} GB in executors, {_usable_ram} GB usable")),
        ("driver memory", say("{drv_m} GB"), DRIVER_PLACE),
        ("driver cores", say("{drv_c}"), DRIVER_PLACE),
    ],
    "plan": [
        ("pool", say("{pool_exec} exec, {pool_cores} tasks, {pool_mem} GB heap, {pool_oh} GB overhead"),
         "'all executors'"),
        ("reserved", say("{res_exec} exec, {res_cores} tasks, {res_mem} GB heap"),
         say("{res_n} reservations")),
        ("remaining", say("{rem_exec} exec, {rem_cores} tasks, {rem_mem} GB heap"),
         "'pool less reserved'"),
    ],
}


def report_tables(pool: DataFrame, allocs: DataFrame, profile: DataFrame) -> DataFrame:
    """(cluster, section, pos, key, value, note) for all report sections.

    The reservation list leaves the Python share out of the overhead, as the on-screen
    report does; `report_reservations` has the exported table, which includes it.
    """
    prepared = derive(pool, {
        "_usable": "cpn - os_cr", "_used": half_up("used_ram"), "_free": half_up("unused_ram"),
        "_reserves": half_up("reserve_ram"), "_executors": half_up("exec_ram_gb"),
        "_usable_ram": half_up("usable_total_ram")})
    rows = records([
        {"section": f"'{section}'", "pos": f"{i}L", "key": f"'{key}'", "value": value, "note": note}
        for section, cells in SECTIONS.items()
        for i, (key, value, note) in enumerate(cells, start=1)])
    amounts = "{%s} exec, {%s} tasks, {%s} GB heap, {%s} GB overhead"
    plain = derive(profile, {"_oh_gb": one_decimal(f"exec_count * {overhead_mb('exec_mem_gb')} / 1024")})
    reserved = plain.selectExpr(
        "cluster_id", "'reserved' AS section", "res_idx + 1 AS pos", "res_name AS key",
        f"{say(amounts % ('exec_count', 'res_cores', 'res_mem', '_oh_gb'))} AS value",
        f"{say('{exec_count} x {exec_cores} cores x {exec_mem_gb} GB')} AS note")
    jobs = allocs.selectExpr(
        "cluster_id", "'jobs' AS section", "job_idx + 1 AS pos", "job_name AS key",
        f"{say(amounts % ('job_exec', 'job_cores', 'job_mem', 'job_oh_gb'))} AS value",
        f"{say('{pct}%: {job_exec} x {job_exec_c} cores x {job_heap} GB')} AS note")
    return prepared.selectExpr("cluster_id", f"inline({rows})").unionByName(reserved).unionByName(jobs)


def report_reservations(profile: DataFrame) -> DataFrame:
    """Exported reservation table; the overhead includes the Python share when set."""
    return profile.selectExpr(
        "cluster_id", "res_idx", "res_name", "exec_count", "exec_cores", "exec_mem_gb", "res_oh",
        "res_cores", "res_mem", f"{one_decimal('res_mem + res_oh_gb')} AS total_gb")


def report_jobs(allocs: DataFrame) -> DataFrame:
    """Exported job table with the overhead split into base and Python share."""
    return allocs.selectExpr(
        "cluster_id", "job_idx", "job_name", "pct", "job_exec", "job_cores", "job_exec_c",
        "job_heap", "job_oh", f"job_oh - {pyspark_mb()} AS base_oh", "job_mem",
        f"{one_decimal('job_mem + job_oh_gb')} AS total_gb", "job_para")
