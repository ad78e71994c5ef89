"""Step-by-step derivations of the computed figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.bands import band
from fleetwright.functions.columns import derive, records
from fleetwright.functions.numbers import fixed_text, half_up, nonzero
from fleetwright.functions.text import say
from fleetwright.operators.sizing import ON_CLUSTER

POOL_STEPS = 7
JOB_STEPS = 7

RULE = ("CASE workload WHEN 'streaming' THEN 'fixed 2' WHEN 'ml' THEN 'up to 8'"
        " ELSE 'up to 5, even split' END")
DAEMON = ("CASE rm WHEN 'standalone' THEN 'worker daemon' WHEN 'k8s' THEN 'kubelet'"
          " ELSE 'resource manager' END")
PYTHON = "IF(pyspark, ' + 1024', '')"

# (step, formula, result); `_…` columns are prepared by the operator.
SIZING_STEPS = [
    ("usable cores per node", say("{cpn} - {os_cr}"), say("{_usable}")),
    ("cores per executor",
     say("{workload}: {rule}; minimum {min_ec}{how}", workload="workload", rule=RULE,
         how="IF(enf_c, ' enforced', ' advisory')"), say("{exec_c}")),
    ("executors per node", say("floor({_usable} / {exec_c})"), say("{exec_pn}")),
    ("memory per node",
     f"IF(rm = 'local', {say('{rpn} - {os_r}')},"
     f" {say('{rpn} - {os_r} - {rm_r} {daemon}', daemon=DAEMON)})", say("{avail_ram} GB")),
    ("heap per executor",
     say("floor({avail_ram} / {exec_pn} * 0.875 = {quotient}){least}",
         quotient=f"coalesce({fixed_text('_heap', 2)}, '-')",
         least=f"IF(enf_m, {say(', at least {min_em}')}, '')"), say("{exec_m} GB")),
    ("overhead per executor", say("max(384, ceil({_tenth})){py}", py=PYTHON), say("{exec_oh} MB")),
    ("executor nodes",
     f"IF({ON_CLUSTER}, {say('{nodes} - 1 for the driver')}, {say('all {nodes}')})",
     say("{exec_nodes}")),
    ("executors", say("{exec_nodes} * {exec_pn}"), say("{total_exec}")),
    ("task slots", say("{total_exec} * {exec_c}"), say("{total_ec}")),
    ("default parallelism", say("{total_ec} * {factor}", factor="IF(workload = 'ml', '3', '2')"),
     say("{para}")),
    ("shuffle partitions", say("as parallelism{how}", how="IF(aqe, ', adaptive', '')"),
     say("{shuf_p}")),
    ("core use", say("{used_cores} / {total_cores}"),
     say("{core_util}% {band}", band=band("standard", "core_util"))),
    ("memory use", say("{_used} / {total_ram} GB"),
     say("{mem_util}% {band}", band=band("standard", "mem_util"))),
    ("unused", say("{total_cores} - {used_cores}; {total_ram} - {_used}"),
     say("{unused_cores} cores, {_free} GB")),
]

LISTED = f"IF(res_n > 0, {say('{res_n} reservations')}, 'none')"
HEADER_STEPS = [
    ("pool executors", say("{exec_nodes} * {exec_pn}"), say("{pool_exec}")),
    ("pool cores", say("{pool_exec} * {exec_c}"), say("{pool_cores}")),
    ("pool heap", say("{pool_exec} * {exec_m} GB"), say("{pool_mem} GB")),
    ("reserved executors", LISTED, say("{res_exec}")),
    ("reserved cores", LISTED, say("{res_cores}")),
    ("reserved heap", LISTED, say("{res_mem} GB")),
    ("remaining pool", say("{pool_exec} - {res_exec}"),
     say("{rem_exec} executors, {rem_cores} cores, {rem_mem} GB")),
]


def _steps(df: DataFrame, steps: list[tuple[str, str, str]], first: str, job_idx: str) -> DataFrame:
    rows = records([{"step": f"'{name}'", "formula": formula, "result": result}
                    for name, formula, result in steps])
    opened = df.selectExpr("cluster_id", f"{job_idx} AS job_idx", f"{first} AS _first",
                           f"posexplode({rows}) AS (_i, _s)")
    return opened.selectExpr("cluster_id", "job_idx", "CAST(_first + _i AS BIGINT) AS pos", "_s.*")


def derivation_trace(sized: DataFrame) -> DataFrame:
    """Fourteen ordered steps from hardware to unused capacity."""
    prepared = derive(sized, {
        "_usable": "cpn - os_cr", "_heap": f"avail_ram / {nonzero('exec_pn')} * 0.875D",
        "_tenth": half_up("exec_m * 1024 * 0.1D"), "_used": half_up("used_ram"),
        "_free": half_up("unused_ram")})
    return _steps(prepared, SIZING_STEPS, "1", "NULL").drop("job_idx")


def job_trace(allocs: DataFrame, pool: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Seven steps for each pool, then seven per job, numbered through per cluster.

    Step numbers follow from the job's position, so no ordering of the union is needed.
    With `profile` steps 4 to 6 list each reservation in rows of their own, in order of
    `res_idx`, beside the row with the sum.
    """
    raised = "(_enf_je AND raw_exec < _min_je)"
    note = (f"CASE WHEN job_exec > raw_exec AND {raised} THEN ', raised to the minimum'"
            " WHEN job_exec > raw_exec THEN ', plus remainder'"
            f" WHEN job_exec = raw_exec AND NOT ({raised}) THEN ', no remainder' ELSE '' END")
    heap = f"IF(_gb > 0, {say('{job_exec_c} * {_gb} GB per core')}, 'cluster setting')"
    origin = "IF(_ec > 0, 'own setting', 'cluster setting')"
    job_steps = [
        ("executors", say("floor({rem_exec} * {pct}%) = {raw_exec}{note}", note=note),
         say("{job_exec}")),
        ("tasks", say("{job_exec} * {job_exec_c} {origin}", origin=origin), say("{job_cores}")),
        ("heap per executor", heap, say("{job_heap} GB")),
        ("overhead per executor", say("max(384, {_tenth}){py}", py=PYTHON), say("{job_oh} MB")),
        ("heap", say("{job_exec} * {job_heap}"), say("{job_mem} GB")),
        ("heap and overhead", say("{job_mem} + {job_oh_gb}"), say("{job_total_gb} GB")),
        ("parallelism", say("{job_cores} * 2"), say("{job_para}")),
    ]
    header = _steps(pool, HEADER_STEPS, "1", "CAST(NULL AS BIGINT)")
    prepared = derive(allocs, {"_tenth": half_up("job_heap * 1024 * 0.1D")})
    per_job = _steps(prepared, job_steps, f"job_idx * {JOB_STEPS} + {POOL_STEPS + 1}", "job_idx")
    rows = header.unionByName(per_job).withColumn("res_idx", F.lit(None).cast("bigint"))
    if profile is None:
        return rows
    listed = [("reserved executors", "{exec_count} executors", "{exec_count}"),
              ("reserved cores", "{exec_count} * {exec_cores}", "{res_cores}"),
              ("reserved heap", "{exec_count} * {exec_mem_gb}", "{res_mem} GB")]
    each = records([{"step": f"'{name}'", "formula": say("{res_name}: " + formula, res_name="res_name"), "result": say(result)}
                    for name, formula, result in listed])
    own = profile.selectExpr("cluster_id", "CAST(NULL AS BIGINT) AS job_idx", "res_idx", f"posexplode({each}) AS (_i, _s)")
    return rows.unionByName(own.selectExpr(
        "cluster_id", "job_idx", "CAST(4 + _i AS BIGINT) AS pos", "_s.*", "res_idx"))
