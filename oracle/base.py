"""Shared inputs and the sizing chain as common table expressions."""

from __future__ import annotations

from fleetwright.sources import fixtures as fx


def select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in columns.items()) + f" FROM {source}"


CLUSTERS = "clusters AS (" + select(fx.CLUSTERS, "customer") + ")"

def jobs(manual_pct: str) -> str:
    return f"""jobs AS (SELECT o_custkey AS cluster_id, o_orderkey AS job_id, {manual_pct} AS manual_pct,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS job_idx FROM orders)"""


JOBS = jobs(fx.JOB_MANUAL_PCT)

RES = """order_lines AS (SELECT l_orderkey, count(*) AS n_lines, CAST(sum(l_partkey) AS BIGINT) AS parts,
 CAST(sum(l_suppkey) AS BIGINT) AS supps FROM lineitem GROUP BY l_orderkey),
res0 AS (""" + select(fx.RESERVATIONS, "order_lines JOIN orders ON l_orderkey = o_orderkey") + """),
res AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY job_id) - 1 AS res_idx FROM res0)"""

SAMPLES = "samples AS (" + select(fx.USAGE_SAMPLES, "events") + ")"
TASK_METRICS = "task_metrics AS (" + select(fx.TASK_METRICS, "events") + ")"
MUTES = "mutes AS (" + select(fx.MUTE_LOG, "events") + " WHERE event_type = 'error')"
ALERT_KEYS = "keys AS (" + select(fx.ALERT_KEYS, "events") + ")"
LOG = "log AS (" + select(fx.OVERRIDE_LOG, "events") + ")"
PROPS = "props AS (" + " UNION ALL ".join(
    f"SELECT c_custkey AS cluster_id, {pos} AS pos, {key} AS key, {val} AS val FROM customer"
    for pos, key, val in fx.CUSTOM_PROPS) + ")"

RM = """CASE WHEN rm = 'local' THEN 0.0 WHEN coalesce(rm_r, 0) <> 0 THEN rm_r
 WHEN rm = 'k8s' THEN 2.0 ELSE 1.0 END"""

FIELDS = {"execC": "exec_c", "execPN": "exec_pn", "execM": "exec_m", "execOH": "exec_oh",
          "drvM": "drv_m", "drvC": "drv_c", "para": "para", "shufP": "shuf_p", "dynMax": "dyn_max"}

OVERRIDES = "latest AS (SELECT cluster_id, field, is_reset, value FROM (SELECT *, row_number() OVER " \
    "(PARTITION BY cluster_id, field ORDER BY ts DESC, seq DESC) AS rn FROM log) WHERE rn = 1),\n" \
    "overrides AS (SELECT cluster_id, " + ", ".join(
        f"max(CASE WHEN field = '{f}' AND NOT is_reset THEN value END) AS set_{c}"
        for f, c in FIELDS.items()) + " FROM latest GROUP BY cluster_id)"

SPEC_TAIL = """0.0::DOUBLE AS rm_r, 2.0::DOUBLE AS os_r, 1.0::DOUBLE AS os_cr, 4.0::DOUBLE AS min_ec,
 8.0::DOUBLE AS min_em, 0.6::DOUBLE AS mf, 0.5::DOUBLE AS sf, 16.0::DOUBLE AS master_ram0,
 4.0::DOUBLE AS master_cores0"""


def sizing(source: str, name: str = "sized", overrides: bool = False) -> str:
    """Sizing chain from a complete spec (rm_r unresolved) to `name`."""
    def k(field, formula):
        return f"coalesce(set_{field}, {formula})" if overrides else f"({formula})"

    start = f"SELECT * REPLACE ({RM} AS rm_r) FROM {source}"
    if overrides:
        start = f"SELECT * FROM ({start}) LEFT JOIN overrides USING (cluster_id)"
    n = name
    return f"""{n}_0 AS ({start}),
{n}_1 AS (SELECT *, nodes * cpn AS total_cores, nodes * rpn AS total_ram,
 greatest(1.0, cpn - os_cr)::DOUBLE AS usable_cpn, greatest(1.0, rpn - os_r - rm_r)::DOUBLE AS avail_ram,
 CASE WHEN deploy_mode = 'cluster' THEN greatest(1.0, nodes - 1) ELSE nodes END::DOUBLE AS exec_nodes,
 nodes * (os_r + rm_r) AS reserve_ram FROM {n}_0),
{n}_2 AS (SELECT *, CASE workload WHEN 'streaming' THEN 2.0 WHEN 'ml' THEN least(8.0, usable_cpn)
 ELSE least(5.0, floor(usable_cpn / ceil(usable_cpn / 5))) END::DOUBLE AS ec0 FROM {n}_1),
{n}_3 AS (SELECT *, {k('exec_c', 'greatest(1.0, CASE WHEN enf_c THEN greatest(min_ec, ec0) ELSE ec0 END)')}::DOUBLE AS exec_c FROM {n}_2),
{n}_4 AS (SELECT *, {k('exec_pn', 'greatest(1.0, floor(usable_cpn / exec_c))')}::DOUBLE AS exec_pn FROM {n}_3),
{n}_5 AS (SELECT *, exec_nodes * exec_pn AS total_exec, floor((avail_ram / exec_pn) * 0.875::DOUBLE) AS em0 FROM {n}_4),
{n}_6 AS (SELECT *, total_exec * exec_c AS total_ec,
 {k('exec_m', 'greatest(1.0, CASE WHEN enf_m THEN greatest(min_em, em0) ELSE em0 END)')}::DOUBLE AS exec_m FROM {n}_5),
{n}_7 AS (SELECT *,
 {k('exec_oh', 'greatest(384.0, ceil(exec_m * 1024 * 0.1::DOUBLE)) + CASE WHEN pyspark THEN 1024 ELSE 0 END')}::DOUBLE AS exec_oh,
 {k('drv_m', "CASE WHEN deploy_mode = 'cluster' THEN greatest(4.0, least(exec_m, 8.0)) ELSE greatest(4.0, least(16.0, round(total_ram * 0.02::DOUBLE))) END")}::DOUBLE AS drv_m,
 {k('drv_c', "CASE WHEN deploy_mode = 'cluster' THEN 4.0 ELSE 2.0 END")}::DOUBLE AS drv_c,
 {k('para', "total_ec * CASE WHEN workload = 'ml' THEN 3 ELSE 2 END")}::DOUBLE AS para,
 {k('dyn_max', 'total_exec')}::DOUBLE AS dyn_max FROM {n}_6),
{n}_8 AS (SELECT *, {k('shuf_p', 'para')}::DOUBLE AS shuf_p,
 total_ec + CASE WHEN deploy_mode = 'cluster' THEN drv_c ELSE 0 END AS used_cores,
 total_exec * (exec_m + exec_oh / 1024) AS exec_ram_gb,
 greatest(384.0, round(drv_m * 1024 * 0.1::DOUBLE))::DOUBLE AS drv_oh FROM {n}_7),
{n}_9 AS (SELECT *, CASE WHEN deploy_mode = 'cluster' THEN exec_ram_gb + (drv_m + drv_c * 0.25::DOUBLE) + reserve_ram
 ELSE exec_ram_gb + reserve_ram END AS used_ram,
 CASE WHEN deploy_mode = 'client' THEN greatest(1.0, master_ram0) ELSE 0.0 END::DOUBLE AS master_ram,
 CASE WHEN deploy_mode = 'client' THEN greatest(1.0, master_cores0) ELSE 0.0 END::DOUBLE AS master_cores,
 CASE WHEN deploy_mode = 'client' THEN drv_m + drv_oh / 1024 ELSE 0.0 END::DOUBLE AS master_ram_used,
 CASE WHEN deploy_mode = 'client' THEN drv_c ELSE 0.0 END::DOUBLE AS master_cores_used FROM {n}_8),
{n} AS (SELECT *, round(used_cores / greatest(1.0, total_cores) * 100) AS core_util,
 round(used_ram / greatest(1.0, total_ram) * 100) AS mem_util,
 greatest(0.0, total_cores - used_cores)::DOUBLE AS unused_cores, greatest(0.0, total_ram - used_ram)::DOUBLE AS unused_ram,
 CASE WHEN master_ram > 0 THEN round(master_ram_used / master_ram * 100) ELSE 0.0 END::DOUBLE AS master_ram_util,
 CASE WHEN master_cores > 0 THEN round(master_cores_used / master_cores * 100) ELSE 0.0 END::DOUBLE AS master_core_util,
 greatest(0.0, master_ram - master_ram_used)::DOUBLE AS master_ram_free,
 greatest(0.0, master_cores - master_cores_used)::DOUBLE AS master_cores_free,
 nodes * usable_cpn AS usable_total_cores, nodes * avail_ram AS usable_total_ram FROM {n}_9)"""


SPECS = CLUSTERS + f",\nspecs AS (SELECT *, '3.5' AS sv, 'hdfs' AS storage, {SPEC_TAIL} FROM clusters)"
SIZED = SPECS + ",\n" + sizing("specs")
SIZED_SET = SPECS + ",\n" + LOG + ",\n" + OVERRIDES + ",\n" + sizing("specs", overrides=True)

RES_TOTALS = """rt AS (SELECT cluster_id, count(*)::DOUBLE AS res_n, sum(exec_count) AS res_exec,
 sum(exec_count * exec_cores) AS res_cores, sum(exec_count * exec_mem_gb) AS res_mem FROM res GROUP BY cluster_id)"""

POOL = SIZED + ",\n" + RES + ",\n" + RES_TOTALS + """,
pool_0 AS (SELECT s.*, coalesce(res_n, 0)::DOUBLE AS res_n, coalesce(res_exec, 0)::DOUBLE AS res_exec,
 coalesce(res_cores, 0)::DOUBLE AS res_cores, coalesce(res_mem, 0)::DOUBLE AS res_mem,
 total_exec AS pool_exec, total_ec AS pool_cores, round(total_exec * exec_m) AS pool_mem,
 round(total_exec * exec_oh / 1024) AS pool_oh FROM sized s LEFT JOIN rt USING (cluster_id)),
pool AS (SELECT *, pool_mem + pool_oh AS pool_total, round(res_exec * exec_oh / 1024) AS res_oh,
 greatest(0.0, pool_exec - res_exec)::DOUBLE AS rem_exec, greatest(0.0, pool_cores - res_cores)::DOUBLE AS rem_cores,
 greatest(0.0, pool_mem - res_mem)::DOUBLE AS rem_mem FROM pool_0)"""

SHARES = """held AS (SELECT *, CASE WHEN manual_pct > 100 THEN 100 WHEN manual_pct < 0 THEN 0 ELSE manual_pct END AS by_hand FROM jobs),
shares_0 AS (SELECT * EXCLUDE (by_hand), by_hand, count(*) OVER w AS n_jobs, coalesce(sum(by_hand) OVER w, 0) AS manual_sum,
 count(*) FILTER (manual_pct IS NULL) OVER w AS auto_n FROM held WINDOW w AS (PARTITION BY cluster_id)),
shares AS (SELECT *, CASE WHEN by_hand IS NOT NULL THEN by_hand::DOUBLE
 ELSE round(greatest(0, 100 - manual_sum)::DOUBLE / auto_n) END AS pct FROM shares_0)"""


def allocs(basis: str, name: str = "allocs", min_exec: float | str | None = None,
           cores: float = 0, per_core: float = 0, min_tasks: float | str | None = None) -> str:
    """Executors per job by largest remainder, then cores, memory and overhead."""
    n = name
    share = "rem_exec * (pct / 100)" if basis == "screen" else "rem_exec * pct / 100"
    base = f"greatest(1.0, floor({share}))"
    if min_exec is not None:
        base = f"greatest({min_exec if isinstance(min_exec, str) else float(min_exec)}, {base})"
    ec = f"{float(cores)}::DOUBLE" if cores > 0 else "exec_c"
    heap = f"round({ec} * {float(per_core)}::DOUBLE)" if per_core > 0 else "exec_m"
    raised = "exec0"
    if min_tasks is not None:
        m = min_tasks if isinstance(min_tasks, str) else f"{float(min_tasks)}::DOUBLE"
        raised = f"CASE WHEN exec0 * {ec} < {m} THEN ceil({m} / {ec}) ELSE exec0 END"
    return f"""{n}_0 AS (SELECT shares.*, pool.* EXCLUDE (cluster_id), {base}::DOUBLE AS base,
 (rem_exec * pct / 100) - floor(rem_exec * pct / 100) AS frac FROM shares JOIN pool USING (cluster_id)),
{n}_1 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY frac DESC, job_idx) AS rk,
 greatest(0.0, rem_exec - sum(base) OVER (PARTITION BY cluster_id))::DOUBLE AS leftover FROM {n}_0),
{n}_2 AS (SELECT *, base + CASE WHEN rk - 1 < leftover THEN 1 ELSE 0 END AS exec0 FROM {n}_1),
{n}_3 AS (SELECT *, ({raised})::DOUBLE AS job_exec, {ec} AS job_exec_c, {heap}::DOUBLE AS job_heap FROM {n}_2),
{n}_4 AS (SELECT *, job_exec * job_exec_c AS job_cores, job_exec * job_heap AS job_mem,
 (greatest(384.0, round(job_heap * 1024 * 0.1::DOUBLE)) + CASE WHEN pyspark THEN 1024 ELSE 0 END)::DOUBLE AS job_oh FROM {n}_3),
{n} AS (SELECT *, job_heap + round(job_oh / 1024 * 10) / 10 AS job_jvm_gb, job_cores * 2 AS job_para,
 round(job_exec * job_oh / 1024 * 10) / 10 AS job_oh_gb, floor(rem_exec * (pct / 100)) AS raw_exec,
 concat('Job ', CAST(job_idx + 1 AS VARCHAR)) AS job_name FROM {n}_4)"""


ALLOCS = POOL + ",\n" + JOBS + ",\n" + SHARES + ",\n" + allocs("export")


def num(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
