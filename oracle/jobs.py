"""SQL for reservations, job plans, reshaping and texts."""

from __future__ import annotations

from fleetwright.sources import fixtures as fx
from oracle import base as b
from oracle.core import band, fixed, lines, union

W = f"WITH {b.SIZED}\n"
R = f"WITH {b.SIZED},\n{b.RES}\n"
P = f"WITH {b.POOL}\n"
J = f"WITH {b.JOBS},\n{b.SHARES}\n"
A = f"WITH {b.ALLOCS}\n"


def planned(**options) -> str:
    return f"WITH {b.POOL},\n{b.JOBS},\n{b.SHARES},\n" + b.allocs("export", **options) + "\n"


PY_MB = "CASE WHEN pyspark THEN 1024 ELSE 0 END"
PROFILE = f""", profile AS (SELECT res.*, sized.* EXCLUDE (cluster_id), exec_count * exec_cores AS res_cores,
 exec_count * exec_mem_gb AS res_mem, round(exec_count / total_exec * 100) AS res_pct, exec_count * exec_cores * 2 AS res_para,
 greatest(384.0, round(exec_mem_gb * 1024 * 0.1::DOUBLE))::DOUBLE AS res_base_oh,
 (greatest(384.0, round(exec_mem_gb * 1024 * 0.1::DOUBLE)) + {PY_MB})::DOUBLE AS res_oh,
 coalesce(name, concat('Reserved Job ', CAST(res_idx + 1 AS VARCHAR))) AS res_name FROM res JOIN sized USING (cluster_id)),
 prof AS (SELECT *, round(exec_count * res_oh / 1024 * 10) / 10 AS res_oh_gb FROM profile)"""


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(({part}) / {whole} * 100) ELSE 0.0 END"


TOTALS = f""", used AS (SELECT cluster_id, count(*)::DOUBLE AS jobs, sum(job_exec) AS used_exec, sum(job_cores) AS job_used_cores,
 sum(job_mem) AS used_mem, sum(round(job_oh_gb * 10)) / 10 AS used_oh FROM allocs GROUP BY cluster_id),
 tot_0 AS (SELECT pool.* REPLACE (1.0 AS used_cores), coalesce(jobs, 0.0)::DOUBLE AS jobs, coalesce(used_exec, 0.0)::DOUBLE AS used_exec,
 coalesce(job_used_cores, 0.0)::DOUBLE AS job_used_cores, coalesce(used_mem, 0.0)::DOUBLE AS used_mem, coalesce(used_oh, 0.0)::DOUBLE AS used_oh
 FROM pool LEFT JOIN used USING (cluster_id)),
 tot AS (SELECT cluster_id, jobs, pool_exec, pool_cores, pool_mem, pool_oh, pool_total, res_exec, res_cores, res_mem, res_oh,
 rem_exec, rem_cores, rem_mem, used_exec, job_used_cores, used_mem, used_oh, rem_exec - used_exec AS left_exec,
 rem_cores - job_used_cores AS left_cores, rem_mem - used_mem AS left_mem, {pct('used_exec', 'rem_exec')} AS exec_used_pct,
 {pct('job_used_cores', 'rem_cores')} AS core_used_pct, {pct('used_mem', 'rem_mem')} AS mem_used_pct,
 {pct('res_cores', 'pool_cores')} AS core_reserved_pct, {pct('res_mem', 'pool_mem')} AS mem_reserved_pct,
 greatest(0.0, 100 - {pct('res_cores', 'pool_cores')} - {pct('job_used_cores', 'rem_cores')})::DOUBLE AS core_free_pct FROM tot_0)"""


def headline(item, value, of="NULL", p=None):
    judged = band("capacity", p) if p else "NULL"
    return (f"'headline' AS section, '{item}' AS item, ({value})::DOUBLE AS value, ({of})::DOUBLE AS \"of\","
            f" ({p or 'NULL'})::DOUBLE AS pct, {judged} AS band", "true")


def split(section, item, value, whole):
    return (f"'{section}', '{item}', ({value})::DOUBLE, {whole}, ({pct(value, whole)})::DOUBLE, NULL", "true")


FREE = {x: f"greatest(0.0, left_{x})" for x in ("exec", "cores", "mem")}
SUMMARY = [
    headline("executors", "used_exec", "rem_exec", "exec_used_pct"),
    headline("tasks", "job_used_cores", "rem_cores", "core_used_pct"),
    headline("heap_gb", "used_mem", "rem_mem", "mem_used_pct"),
    headline("overhead_gb", "used_oh"), headline("unallocated_tasks", FREE["cores"]),
    headline("reserved_executors", "res_exec"),
    *[split(s, i, v, w) for s, w, items in (
        ("executors", "pool_exec", ("used_exec", "res_exec", FREE["exec"])),
        ("tasks", "pool_cores", ("job_used_cores", "res_cores", FREE["cores"])),
        ("heap_gb", "pool_mem", ("used_mem", "res_mem", FREE["mem"])))
      for i, v in zip(("jobs", "reserved", "free"), items, strict=True)],
]

APPORTIONED = ("SELECT cluster_id, job_id, job_idx, pct, base AS base_exec, (exec0 - base) AS extra, exec0 AS assigned_exec"
               " FROM allocs_2")
ALLOC_OUT = ("cluster_id, job_id, job_idx, job_name, pct, job_exec, job_exec_c, job_cores, job_heap, job_mem, job_oh,"
             " job_oh_gb, job_jvm_gb, job_para, raw_exec")


def n(x: str) -> str:
    return f"({b.num(x)})"


def say(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def segment(pos, name, resource, value, whole, source, where="true"):
    return (f"SELECT cluster_id, CAST({pos} AS BIGINT) AS pos, {name} AS segment, '{resource}' AS resource, ({value})::DOUBLE AS value,"
            f" {whole} AS total, {pct(value, whole)} AS pct FROM {source} WHERE {where}")


def series(pos, name, measure, value, whole, source):
    p = pct(value, whole) if whole else "NULL"
    return (f"SELECT cluster_id, CAST({pos} AS BIGINT) AS pos, {name} AS series, '{measure}' AS measure, ({value})::DOUBLE AS value,"
            f" ({p})::DOUBLE AS pct FROM {source}")


USABLE = n("cpn - os_cr")
RULE = "CASE workload WHEN 'streaming' THEN 'fixed 2' WHEN 'ml' THEN 'up to 8' ELSE 'up to 5, even split' END"
DAEMON = "CASE rm WHEN 'standalone' THEN 'worker daemon' WHEN 'k8s' THEN 'kubelet' ELSE 'resource manager' END"
STEPS = [
    ("usable cores per node", say(n("cpn"), "' - '", n("os_cr")), USABLE),
    ("cores per executor", say("workload", "': '", RULE, "'; minimum '", n("min_ec"),
                               "CASE WHEN enf_c THEN ' enforced' ELSE ' advisory' END"), n("exec_c")),
    ("executors per node", say("'floor('", USABLE, "' / '", n("exec_c"), "')'"), n("exec_pn")),
    ("memory per node", f"CASE WHEN rm = 'local' THEN {say(n('rpn'), chr(39) + ' - ' + chr(39), n('os_r'))} ELSE "
     + say(n("rpn"), "' - '", n("os_r"), "' - '", n("rm_r"), "' '", DAEMON) + " END", say(n("avail_ram"), "' GB'")),
    ("heap per executor", say("'floor('", n("avail_ram"), "' / '", n("exec_pn"), "' * 0.875 = '",
                              fixed("avail_ram / exec_pn * 0.875::DOUBLE", 2), "')'",
                              f"CASE WHEN enf_m THEN concat(', at least ', {n('min_em')}) ELSE '' END"), say(n("exec_m"), "' GB'")),
    ("overhead per executor", say("'max(384, ceil('", n("round(exec_m * 1024 * 0.1::DOUBLE)"), "'))'",
                                  "CASE WHEN pyspark THEN ' + 1024' ELSE '' END"), say(n("exec_oh"), "' MB'")),
    ("executor nodes", f"CASE WHEN deploy_mode = 'cluster' THEN concat({n('nodes')}, ' - 1 for the driver') ELSE concat('all ', {n('nodes')}) END",
     n("exec_nodes")),
    ("executors", say(n("exec_nodes"), "' * '", n("exec_pn")), n("total_exec")),
    ("task slots", say(n("total_exec"), "' * '", n("exec_c")), n("total_ec")),
    ("default parallelism", say(n("total_ec"), "' * '", "CASE WHEN workload = 'ml' THEN '3' ELSE '2' END"), n("para")),
    ("shuffle partitions", "concat('as parallelism', CASE WHEN aqe THEN ', adaptive' ELSE '' END)", n("shuf_p")),
    ("core use", say(n("used_cores"), "' / '", n("total_cores")), say(n("core_util"), "'% '", band("standard", "core_util"))),
    ("memory use", say(n("round(used_ram)"), "' / '", n("total_ram"), "' GB'"), say(n("mem_util"), "'% '", band("standard", "mem_util"))),
    ("unused", say(n("total_cores"), "' - '", n("used_cores"), "'; '", n("total_ram"), "' - '", n("round(used_ram)")),
     say(n("unused_cores"), "' cores, '", n("round(unused_ram)"), "' GB'")),
]


def steps(rows, first: str, source: str, job: str | None = None) -> str:
    extra = f", {job} AS job_idx" if job else ""
    return union([f"SELECT cluster_id, CAST({first} + {i} AS BIGINT) AS pos, '{name}' AS step, {formula} AS formula, {result} AS result{extra} FROM {source}"
                  for i, (name, formula, result) in enumerate(rows)])


LISTED = f"CASE WHEN res_n > 0 THEN concat({n('res_n')}, ' reservations') ELSE 'none' END"
POOL_STEPS = [
    ("pool executors", say(n("exec_nodes"), "' * '", n("exec_pn")), n("pool_exec")),
    ("pool cores", say(n("pool_exec"), "' * '", n("exec_c")), n("pool_cores")),
    ("pool heap", say(n("pool_exec"), "' * '", n("exec_m"), "' GB'"), say(n("pool_mem"), "' GB'")),
    ("reserved executors", LISTED, n("res_exec")), ("reserved cores", LISTED, n("res_cores")),
    ("reserved heap", LISTED, say(n("res_mem"), "' GB'")),
    ("remaining pool", say(n("pool_exec"), "' - '", n("res_exec")),
     say(n("rem_exec"), "' executors, '", n("rem_cores"), "' cores, '", n("rem_mem"), "' GB'")),
]
WHOLE = "round((job_mem + job_exec * job_oh / 1024) * 10) / 10"
JOB_STEPS = [
    ("executors", say("'floor('", n("rem_exec"), "' * '", n("pct"), "'%) = '", n("raw_exec"),
                      "CASE WHEN job_exec > raw_exec THEN ', plus remainder' WHEN job_exec = raw_exec THEN ', no remainder' ELSE '' END"), n("job_exec")),
    ("tasks", say(n("job_exec"), "' * '", n("job_exec_c"), "' cluster setting'"), n("job_cores")),
    ("heap per executor", "'cluster setting'", say(n("job_heap"), "' GB'")),
    ("overhead per executor", say("'max(384, '", n("round(job_heap * 1024 * 0.1::DOUBLE)"), "')'", "CASE WHEN pyspark THEN ' + 1024' ELSE '' END"),
     say(n("job_oh"), "' MB'")),
    ("heap", say(n("job_exec"), "' * '", n("job_heap")), say(n("job_mem"), "' GB'")),
    ("heap and overhead", say(n("job_mem"), "' + '", n("job_oh_gb")), say(n(WHOLE), "' GB'")),
    ("parallelism", say(n("job_cores"), "' * 2'"), n("job_para")),
]

KRYO = "'org.apache.spark.serializer.KryoSerializer'"
AQE = "CAST(aqe AS VARCHAR)"


def gb(x):
    return say(n(x), "'g'")


def mb(x):
    return say(n(x), "'m'")


DRIVER = [("driver", "spark.driver.memory", gb("drv_m")), ("driver", "spark.driver.cores", n("drv_c")),
          ("driver", "spark.driver.memoryOverhead", mb("drv_oh"))]
MEMORY = [("memory", "spark.memory.fraction", n("mf")), ("memory", "spark.memory.storageFraction", n("sf"))]
ADAPTIVE = [("adaptive", f"spark.sql.adaptive.{k}enabled", AQE) for k in ("", "coalescePartitions.", "skewJoin.")]
DA = "spark.dynamicAllocation."
CLUSTER_CONF = [
    ("executor", "spark.executor.cores", n("exec_c")), ("executor", "spark.executor.memory", gb("exec_m")),
    ("executor", "spark.executor.memoryOverhead", mb("exec_oh")), ("executor", "spark.executor.instances", n("total_exec")),
    *DRIVER, ("parallelism", "spark.default.parallelism", n("para")),
    ("parallelism", "spark.sql.shuffle.partitions", n("shuf_p")), *MEMORY, *ADAPTIVE,
    ("dynamic", DA + "enabled", "CAST(dyn_alloc AS VARCHAR)"),
    ("dynamic", DA + "minExecutors", f"CASE WHEN dyn_alloc THEN {n('coalesce(nullif(dyn_min, 0.0), 1.0)')} END"),
    ("dynamic", DA + "maxExecutors", f"CASE WHEN dyn_alloc THEN {n('total_exec')} END"),
    ("dynamic", DA + "initialExecutors", f"CASE WHEN dyn_alloc THEN {n('coalesce(nullif(dyn_init, 0.0), 4.0)')} END"),
    ("dynamic", DA + "executorIdleTimeout", f"CASE WHEN dyn_alloc THEN concat({n('coalesce(nullif(dyn_idle, 0.0), 60.0)')}, 's') END"),
    ("dynamic", "spark.shuffle.service.enabled", "CASE WHEN dyn_alloc AND rm = 'yarn' THEN 'true' END"),
    ("dynamic", DA + "shuffleTracking.enabled", "CASE WHEN dyn_alloc AND rm <> 'yarn' THEN 'true' END"),
    ("network", "spark.serializer", KRYO), ("network", "spark.kryoserializer.buffer.max", "'512m'"),
    ("network", "spark.network.timeout", "'120s'"), ("network", "spark.rpc.askTimeout", "'120s'"),
]


def executor_conf(count, cores, heap, overhead):
    return [("executor", "spark.executor.instances", n(count)), ("executor", "spark.executor.cores", n(cores)),
            ("executor", "spark.executor.memory", gb(heap)), ("executor", "spark.executor.memoryOverhead", mb(overhead))]


def parallel_conf(x):
    return [("parallelism", "spark.default.parallelism", n(x)), ("parallelism", "spark.sql.shuffle.partitions", n(x))]


JOB_CONF = [*executor_conf("job_exec", "job_exec_c", "job_heap", "job_oh"), *DRIVER, *parallel_conf("job_para"), *MEMORY,
            *ADAPTIVE, ("network", "spark.serializer", KRYO), ("network", "spark.kryoserializer.buffer.max", "'512m'")]
RES_CONF = [*executor_conf("exec_count", "exec_cores", "exec_mem_gb", "res_base_oh"), *parallel_conf("res_para"),
            ("network", "spark.serializer", KRYO)]


def conf_rows(rows, owner: str, source: str) -> str:
    body = union([f"SELECT {owner}, {i} AS ord, '{s}' AS section, '{k}' AS key, {v} AS value FROM {source}"
                  for i, (s, k, v) in enumerate(rows)])
    return (f"SELECT {owner}, CAST(row_number() OVER (PARTITION BY {owner} ORDER BY ord) - 1 AS INT) AS pos, section, key, value"
            f" FROM ({body}) WHERE value IS NOT NULL")


def custom_rows(mode: str, owner: str = "") -> str:
    keep = "key <> '' AND val <> ''" if mode == "cluster" else "key <> ''"
    return f"SELECT cluster_id, {owner}CAST(pos + 100 AS INT) AS pos, 'custom' AS section, key, val AS value FROM props WHERE {keep}"


def texts(rows, owner: str, source: str, width: int, mode: str, name: str, keep: str = "") -> str:
    """Lines of one file per owner, headings at each change of section, and the additions of each cluster."""
    own = "custom" if mode == "cluster" else "job-custom"
    empty = "".join(f"NULL, " for _ in owner.split(",")[1:])
    return f""", conf AS ({conf_rows(rows, owner, source)}),
 marked AS (SELECT *, lag(section) OVER (PARTITION BY {owner} ORDER BY pos) AS prev FROM conf),
 every AS (SELECT {owner}, pos * 2 AS ord, concat('# ', section) AS line FROM marked WHERE section IS DISTINCT FROM prev
 UNION ALL SELECT {owner}, pos * 2 + 1, concat(key, repeat(' ', CAST(greatest(0, {width} - length(key)) AS BIGINT)), value) FROM marked),
 body AS (SELECT {owner}, CAST(row_number() OVER (PARTITION BY {owner} ORDER BY ord) - 1 AS INT) AS pos, line FROM every),
 own AS (SELECT DISTINCT {owner}{', ' + keep if keep else ''} FROM {source})
 SELECT {owner}, {name} AS file_name, pos, line FROM body JOIN own USING ({owner})
 UNION ALL SELECT cluster_id, {empty}concat('cluster-', cluster_id, '-{own}.conf'), pos - 100,
 concat(key, repeat(' ', CAST(greatest(0, {width} - length(key)) AS BIGINT)), value) FROM ({custom_rows(mode)})"""


def command(*parts: str) -> str:
    return "concat_ws(concat(' ', chr(92), chr(10), '  '), 'spark-submit', " + ", ".join(parts) + ")"


def slug(x: str) -> str:
    return f"lower(regexp_replace({x}, '\\s+', '-', 'g'))"


CLUSTER_COMMAND = command(
    "concat('--master ', CASE rm WHEN 'standalone' THEN 'spark://<master>:7077' WHEN 'yarn' THEN 'yarn' ELSE 'k8s://https://<k8s-api>' END)",
    "concat('--deploy-mode ', deploy_mode)", say("'--num-executors '", n("total_exec")), say("'--executor-cores '", n("exec_c")),
    say("'--executor-memory '", n("exec_m"), "'g'"), say("'--driver-memory '", n("drv_m"), "'g'"), say("'--driver-cores '", n("drv_c")),
    say("'--conf spark.executor.memoryOverhead='", n("exec_oh"), "'m'"), say("'--conf spark.default.parallelism='", n("para")),
    say("'--conf spark.sql.shuffle.partitions='", n("shuf_p")), f"concat('--conf spark.sql.adaptive.enabled=', {AQE})",
    f"concat('--conf spark.serializer=', {KRYO})", "'your-app.jar'")


def amounts(e, t, h, o=None):
    parts = [n(e), "' exec, '", n(t), "' tasks, '", n(h), "' GB heap'"]
    return say(*parts, *(["', '", n(o), "' GB overhead'"] if o else []))


ON = {x: f"CASE WHEN {x} THEN 'on' ELSE 'off' END" for x in ("aqe", "dyn_alloc", "pyspark")}
DRIVER_NOTE = "CASE WHEN deploy_mode = 'cluster' THEN 'on a worker node' ELSE 'outside the worker pool' END"
REPORT = {
    "spec": [
        ("hardware", say(n("nodes"), "' x '", n("cpn"), "' cores x '", n("rpn"), "' GB'"), "''"),
        ("total", say(n("total_cores"), "' cores, '", n("total_ram"), "' GB'"), "''"),
        ("deploy mode", "upper(deploy_mode)", "''"), ("resource manager", "upper(rm)", "''"),
        ("spark version", "sv", "''"), ("workload", "upper(workload)", "''")],
    "derivation": [
        ("usable cores per node", USABLE, say(n("cpn"), "' - '", n("os_cr"))),
        ("executor cores", n("exec_c"), say("workload", "', minimum '", n("min_ec"))),
        ("executors per node", n("exec_pn"), say("'floor('", USABLE, "' / '", n("exec_c"), "')'")),
        ("memory per node", say(n("avail_ram"), "' GB'"), say(n("rpn"), "' - '", n("os_r"), "' - '", n("rm_r"))),
        ("executor memory", say(n("exec_m"), "' GB'"), say("'floor('", n("avail_ram"), "' / '", n("exec_pn"), "' * 0.875)'")),
        ("memory overhead", say(n("exec_oh"), "' MB'"), say("'max(384, 10% of '", n("exec_m"), "' GB)'")),
        ("executor nodes", n("exec_nodes"), f"CASE WHEN deploy_mode = 'cluster' THEN concat({n('nodes')}, ' - 1') ELSE concat('all ', {n('nodes')}) END"),
        ("executors", n("total_exec"), say(n("exec_nodes"), "' * '", n("exec_pn"))),
        ("concurrent tasks", n("total_ec"), say(n("total_exec"), "' * '", n("exec_c"))),
        ("default parallelism", n("para"), say(n("total_ec"), "' * '", "CASE WHEN workload = 'ml' THEN '3' ELSE '2' END"))],
    "utilisation": [
        ("cores", say(n("used_cores"), "' / '", n("total_cores"), "' ('", n("core_util"), "'%)'"), band("report", "core_util")),
        ("memory", say(n("round(used_ram)"), "' / '", n("total_ram"), "' GB ('", n("mem_util"), "'%)'"), band("report", "mem_util")),
        ("concurrent tasks", n("total_ec"), "''"), ("parallelism", say(n("para"), "', shuffle '", n("shuf_p")), "''"),
        ("features", say("'aqe '", ON["aqe"], "', dynamic allocation '", ON["dyn_alloc"], "', pyspark '", ON["pyspark"]), "''")],
    "memory": [
        ("executor heap", say(n("pool_mem"), "' GB'"), say(n("total_exec"), "' * '", n("exec_m"))),
        ("executor overhead", say(n("pool_oh"), "' GB'"), say(n("total_exec"), "' * '", n("exec_oh"), "' MB'")),
        ("driver", f"CASE WHEN deploy_mode = 'cluster' THEN concat({n('drv_m')}, ' GB + ', {n('drv_oh')}, ' MB') ELSE 'outside the worker pool' END",
         "CASE WHEN deploy_mode = 'cluster' THEN 'one worker node' ELSE '' END"),
        ("reserves", say(n("round(reserve_ram)"), "' GB'"), say(n("nodes"), "' * ('", n("os_r"), "' + '", n("rm_r"), "')'")),
        ("unused", say(n("round(unused_ram)"), "' GB, '", n("unused_cores"), "' cores'"), "''")],
    "summary": [
        ("os reserve per node", say(n("os_r"), "' GB'"), "''"), ("rm reserve per node", say(n("rm_r"), "' GB'"), "''"),
        ("os cores per node", n("os_cr"), "''"),
        ("core use", say(n("core_util"), "'%'"), say(n("used_cores"), "' used, '", n("usable_total_cores"), "' usable'")),
        ("memory use", say(n("mem_util"), "'%'"), say(n("round(exec_ram_gb)"), "' GB in executors, '", n("round(usable_total_ram)"), "' GB usable'")),
        ("driver memory", say(n("drv_m"), "' GB'"), DRIVER_NOTE), ("driver cores", n("drv_c"), DRIVER_NOTE)],
    "plan": [
        ("pool", amounts("pool_exec", "pool_cores", "pool_mem", "pool_oh"), "'all executors'"),
        ("reserved", amounts("res_exec", "res_cores", "res_mem"), say(n("res_n"), "' reservations'")),
        ("remaining", amounts("rem_exec", "rem_cores", "rem_mem"), "'pool less reserved'")],
}
PLAIN_OH = "round(exec_count * res_base_oh / 1024 * 10) / 10"
REPORT_SQL = union(
    [f"SELECT cluster_id, '{section}' AS section, CAST({i + 1} AS BIGINT) AS pos, '{key}' AS key, {value} AS value, {note} AS note FROM pool"
     for section, rows in REPORT.items() for i, (key, value, note) in enumerate(rows)]
    + [f"SELECT cluster_id, 'reserved', res_idx + 1, res_name, {amounts('exec_count', 'res_cores', 'res_mem', PLAIN_OH)},"
       f" {say(n('exec_count'), chr(39) + ' x ' + chr(39), n('exec_cores'), chr(39) + ' cores x ' + chr(39), n('exec_mem_gb'), chr(39) + ' GB' + chr(39))} FROM prof",
       f"SELECT cluster_id, 'jobs', job_idx + 1, job_name, {amounts('job_exec', 'job_cores', 'job_mem', 'job_oh_gb')},"
       f" {say(n('pct'), chr(39) + '%: ' + chr(39), n('job_exec'), chr(39) + ' x ' + chr(39), n('job_exec_c'), chr(39) + ' cores x ' + chr(39), n('job_heap'), chr(39) + ' GB' + chr(39))} FROM allocs"])

CONFIG = """nodes cpn rpn os_r rm_r os_cr min_ec min_em enf_c enf_m mf sf workload rm sv storage deploy_mode aqe dyn_alloc pyspark avail_ram
 usable_cpn exec_c exec_pn exec_m exec_oh drv_m drv_c drv_oh exec_nodes total_exec total_ec para shuf_p dyn_max core_util mem_util used_cores exec_ram_gb
 reserve_ram used_ram usable_total_cores usable_total_ram unused_cores unused_ram master_ram master_cores master_ram_used master_cores_used
 master_ram_util master_core_util master_ram_free master_cores_free""".split()
LISTED_JOBS = b.JOBS.replace("jobs AS", "listed AS", 1) + """,
 wanted AS (SELECT cluster_id, CAST(greatest(1.0, coalesce(nullif(trunc(num_jobs), 0.0), 2.0)) AS BIGINT) AS nj FROM clusters),
 places AS (SELECT cluster_id, unnest(range(0, nj)) AS job_idx FROM wanted),
 jobs AS (SELECT cluster_id, job_idx, job_id, manual_pct FROM places LEFT JOIN listed USING (cluster_id, job_idx))"""
FLOORED = b.POOL.replace("\npool AS (", "\npool_b AS (") + """,
 fair AS (SELECT cluster_id, exec_c AS c, floor(greatest(1.0, total_exec - res_exec) / greatest(1.0, coalesce(nullif(trunc(num_jobs), 0.0), 2.0))) AS share FROM pool_b),
 floors AS (SELECT cluster_id, greatest(1.0, floor(share / 2)) AS min_exec, greatest(1.0, greatest(1.0, floor(share / 2)) * c) AS min_tasks FROM fair),
 pool AS (SELECT pool_b.*, min_exec, min_tasks FROM pool_b JOIN floors USING (cluster_id))"""
SCHED = "CASE WHEN scheduler IN ('fair', 'fifo', 'capacity') THEN scheduler ELSE 'fair' END"
SCHED_ROWS = [
    ("spark.scheduler.mode", "CASE WHEN sc = 'fifo' THEN 'FIFO' ELSE 'FAIR' END"),
    ("spark.scheduler.allocation.file", "CASE WHEN sc = 'fair' THEN 'fairscheduler.xml' END"),
    ("yarn.scheduler.capacity.root.default.capacity",
     f"CASE WHEN sc = 'capacity' THEN concat({n('greatest(10.0, round(100.0::DOUBLE / nj))::DOUBLE')}, '%') END"),
]
CLUSTER_TEXTS = texts(CLUSTER_CONF, "cluster_id", "sized", 45, "cluster", "concat('cluster-', cluster_id, '-spark-defaults.conf')")
JOB_TEXTS = texts(JOB_CONF, "cluster_id, job_idx", "allocs", 42, "job",
                  f"concat('cluster-', cluster_id, '-', {slug('job_name')}, '-spark-defaults.conf')", "job_name")
# Reservations of a cluster whose names have the same slug are told apart by a number.
SAME = f"row_number() OVER (PARTITION BY cluster_id, {slug('res_name')} ORDER BY res_idx)"
RES_TEXTS = texts(RES_CONF, "cluster_id, res_idx", f"(SELECT *, {SAME} AS same FROM prof)", 42, "job",
                  f"concat('cluster-', cluster_id, '-', {slug('res_name')}, CASE WHEN same > 1 THEN concat(' ', CAST(same AS VARCHAR)) ELSE '' END,"
                  " '-prealloc.conf')", "res_name, same")
JP = f"WITH {b.ALLOCS}{PROFILE},\n{b.PROPS}\n"
COUNTED = "(SELECT cluster_id, count(*)::DOUBLE AS jobs, sum(job_cores) AS jc, sum(job_mem) AS jm FROM allocs GROUP BY cluster_id)"
RES_OH = f"round((coalesce(mbs, 0.0) + CASE WHEN pyspark THEN res_exec * 1024 ELSE 0.0 END) / 1024 * 10) / 10"



def folded(columns: dict[str, str], fields: list[str], number: str, index: str, reset: str = "") -> str:
    """Current entries of a log of edits, as table `folded`: numbers over all adds, fields by their last edit."""
    at = "{'ts': e.ts, 'seq': e.seq}"

    def last(field):
        sets = f"e.{field} IS NOT NULL" + (" OR e.op = 'reset'" if field == reset else "")
        value = f"CASE WHEN e.op = 'reset' THEN NULL ELSE e.{field} END" if field == reset else f"e.{field}"
        return f"first({value} ORDER BY e.ts DESC, e.seq DESC) FILTER ({sets}) AS {field}"

    return f"""edits AS ({b.select(columns, 'events')}),
 adds AS (SELECT cluster_id, entry, min({{'ts': ts, 'seq': seq}}) AS added FROM edits WHERE op = 'add' GROUP BY ALL),
 born AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY added) AS {number} FROM adds),
 current AS (SELECT e.cluster_id, e.entry, any_value(a.{number}) AS {number}, {', '.join(map(last, fields))}
 FROM edits e JOIN born a ON e.cluster_id = a.cluster_id AND e.entry = a.entry AND {at} >= a.added
 GROUP BY e.cluster_id, e.entry HAVING count(*) FILTER (e.op = 'remove') = 0),
 folded AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {number}) - 1 AS {index} FROM current)"""


RES_EDITS = folded(fx.RESERVATION_EDITS, ["name", "exec_count", "exec_cores", "exec_mem_gb"], "res_no", "res_idx")
JOB_EDITS = folded(fx.JOB_EDITS, ["manual_pct"], "job_no", "job_idx", "manual_pct")

WEIGHTED = f"""WITH {b.POOL}, listed AS (SELECT o_custkey AS cluster_id, o_orderkey AS job_id, CAST({fx.REAL_WEIGHT} AS DOUBLE) AS weight,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS job_idx FROM orders),
 shared AS (SELECT listed.*, rem_exec, rem_exec * weight / 100 AS share FROM listed JOIN pool USING (cluster_id)),
 based AS (SELECT *, greatest(1.0, floor(share))::DOUBLE AS base, share - floor(share) AS frac FROM shared),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY frac DESC, job_idx) - 1 AS turn,
 greatest(0.0, rem_exec - sum(base) OVER (PARTITION BY cluster_id)) AS leftover FROM based)
 SELECT cluster_id, job_id, job_idx, weight, base AS base_exec, CASE WHEN turn < leftover THEN 1.0 ELSE 0.0 END::DOUBLE AS extra,
 base + CASE WHEN turn < leftover THEN 1 ELSE 0 END AS assigned_exec FROM ranked"""

SQL = {
    "n3_apportion_weights": WEIGHTED,
    "a2_profile_of_edits": f"""WITH {b.SIZED}, {RES_EDITS},
 res AS (SELECT cluster_id, entry, res_no, res_idx, coalesce(name, concat('Reserved Job ', CAST(res_no AS VARCHAR))) AS name, exec_count, exec_cores,
 exec_mem_gb FROM folded){PROFILE}
 SELECT cluster_id, entry, res_no, res_idx, res_name, exec_count, exec_cores, exec_mem_gb, res_cores, res_mem, res_pct, res_oh FROM prof""",
    "n2_shares_of_edits": f"""WITH {JOB_EDITS}, jobs AS (SELECT cluster_id, entry AS job_id, job_idx, manual_pct FROM folded), {b.SHARES}
 SELECT cluster_id, job_id, job_idx, manual_pct, n_jobs, pct FROM shares""",
    "a1_reservation_totals": f"""{R}, {b.RES_TOTALS} SELECT cluster_id, res_n, res_exec, res_cores, res_mem,
 {pct('res_exec', 'total_exec')} AS res_pct FROM rt JOIN sized USING (cluster_id)""",
    "a2_reservation_profile": f"""{R}{PROFILE} SELECT cluster_id, job_id, res_idx, res_name, exec_count, exec_cores, exec_mem_gb, res_cores, res_mem,
 res_pct, res_para, res_oh, res_oh_gb FROM prof""",
    "a3_remaining_pool": f"""{P} SELECT cluster_id, pool_exec, pool_cores, pool_mem, pool_oh, pool_total, res_n, res_exec, res_cores, res_mem,
 res_oh, rem_exec, rem_cores, rem_mem FROM pool""",
    "a4_plan_totals": f"{A}{TOTALS} SELECT * FROM tot",
    "a5_capacity_summary": f"{A}{TOTALS} " + lines(SUMMARY, "tot"),
    "n1_materialise_jobs": f"""WITH {b.CLUSTERS}, {b.JOBS}, w AS (SELECT cluster_id, CAST(greatest(1.0, coalesce(nullif(trunc(num_jobs), 0.0), 2.0)) AS BIGINT) AS nj FROM clusters),
 s AS (SELECT cluster_id, nj, unnest(range(0, nj)) AS job_idx FROM w)
 SELECT cluster_id, job_idx, job_id, manual_pct, job_id IS NULL AS created, CASE WHEN job_id IS NULL THEN round(100.0::DOUBLE / nj) END AS initial_pct
 FROM s LEFT JOIN jobs USING (cluster_id, job_idx)""",
    "n2_balance_shares": f"{J} SELECT cluster_id, job_id, job_idx, manual_pct, n_jobs, pct FROM shares",
    "n3_apportion_screen": f"WITH {b.POOL},\n{b.JOBS},\n{b.SHARES},\n{b.allocs('screen')} {APPORTIONED}",
    "n3_apportion_export": f"{A} {APPORTIONED}",
    "n3_apportion_floor": f"{planned(min_exec=3)} {APPORTIONED}",
    "n4_finalise_allocs": f"{A} SELECT {ALLOC_OUT} FROM allocs",
    "n4_finalise_allocs_ratio": f"{planned(cores=3, per_core=2.5, min_tasks=20)} SELECT {ALLOC_OUT} FROM allocs",
    "n5_suggest_floors": f"""{P}, s AS (SELECT cluster_id, greatest(1.0, total_exec - res_exec)::DOUBLE AS remaining,
 greatest(1.0, coalesce(nullif(trunc(num_jobs), 0.0), 2.0))::DOUBLE AS jobs, exec_c FROM pool),
 f AS (SELECT *, floor(remaining / jobs) AS fair_share FROM s), m AS (SELECT *, greatest(1.0, floor(fair_share / 2))::DOUBLE AS min_executors FROM f)
 SELECT cluster_id, remaining, jobs, fair_share, min_executors, greatest(1.0, min_executors * exec_c)::DOUBLE AS min_tasks FROM m""",
    "n5_floors_applied": f"WITH {FLOORED},\n{b.JOBS},\n{b.SHARES},\n" + b.allocs("export", min_exec="min_exec", min_tasks="min_tasks")
                         + f" SELECT {ALLOC_OUT} FROM allocs",
    "n_plan_end_to_end": f"WITH {b.POOL},\n{LISTED_JOBS},\n{b.SHARES},\n" + b.allocs("export") + f" SELECT {ALLOC_OUT} FROM allocs",
    "n6_default_reservation": f"""{W} SELECT cluster_id, greatest(1.0, round(total_exec * 0.1::DOUBLE))::DOUBLE AS exec_count, exec_c AS exec_cores,
 exec_m AS exec_mem_gb FROM sized""",
    "n7_allocation_diff": f"""WITH {b.POOL},\n{b.jobs(b.fx.WIDE_MANUAL_PCT)},\n{b.SHARES},\n{b.allocs('screen', 'a')},\n{b.allocs('export', 'e')}
 SELECT a_2.cluster_id, a_2.job_idx, a_2.job_id, a_2.pct, a_2.rem_exec, a_2.exec0 AS screen_exec, e_2.exec0 AS export_exec
 FROM a_2 JOIN e_2 ON a_2.cluster_id = e_2.cluster_id AND a_2.job_idx = e_2.job_idx WHERE a_2.exec0 <> e_2.exec0""",
    "n8_job_share": f"""{A} SELECT cluster_id, job_id, job_idx, pct, job_exec, job_cores, job_mem, {pct('job_exec', 'rem_exec')} AS exec_pct,
 {pct('job_cores', 'rem_cores')} AS core_pct, {pct('job_mem', 'rem_mem')} AS mem_pct, {WHOLE} AS total_gb FROM allocs""",
    "r2_job_plan_status": f"""{planned(min_exec=3)}{TOTALS}, s AS (SELECT *, left_exec < 0 AS se, left_cores < 0 AS sc, left_mem < 0 AS sm,
 left_exec < 0 OR left_cores < 0 OR left_mem < 0 AS over FROM tot WHERE jobs > 0),
 t AS (SELECT *, NOT over AND left_exec > rem_exec * 0.25::DOUBLE AND rem_exec > 0 AS under FROM s)
 SELECT cluster_id, CASE WHEN over THEN 'over' WHEN under THEN 'under' ELSE 'ok' END AS status,
 concat_ws(',', CASE WHEN se THEN 'J1' END, CASE WHEN sc THEN 'J2' END, CASE WHEN sm THEN 'J3' END, CASE WHEN over THEN 'J4' END,
 CASE WHEN under THEN 'J5' END, CASE WHEN NOT over AND NOT under THEN 'J6' END) AS rules,
 CASE WHEN se THEN -left_exec ELSE 0.0 END::DOUBLE AS short_exec, CASE WHEN sc THEN -left_cores ELSE 0.0 END::DOUBLE AS short_cores,
 CASE WHEN sm THEN -left_mem ELSE 0.0 END::DOUBLE AS short_mem, CASE WHEN se THEN greatest(1.0, floor(rem_exec / jobs)) END::DOUBLE AS fix_min_executors,
 over AND sc AS fix_reduce_shares, over AS fix_drop_reservation, CASE WHEN over THEN greatest(1.0, jobs - 1) END::DOUBLE AS fix_jobs,
 CASE WHEN under THEN round(left_exec / rem_exec * 100) END::DOUBLE AS unused_pct, core_used_pct FROM t""",
    "r3_job_floor_alerts": f"""{planned(min_exec=3, min_tasks=20)}, c AS (SELECT cluster_id, count(*)::DOUBLE AS jobs, count(*) FILTER (job_exec < 3) AS j7,
 count(*) FILTER (job_cores < 20) AS j8 FROM allocs GROUP BY cluster_id),
 o AS (SELECT cluster_id, rem_exec, rem_cores, jobs, j7, j8, jobs * 3 AS need_exec, jobs * 20 AS need_tasks, rem_exec < jobs * 3 AS over_exec,
 rem_cores < jobs * 20 AS over_tasks FROM pool JOIN c USING (cluster_id))
 SELECT *, concat(CASE WHEN j7 + j8 > 0 THEN 'BELOW' ELSE '' END, CASE WHEN over_exec THEN 'OE' ELSE '' END, CASE WHEN over_tasks THEN 'OC' ELSE '' END) AS alert_key,
 over_exec OR j7 + j8 > 0 AS fires, CASE WHEN over_exec THEN floor(rem_exec / jobs) END AS feasible_min,
 CASE WHEN over_exec THEN floor(rem_exec / 3) END AS feasible_jobs FROM o""",
    "x1_pool_segments": f"{A}, rest AS (SELECT * FROM pool JOIN {COUNTED} USING (cluster_id)) " + union([
        segment("0", "'reserved'", "cores", "res_cores", "pool_cores", "pool", "res_cores > 0"),
        segment("0", "'reserved'", "heap_gb", "res_mem", "pool_mem", "pool", "res_mem > 0"),
        segment("job_idx + 1", "job_name", "cores", "job_cores", "pool_cores", "allocs"),
        segment("job_idx + 1", "job_name", "heap_gb", "job_mem", "pool_mem", "allocs"),
        segment("jobs + 1", "'available'", "cores", "pool_cores - res_cores - jc", "pool_cores", "rest", "pool_cores - res_cores - jc > 0"),
        segment("jobs + 1", "'available'", "heap_gb", "pool_mem - res_mem - jm", "pool_mem", "rest", "pool_mem - res_mem - jm > 0")]),
    "x2_job_chart_series": f"""{A}, rest AS (SELECT * FROM pool JOIN {COUNTED} USING (cluster_id)),
 rp AS (SELECT * FROM pool LEFT JOIN (SELECT cluster_id, sum(exec_count * greatest(384.0, round(exec_mem_gb * 1024 * 0.1::DOUBLE))) AS mbs FROM res
 GROUP BY cluster_id) USING (cluster_id)) """ + union([
        series("0", "'reserved'", "tasks", "res_cores", "pool_cores", "rp"), series("0", "'reserved'", "heap_gb", "res_mem", "pool_mem", "rp"),
        series("0", "'reserved'", "overhead_gb", RES_OH, "pool_mem", "rp"),
        series("job_idx + 1", "job_name", "tasks", "job_cores", "pool_cores", "allocs"),
        series("job_idx + 1", "job_name", "heap_gb", "job_mem", "pool_mem", "allocs"),
        series("job_idx + 1", "job_name", "overhead_gb", "job_oh_gb", "pool_mem", "allocs"),
        series("job_idx + 1", "job_name", "executors", "job_exec", None, "allocs"),
        series("jobs + 1", "'unused'", "tasks", "greatest(0.0, rem_cores - jc)", "pool_cores", "rest"),
        series("jobs + 1", "'unused'", "heap_gb", "greatest(0.0, rem_mem - jm)", "pool_mem", "rest"),
        series("jobs + 1", "'unused'", "overhead_gb", "0.0", "pool_mem", "rest")]),
    "x3_derivation_trace": W + steps(STEPS, "1", "sized"),
    "x4_job_trace": f"{A}{PROFILE} SELECT *, CAST(NULL AS BIGINT) AS res_idx FROM (" + steps(POOL_STEPS, "1", "pool", "CAST(NULL AS BIGINT)") + "\nUNION ALL "
                    + steps(JOB_STEPS, "8 + job_idx * 7", "allocs", "job_idx") + ")\nUNION ALL " + union([
                        f"SELECT cluster_id, CAST({4 + i} AS BIGINT), '{step}', {formula}, {result}, NULL, res_idx FROM prof"
                        for i, (step, formula, result) in enumerate([
                            ("reserved executors", say("res_name", "': '", n("exec_count"), "' executors'"), n("exec_count")),
                            ("reserved cores", say("res_name", "': '", n("exec_count"), "' * '", n("exec_cores")), n("res_cores")),
                            ("reserved heap", say("res_name", "': '", n("exec_count"), "' * '", n("exec_mem_gb")), say(n("res_mem"), "' GB'"))])]),
    "t1_conf_properties": f"{W}, {b.PROPS} {conf_rows(CLUSTER_CONF, 'cluster_id', 'sized')} UNION ALL {custom_rows('cluster')}",
    "t2_job_conf_properties": f"{JP} {conf_rows(JOB_CONF, 'cluster_id, job_idx', 'allocs')} UNION ALL {custom_rows('job', 'NULL AS job_idx, ')}",
    "t3_reservation_conf_properties": f"{JP} {conf_rows(RES_CONF, 'cluster_id, res_idx', 'prof')} UNION ALL {custom_rows('job', 'NULL AS res_idx, ')}",
    "t4_render_text": f"{W}, {b.PROPS}" + CLUSTER_TEXTS,
    "s4_write_conf_texts": "SELECT file_name, pos, line FROM (" + f"{W}, {b.PROPS}" + CLUSTER_TEXTS + ")",
    "t4_render_job_text": JP + JOB_TEXTS,
    "s4_write_job_texts": "SELECT file_name, pos, line FROM (" + JP + JOB_TEXTS + ")",
    "t4_render_reservation_text": JP + RES_TEXTS,
    "s4_look_up_texts": "SELECT file_name, concat(string_agg(line, chr(10) ORDER BY pos), chr(10)) AS text,"
    " CAST(sum(strlen(line) + 1) AS BIGINT) AS length FROM (" + JP + RES_TEXTS + ") WHERE file_name LIKE '%etl%' GROUP BY file_name",
    "s4_write_reservation_texts": "SELECT file_name, pos, line FROM (" + JP + RES_TEXTS + ")",
    "t5_submit_commands": f"{W} SELECT cluster_id, {CLUSTER_COMMAND} AS command FROM sized",
    "t5_job_submit_commands": f"{A} SELECT cluster_id, job_idx, " + command(
        say("'--num-executors '", n("job_exec")), say("'--executor-cores '", n("job_exec_c")), say("'--executor-memory '", n("job_heap"), "'g'"),
        say("'--conf spark.default.parallelism='", n("job_para")), say("'--conf spark.sql.shuffle.partitions='", n("job_para")),
        f"concat('your-', {slug('job_name')}, '-app.jar')") + " AS command FROM allocs",
    "t5_reservation_submit_commands": f"{R}{PROFILE} SELECT cluster_id, res_idx, " + command(
        say("'--num-executors '", n("exec_count")), say("'--executor-cores '", n("exec_cores")), say("'--executor-memory '", n("exec_mem_gb"), "'g'"),
        f"concat('your-', {slug('res_name')}, '-app.jar')") + " AS command FROM prof",
    "t6_scheduler_properties": f"""WITH {b.CLUSTERS}, c AS (SELECT cluster_id, {SCHED} AS sc, greatest(1.0, coalesce(nullif(trunc(num_jobs), 0.0), 2.0))::DOUBLE AS nj FROM clusters),
 r AS ({union([f"SELECT cluster_id, {i} AS pos, '{k}' AS key, NULL::BIGINT AS part, {v} AS value FROM c" for i, (k, v) in zip((0, 1, 2), SCHED_ROWS, strict=True)])}
 UNION ALL SELECT cluster_id, 1, 'yarn.scheduler.capacity.root.queues', part, CASE WHEN part = 0 THEN 'default' ELSE concat('q', part) END
 FROM (SELECT cluster_id, unnest(range(0, CAST(nj AS BIGINT) + 1)) AS part FROM c WHERE sc = 'capacity'))
 SELECT cluster_id, CAST(pos AS INT) AS pos, key, part, value FROM r WHERE value IS NOT NULL""",
    "s5_plan_documents": f"""{JP} SELECT cluster_id, 'job' AS kind, CAST(job_idx AS BIGINT) AS idx, job_name AS name, job_exec AS executors, pct AS share,
 job_cores AS tasks, job_exec_c AS cores, job_heap AS heap, {WHOLE} AS total_gb, round(job_heap / job_exec_c * 10) / 10 AS per_core, NULL::VARCHAR AS text,
 {gb('job_heap')} AS memory, {mb('job_oh')} AS overhead, {n('job_para')} AS parallelism FROM allocs
 UNION ALL SELECT cluster_id, 'reservation', res_idx, res_name, exec_count, NULL, res_cores, exec_cores, exec_mem_gb, res_mem, NULL,
 concat('spark-submit --num-executors ', {n('exec_count')}, ' --executor-cores ', {n('exec_cores')}, ' --executor-memory ',
 {n('exec_mem_gb')}, 'g --conf spark.executor.memoryOverhead=', {n('res_base_oh')}, 'm'), {gb('exec_mem_gb')}, {mb('res_base_oh')}, {n('res_para')} FROM prof
 UNION ALL SELECT cluster_id, 'property', pos, key, NULL, NULL, NULL, NULL, NULL, NULL, NULL, val, NULL, NULL, NULL FROM props
 UNION ALL SELECT cluster_id, 'input', job_idx, CAST(job_id AS VARCHAR), NULL, manual_pct::DOUBLE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM jobs""",
    "s5_plan_configs": f"{W} SELECT cluster_id, deploy_mode AS mode, total_cores AS cores, total_ram AS ram, exec_m AS heap, total_exec AS executors, "
                       + ", ".join(CONFIG) + " FROM sized",
    "s6_report_tables": f"{A}{PROFILE} {REPORT_SQL}",
    "s6_report_reservations": f"""{R}{PROFILE} SELECT cluster_id, res_idx, res_name, exec_count, exec_cores, exec_mem_gb, res_oh, res_cores, res_mem,
 round((res_mem + res_oh_gb) * 10) / 10 AS total_gb FROM prof""",
    "s6_report_jobs": f"""{A} SELECT cluster_id, job_idx, job_name, pct, job_exec, job_cores, job_exec_c, job_heap, job_oh, (job_oh - {PY_MB})::DOUBLE AS base_oh,
 job_mem, round((job_mem + job_oh_gb) * 10) / 10 AS total_gb, job_para FROM allocs""",
}
