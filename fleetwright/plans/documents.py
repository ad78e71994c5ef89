"""Plan documents (S5): rows of one shape for the cluster, its reservations, jobs and additions.

A document is its rows in order of (kind, idx); each row holds one JSON entry. So a plan has
as many rows as it has parts, whatever its size, and no row collects a cluster's jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetwright.functions.columns import derive, record
from fleetwright.functions.numbers import nonzero, num_text, one_decimal, overhead_mb
from fleetwright.functions.text import quote, say

JOB_FIELDS = {
    "name": "job_name", "allocationPct": "pct", "executors": "job_exec",
    "concurrentTasks": "job_cores", "coresPerExecutor": "job_exec_c",
    "heapPerExecutorGB": "job_heap", "overheadPerExecutorMB": "job_oh",
    "totalJVMMemPerExecutorGB": "job_jvm_gb", "totalHeapGB": "job_mem",
    "totalHeapPlusOverheadGB": "job_total_gb", "defaultParallelism": "job_para",
    "shufflePartitions": "job_para",
    "memPerCoreGB": f"IF(job_exec_c > 0, {one_decimal('job_heap / ' + nonzero('job_exec_c'))}, 0D)",
}
# Documents leave the Python share out of a reservation's overhead.
RESERVATION_FIELDS = {
    "name": "res_name", "executors": "exec_count", "coresPerExecutor": "exec_cores",
    "memPerExecutorGB": "exec_mem_gb", "overheadPerExecutorMB": "_oh",
    "totalConcurrentTasks": "res_cores", "totalHeapGB": "res_mem",
}
RESERVATION_COMMAND = say(
    "spark-submit --num-executors {exec_count} --executor-cores {exec_cores} --executor-memory"
    " {exec_mem_gb}g --conf spark.executor.memoryOverhead={_oh}m")


def _spark_conf(count: str, cores: str, heap: str, overhead: str, para: str) -> str:
    pairs = {
        "spark.executor.instances": num_text(count),
        "spark.executor.cores": num_text(cores),
        "spark.executor.memory": f"concat({num_text(heap)}, 'g')",
        "spark.executor.memoryOverhead": f"concat({num_text(overhead)}, 'm')",
        "spark.default.parallelism": num_text(para),
        "spark.sql.shuffle.partitions": num_text(para),
    }
    return "map(" + ", ".join(f"{quote(key)}, {value}" for key, value in pairs.items()) + ")"


CONFIG = [
    "nodes", "cpn", "rpn", "os_r", "rm_r", "os_cr", "min_ec", "min_em", "enf_c", "enf_m", "mf", "sf", "workload",
    "rm", "sv", "storage", "deploy_mode", "aqe", "dyn_alloc", "pyspark", "avail_ram", "usable_cpn", "exec_c", "exec_pn",
    "exec_m", "exec_oh", "drv_m", "drv_c", "drv_oh", "exec_nodes", "total_exec", "total_ec", "para", "shuf_p", "dyn_max",
    "core_util", "mem_util", "used_cores", "exec_ram_gb", "reserve_ram", "used_ram", "usable_total_cores",
    "usable_total_ram", "unused_cores", "unused_ram", "master_ram", "master_cores", "master_ram_used",
    "master_cores_used", "master_ram_util", "master_core_util", "master_ram_free", "master_cores_free",
]


def _entries(df: DataFrame, kind: str, idx: str, fields: dict[str, str]) -> DataFrame:
    return df.selectExpr("cluster_id", f"'{kind}' AS kind", f"CAST({idx} AS BIGINT) AS idx",
                         f"to_json({record(fields)}) AS entry")


def cluster_documents(pool: DataFrame, generated_at: str | None = None) -> DataFrame:
    """The `cluster` rows of the plan documents."""
    stamp = "CAST(NULL AS STRING)" if generated_at is None else quote(generated_at)
    return _entries(pool, "cluster", "0", {
        "generatedAt": stamp, "clusterMode": "deploy_mode",
        "totalCluster": "struct(nodes, cpn AS coresPerNode, rpn AS ramPerNode, total_cores AS totalCores,"
                        " total_ram AS totalRAM)",
        "globalExecutorConfig": "struct(exec_c AS execCores, exec_m AS execMemGB, exec_oh AS execOverheadMB,"
                                " total_exec AS totalExecutors, total_ec AS totalConcurrentTasks)",
        "config": f"struct({', '.join(CONFIG)})"})


def plan_documents(pool: DataFrame, allocs: DataFrame, profile: DataFrame, props: DataFrame | None = None,
                   jobs: DataFrame | None = None, generated_at: str | None = None) -> DataFrame:
    """(cluster_id, kind, idx, entry) with one `cluster` row per cluster and one row per
    `reservation`, `job`, `property` and, if the plain job table is given, `input` job."""
    rows = cluster_documents(pool, generated_at)
    job_conf = _spark_conf("job_exec", "job_exec_c", "job_heap", "job_oh", "job_para")
    rows = rows.unionByName(_entries(allocs, "job", "job_idx", {**JOB_FIELDS, "sparkConf": job_conf}))
    held = derive(profile, {"_oh": overhead_mb("exec_mem_gb")})
    held_conf = _spark_conf("exec_count", "exec_cores", "exec_mem_gb", "_oh", "res_para")
    rows = rows.unionByName(_entries(held, "reservation", "res_idx", {
        **RESERVATION_FIELDS, "sparkConf": held_conf, "sparkSubmit": RESERVATION_COMMAND}))
    if props is not None:
        rows = rows.unionByName(_entries(props, "property", "pos", {"key": "key", "val": "val"}))
    if jobs is not None:
        rows = rows.unionByName(_entries(jobs, "input", "job_idx", {"id": "job_id", "manualPct": "manual_pct"}))
    return rows
