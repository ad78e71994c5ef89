"""Reserved jobs and the pool that remains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.columns import derive
from fleetwright.functions.numbers import (
    at_least, floor_d, half_up, job_count, one_decimal, or_else, overhead_mb, percent, pyspark_mb,
)
from fleetwright.functions.text import reservation_name
from fleetwright.operators.slices import SLICE_BITS, slice_of, spread


def reservation_sums(res: DataFrame) -> DataFrame:
    return res.groupBy("cluster_id").agg(*[F.expr(e) for e in (
        "CAST(count(1) AS DOUBLE) AS res_n", "sum(exec_count) AS res_exec",
        "sum(exec_count * exec_cores) AS res_cores", "sum(exec_count * exec_mem_gb) AS res_mem",
        f"sum(exec_count * {overhead_mb('exec_mem_gb')}) AS res_oh_mb")])


def reservation_totals(res: DataFrame, sized: DataFrame) -> DataFrame:
    """A1: reserved executors, cores and heap per cluster and their share of the executors."""
    return reservation_sums(res).join(sized.select("cluster_id", "total_exec"), "cluster_id") \
        .selectExpr("cluster_id", "res_n", "res_exec", "res_cores", "res_mem",
                    f"{percent('res_exec', 'total_exec')} AS res_pct")


def reservation_profile(res: DataFrame, sized: DataFrame, pyspark_overhead: bool = True,
                        bits: int = SLICE_BITS) -> DataFrame:
    """A2: figures of each reservation; `res` carries `res_idx`, its position in the cluster.

    The join meets on (cluster, block of positions), so a cluster with very many
    reservations is spread over many tasks.
    """
    # Blocks follow the highest position, as removals leave gaps.
    counts = res.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("res_n"), (F.max("res_idx") + 1).alias("_top"))
    owners = spread(counts.join(sized, "cluster_id"), "_top", bits).drop("_top")
    rows = derive(res, {"slice": slice_of("res_idx", bits)})
    overhead = overhead_mb("exec_mem_gb")
    # Left to the planner, the reservations of a middling fleet are broadcast to the few tasks that hold the owners.
    joined = rows.join(owners.hint("merge"), ["cluster_id", "slice"]).drop("slice")
    return derive(joined, {
        "res_name": reservation_name(res.columns),
        "res_cores": "exec_count * exec_cores",
        "res_mem": "exec_count * exec_mem_gb",
        "res_pct": half_up(f"exec_count / {or_else('total_exec', '1D')} * 100"),
        "res_para": "exec_count * exec_cores * 2",
        "res_oh": f"{overhead} + {pyspark_mb()}" if pyspark_overhead else overhead,
        "res_oh_gb": one_decimal("exec_count * res_oh / 1024"),
    })


def remaining_pool(sized: DataFrame, res: DataFrame) -> DataFrame:
    """A3: executor pool of each cluster, less reservations, floored at zero.

    Overhead is kept apart from heap. All sized columns are carried along.
    """
    joined = sized.join(reservation_sums(res), "cluster_id", "left")
    joined = derive(joined, {name: f"coalesce({name}, 0D)" for name in (
        "res_n", "res_exec", "res_cores", "res_mem", "res_oh_mb")})
    return derive(joined, {
        "pool_exec": "total_exec",
        "pool_cores": "total_ec",
        "pool_mem": half_up("total_exec * exec_m"),
        "pool_oh": half_up("total_exec * exec_oh / 1024"),
        "pool_total": "pool_mem + pool_oh",
        "res_oh": half_up("res_exec * exec_oh / 1024"),
        "rem_exec": at_least(0, "pool_exec - res_exec"),
        "rem_cores": at_least(0, "pool_cores - res_cores"),
        "rem_mem": at_least(0, "pool_mem - res_mem"),
    })


def suggest_floors(pool: DataFrame, num_jobs: str = "num_jobs", job_exec_c: float = 0) -> DataFrame:
    """Minimum executors and tasks per job, half of a fair share."""
    cores = f"{float(job_exec_c)}D" if job_exec_c > 0 else or_else("exec_c", "4D")
    return pool.selectExpr(
        "cluster_id", f"{at_least(1, 'total_exec - res_exec')} AS remaining",
        f"{job_count(num_jobs)} AS jobs", f"{floor_d('remaining / jobs')} AS fair_share",
        f"{at_least(1, floor_d('fair_share / 2'))} AS min_executors",
        f"{at_least(1, f'min_executors * {cores}')} AS min_tasks")


def default_reservation(sized: DataFrame) -> DataFrame:
    """Size of a newly added reservation: a tenth of the executors, global cores and heap."""
    tenth = half_up(f"{or_else('total_exec', '10D')} * 0.1D")
    return sized.selectExpr(
        "cluster_id", f"{at_least(1, tenth)} AS exec_count",
        f"{or_else('exec_c', '4D')} AS exec_cores", f"{or_else('exec_m', '8D')} AS exec_mem_gb")
