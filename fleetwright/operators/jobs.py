"""Sharing a cluster's remaining executors between its jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.columns import aggregate, derive
from fleetwright.functions.numbers import (
    at_least, ceil_d, floor_d, half_up, job_count, nonzero, one_decimal, overhead_mb, percent, pyspark_mb,
)
from fleetwright.functions.text import job_name
from fleetwright.operators.slices import OPEN_BITS, SLICE_BITS, open_positions, slice_of

# A share set by hand, held to 0..100, and the key of jobs that split what these leave.
MANUAL = "least(100, greatest(0, manual_pct))"
AUTO = -1
SHARE = f"IF(manual_pct IS NULL, {AUTO}, {MANUAL})"


@dataclass(frozen=True)
class JobOptions:
    """Fleet-wide job settings; zero means "not set", as in the reference form.

    A cluster's own columns `job_ec`, `gb_per_core`, `enf_je`, `min_je`, `enf_jc` and `min_jc` come first.
    """

    cores_per_executor: float = 0.0
    gb_per_core: float = 0.0
    enforce_executors: bool = False
    min_executors: float = 1.0
    enforce_tasks: bool = False
    min_tasks: float = 1.0


def with_settings(pool: DataFrame, options: JobOptions = JobOptions()) -> DataFrame:
    """Adds the settings in force for each cluster's jobs: its own where it has them, else the fleet's."""
    def own(name, fallback):
        kind = "BOOLEAN" if isinstance(fallback, bool) else "DOUBLE"
        literal = str(fallback).lower() if isinstance(fallback, bool) else f"{float(fallback)}D"
        return f"coalesce(CAST({name} AS {kind}), {literal})" if name in pool.columns else literal

    return derive(pool.drop("_ec", "_gb", "_enf_je", "_min_je", "_enf_jc", "_min_jc"), {
        "_ec": own("job_ec", options.cores_per_executor),
        "_gb": own("gb_per_core", options.gb_per_core),
        "_enf_je": own("enf_je", options.enforce_executors),
        "_min_je": at_least(1, own("min_je", options.min_executors)),
        "_enf_jc": own("enf_jc", options.enforce_tasks),
        "_min_jc": at_least(1, own("min_jc", options.min_tasks)),
    })


CORES = "IF(_ec > 0, _ec, exec_c)"


def materialise_jobs(clusters: DataFrame, jobs: DataFrame, bits: int = OPEN_BITS) -> DataFrame:
    """Exactly `num_jobs` jobs per cluster; missing ones are created, extra ones dropped.

    The blocks of positions are spread before they are opened, so one cluster with very
    many jobs is not generated by one task.
    """
    wanted = clusters.selectExpr("cluster_id", f"CAST({job_count()} AS BIGINT) AS n_jobs")
    slots = open_positions(wanted, "0L", "n_jobs", "job_idx", bits, ["cluster_id"])
    present = jobs.selectExpr("cluster_id", "job_id", "job_idx", "manual_pct", "true AS _present")
    return slots.join(present, ["cluster_id", "job_idx"], "left").selectExpr(
        "cluster_id", "job_idx", "job_id", "manual_pct", "_present IS NULL AS created",
        f"IF(_present IS NULL, {half_up('100D / n_jobs')}, NULL) AS initial_pct")


def _cut(jobs: DataFrame, bits: int) -> DataFrame:
    return derive(jobs, {"slice": slice_of("job_idx", bits)})


def _pieces(cut: DataFrame) -> DataFrame:
    """Job counts per (cluster, block of positions, share), with the resulting percentages.

    Shares are whole percents, so a block has at most 102 pieces and every window over a
    cluster below works on pieces, never on jobs.
    """
    pieces = cut.selectExpr("cluster_id", "slice", f"{SHARE} AS share") \
        .groupBy("cluster_id", "slice", "share").count().withColumnRenamed("count", "n")
    over = "OVER (PARTITION BY cluster_id)"
    totals = pieces.selectExpr(
        "*", f"sum(n) {over} AS n_jobs",
        f"sum(IF(share = {AUTO}, 0, n * share)) {over} AS _manual",
        f"sum(IF(share = {AUTO}, n, 0)) {over} AS _autos")
    even = half_up("CAST(greatest(0, 100 - _manual) AS DOUBLE) / nullif(_autos, 0)")
    return derive(totals, {
        "auto_pct": f"IF(_autos > 0, {even}, 0D)",
        "pct": f"IF(share = {AUTO}, auto_pct, CAST(share AS DOUBLE))",
    }).drop("_manual", "_autos")


PCT = f"IF(manual_pct IS NULL, auto_pct, CAST({MANUAL} AS DOUBLE))"


def balance_shares(jobs: DataFrame, bits: int = SLICE_BITS) -> DataFrame:
    """Percent of the pool per job; automatic jobs split what manual ones leave.

    Manual shares are held to 0..100, and the rounded shares need not add up to 100.
    """
    cut = _cut(jobs, bits)
    totals = _pieces(cut).groupBy("cluster_id", "slice").agg(
        F.max("auto_pct").alias("auto_pct"), F.max("n_jobs").alias("n_jobs"))
    return cut.join(totals, ["cluster_id", "slice"]).selectExpr(
        "cluster_id", "job_id", "job_idx", "manual_pct", "n_jobs", f"{PCT} AS pct")


def _base(basis: str) -> str:
    # The screen multiplies by pct/100, the export multiplies first: doubles can differ.
    share = "rem_exec * (pct / 100)" if basis == "screen" else "rem_exec * pct / 100"
    return f"greatest(IF(_enf_je, _min_je, 1D), {floor_d(share)})"


FRACTION = "rem_exec * pct / 100 - floor(rem_exec * pct / 100)"


def _apportion(jobs: DataFrame, pool: DataFrame, bases: dict[str, str], bits: int, carry: list[str] | None) -> DataFrame:
    """Largest-remainder split under one or more base formulas in a single pass.

    The order of the leftovers is resolved on pieces (see `_pieces`): `ahead` is the number
    of jobs of the cluster that come before a piece's fraction within its block, and a job
    adds its rank inside the block. Jobs move once, by (cluster, block), with what the
    ranking needs and no more; no task sees more than one block. The pool's other columns
    join afterwards on the same keys.
    """
    cut = _cut(jobs, bits)
    settings = ["rem_exec", "_enf_je", "_min_je"]
    pieces = derive(_pieces(cut).join(pool.select("cluster_id", *settings), "cluster_id"),
                    {"frac": FRACTION, **{f"_base_{b}": expr for b, expr in bases.items()}})
    pieces = pieces.selectExpr(
        "*", "sum(n) OVER (PARTITION BY cluster_id ORDER BY frac DESC, slice)"
        " - sum(n) OVER (PARTITION BY cluster_id, frac, slice) AS ahead",
        *[f"greatest(0D, rem_exec - sum(n * _base_{b}) OVER (PARTITION BY cluster_id)) AS _left_{b}"
          for b in bases])
    once = [*settings, "auto_pct", "n_jobs", *[f"_left_{b}" for b in bases]]
    blocks = aggregate(pieces, ["cluster_id", "slice"], {
        "_ahead": "map_from_entries(collect_list(struct(share, ahead)))",
        **{name: f"any_value({name})" for name in once}})

    # The rank needs jobs partitioned by (cluster, block) anyway, so the join shuffles them
    # that way once; a broadcast of either side would only put the shuffle off.
    joined = derive(cut.join(blocks.hint("merge"), ["cluster_id", "slice"]),
                    {"pct": PCT, "frac": FRACTION})
    ranked = joined.selectExpr(
        "*", "row_number() OVER (PARTITION BY cluster_id, slice, frac ORDER BY job_idx) - 1"
        f" + _ahead[{SHARE}] AS _turn",
        *[f"{expr} AS base_{b}" for b, expr in bases.items()])
    split = ranked.selectExpr(
        "* EXCEPT (frac, auto_pct, _ahead, _turn, _enf_je, _min_je" + "".join(f", _left_{b}" for b in bases) + ")",
        *[f"IF(_turn < _left_{b}, 1D, 0D) AS extra_{b}" for b in bases])
    # One pool row for each block of its jobs, so this join meets no key above a block either.
    more = [c for c in pool.columns if c not in ("cluster_id", "rem_exec")] if carry is None else carry
    if not more:
        return split.drop("slice")
    wide = blocks.select("cluster_id", "slice").join(pool.select("cluster_id", *more), "cluster_id")
    return split.join(wide.hint("merge"), ["cluster_id", "slice"]).drop("slice")


def apportion(jobs: DataFrame, pool: DataFrame, basis: str = "export", options: JobOptions = JobOptions(),
              bits: int = SLICE_BITS, carry: list[str] | None = None) -> DataFrame:
    """Split each cluster's remaining executors by largest remainder.

    Every job gets its floored share, at least one. Executors left over go one each to
    jobs by descending fraction, ties by position; a job gets at most one extra, so a
    surplus may stay unassigned and floors may exceed the pool. `carry` names the columns of the pool
    that jobs get beside `rem_exec`, all by default.
    """
    if basis not in ("screen", "export"):
        raise ValueError("basis is 'screen' or 'export'")
    split = _apportion(jobs, with_settings(pool, options), {"exec": _base(basis)}, bits, carry)
    return split.selectExpr("* EXCEPT (extra_exec)", "extra_exec AS extra",
                            "base_exec + extra_exec AS assigned_exec")


def finalise_allocs(apportioned: DataFrame, options: JobOptions = JobOptions()) -> DataFrame:
    """Cores, heap, overhead and parallelism of each job's executors.

    Executors without cores cannot reach a minimum of tasks and keep their number.
    """
    settled = apportioned if "_ec" in apportioned.columns else with_settings(apportioned, options)
    raised = ceil_d(f"_min_jc / {nonzero(CORES)}")
    return derive(settled, {
        "job_name": job_name(),
        "job_exec": f"IF(_enf_jc AND assigned_exec * {CORES} < _min_jc, coalesce({raised}, assigned_exec), assigned_exec)",
        "job_exec_c": CORES,
        "job_heap": f"IF(_gb > 0, {half_up(f'{CORES} * _gb')}, exec_m)",
        "raw_exec": floor_d("rem_exec * (pct / 100)"),
        "job_cores": "job_exec * job_exec_c",
        "job_mem": "job_exec * job_heap",
        "job_oh": f"{overhead_mb('job_heap')} + {pyspark_mb()}",
        "job_jvm_gb": f"job_heap + {one_decimal('job_oh / 1024')}",
        "job_oh_gb": one_decimal("job_exec * job_oh / 1024"),
        "job_total_gb": one_decimal("job_mem + job_exec * job_oh / 1024"),
        "job_para": "job_cores * 2",
    })


# What the final allocation of a job reads of its pool.
SETTINGS = ["exec_c", "exec_m", "pyspark", "_ec", "_gb", "_enf_je", "_min_je", "_enf_jc", "_min_jc"]


def allocate(jobs: DataFrame, pool: DataFrame, basis: str = "export", options: JobOptions = JobOptions(),
             bits: int = SLICE_BITS, carry: list[str] | None = None) -> DataFrame:
    """N2-N4 in one go: jobs with their final allocation and the pool's columns, or those in `carry`."""
    needed = None if carry is None else [*SETTINGS, *(c for c in carry if c not in (*SETTINGS, "rem_exec"))]
    return finalise_allocs(apportion(jobs, pool, basis, options, bits, needed), options)


def allocation_diff(jobs: DataFrame, pool: DataFrame, options: JobOptions = JobOptions(),
                    bits: int = SLICE_BITS) -> DataFrame:
    """Jobs whose executors differ between the screen and the export basis."""
    bases = {basis: _base(basis) for basis in ("screen", "export")}
    return _apportion(jobs, with_settings(pool, options), bases, bits, []).selectExpr(
        "cluster_id", "job_idx", "job_id", "pct", "rem_exec",
        "base_screen + extra_screen AS screen_exec", "base_export + extra_export AS export_exec",
    ).filter("screen_exec <> export_exec")


def job_share(allocs: DataFrame) -> DataFrame:
    """Each job's percent of the remaining executors, cores and heap."""
    return allocs.selectExpr(
        "cluster_id", "job_id", "job_idx", "pct", "job_exec", "job_cores", "job_mem",
        f"{percent('job_exec', 'rem_exec')} AS exec_pct",
        f"{percent('job_cores', 'rem_cores')} AS core_pct",
        f"{percent('job_mem', 'rem_mem')} AS mem_pct", "job_total_gb AS total_gb")
