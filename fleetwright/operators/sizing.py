"""Executor and driver sizing for every cluster of a fleet."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fleetwright import schema
from fleetwright.functions.columns import derive, records
from fleetwright.functions.numbers import (
    at_least, floor_d, half_up, nonzero, or_else, overhead_mb, percent, pyspark_mb,
)
from fleetwright.functions.text import quote
from fleetwright.operators.lookups import resolve_rm_reserve
from fleetwright.operators.slices import open_positions

# Spec values as the formulas accept them.
CLEAN_SPEC = {
    "nodes": at_least(1, "nodes"), "cpn": at_least(1, "cpn"), "rpn": at_least(1, "rpn"),
    "os_cr": at_least(0, "os_cr"), "min_ec": at_least(1, "min_ec"),
    "min_em": at_least(1, "min_em"), "mf": or_else("mf", "0.6D"), "sf": or_else("sf", "0.5D"),
    "master_ram": f"IF(deploy_mode = 'client', {at_least(1, 'master_ram')}, 0D)",
    "master_cores": f"IF(deploy_mode = 'client', {at_least(1, 'master_cores')}, 0D)",
}

ON_CLUSTER = "deploy_mode = 'cluster'"
ON_CLIENT = "deploy_mode = 'client'"

# The derived figures in order of dependency; the nine override fields among them can be set.
FORMULAS = {
    "total_cores": "nodes * cpn",
    "total_ram": "nodes * rpn",
    "usable_cpn": at_least(1, "cpn - os_cr"),
    "avail_ram": at_least(1, "rpn - os_r - rm_r"),
    "exec_nodes": f"IF({ON_CLUSTER}, {at_least(1, 'nodes - 1')}, nodes)",
    "reserve_ram": "nodes * (os_r + rm_r)",
    "usable_total_cores": "nodes * usable_cpn",
    "usable_total_ram": "nodes * avail_ram",
    "_cores": "CASE workload WHEN 'streaming' THEN 2D WHEN 'ml' THEN least(8D, usable_cpn) ELSE "
              f"least(5D, {floor_d('usable_cpn / ceil(usable_cpn / 5)')}) END",
    "exec_c": at_least(1, "IF(enf_c, greatest(min_ec, _cores), _cores)"),
    "exec_pn": at_least(1, floor_d(f"usable_cpn / {nonzero('exec_c')}")),
    "total_exec": "exec_nodes * exec_pn",
    "_heap": floor_d(f"avail_ram / {nonzero('exec_pn')} * 0.875D"),
    "exec_m": at_least(1, "IF(enf_m, greatest(min_em, _heap), _heap)"),
    "total_ec": "total_exec * exec_c",
    "exec_oh": f"{overhead_mb('exec_m', 'ceil')} + {pyspark_mb()}",
    "drv_m": f"IF({ON_CLUSTER}, {at_least(4, 'least(exec_m, 8D)')}, "
             f"{at_least(4, 'least(16D, ' + half_up('total_ram * 0.02D') + ')')})",
    "drv_c": f"IF({ON_CLUSTER}, 4D, 2D)",
    "para": "total_ec * IF(workload = 'ml', 3D, 2D)",
    "shuf_p": "para",
    "dyn_max": "total_exec",
    "used_cores": f"total_ec + IF({ON_CLUSTER}, drv_c, 0D)",
    "exec_ram_gb": "total_exec * (exec_m + exec_oh / 1024)",
    "drv_oh": overhead_mb("drv_m"),
    "used_ram": f"IF({ON_CLUSTER}, exec_ram_gb + (drv_m + drv_c * 0.25D) + reserve_ram,"
                " exec_ram_gb + reserve_ram)",
    "core_util": half_up("used_cores / greatest(1D, total_cores) * 100"),
    "mem_util": half_up("used_ram / greatest(1D, total_ram) * 100"),
    "unused_cores": at_least(0, "total_cores - used_cores"),
    "unused_ram": at_least(0, "total_ram - used_ram"),
    "master_ram_used": f"IF({ON_CLIENT}, drv_m + drv_oh / 1024, 0D)",
    "master_cores_used": f"IF({ON_CLIENT}, drv_c, 0D)",
    "master_ram_util": percent("master_ram_used", "master_ram"),
    "master_core_util": percent("master_cores_used", "master_cores"),
    "master_ram_free": at_least(0, "master_ram - master_ram_used"),
    "master_cores_free": at_least(0, "master_cores - master_cores_used"),
}


def size_fleet(clusters: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """All derived figures of each cluster.

    Without overrides this is one narrow stage. `overrides` has one row per cluster with
    the `set_*` columns of `apply_overrides`; a set value replaces the formula and flows
    into everything computed after it.
    """
    df = resolve_rm_reserve(schema.with_defaults(clusters))
    if overrides is not None:
        df = df.join(overrides, "cluster_id", "left")
    return size_columns(df)


def size_columns(df: DataFrame) -> DataFrame:
    """The sizing formulas over a complete spec."""
    df = derive(df.drop(*FORMULAS), CLEAN_SPEC)
    return derive(df, _formulas(df)).drop("_cores", "_heap", *SET_COLUMNS)


SET_COLUMNS = [f"set_{c}" for c in schema.OVERRIDE_FIELDS.values()]


def _formulas(df: DataFrame) -> dict[str, str]:
    """The formulas, with the values set by hand that `df` has."""
    return {name: f"coalesce(set_{name}, {expr})" if f"set_{name}" in SET_COLUMNS and f"set_{name}" in df.columns else expr
            for name, expr in FORMULAS.items()}


def _depending(fields: set[str], formulas: dict[str, str]) -> set[str]:
    """`fields` and the names whose formulas read them, directly or through others."""
    found = set(fields)
    for name, expr in formulas.items():
        if found & set(re.findall(r"\w+", expr)):
            found.add(name)
    return found


def scaling_curve(sized: DataFrame, max_n: int | None = None) -> DataFrame:
    """Executors, tasks and parallelism for 1..n nodes with per-node sizing held fixed.

    All nodes of the cluster, or at most `max_n` (a chart shows 20). Points open in blocks, so that a number
    of nodes mistyped by some zeros makes rows, not one long array.
    """
    end = "floor(nodes)" if max_n is None else f"least({max_n}, floor(nodes))"
    ends = sized.selectExpr("cluster_id", "deploy_mode", "exec_pn", "exec_c", f"CAST({end} AS BIGINT) AS _end")
    points = open_positions(ends, "1L", "_end", "n").drop("_end")
    points = derive(points, {"executors": f"IF({ON_CLUSTER}, greatest(1, n - 1), n) * exec_pn"})
    return points.selectExpr(
        "cluster_id", "n", "executors", "executors * exec_c AS tasks",
        "executors * exec_c * 2 AS parallelism",
        f"{half_up('executors * exec_c * 2 / 10')} AS parallelism_tenth")


def what_if(clusters: DataFrame, variants: list[dict]) -> DataFrame:
    """Z3: size each cluster under each candidate change of its spec.

    `variants` is a short list written by the caller; each row is exploded over it in
    place, so the fleet is neither shuffled nor joined.
    """
    df = schema.with_defaults(clusters)
    types = dict(df.dtypes)
    fields = sorted({f for v in variants for f in v})

    def literal(value):
        return "NULL" if value is None else quote(value) if isinstance(value, str) else str(value)

    options = records([
        {"variant": str(i), **{f"new_{f}": f"CAST({literal(v.get(f))} AS {types[f]})"
                               for f in fields}}
        for i, v in enumerate(variants)])
    exploded = derive(df.selectExpr("*", f"inline({options})"),
                      {f: f"coalesce(new_{f}, {f})" for f in fields})
    return size_columns(resolve_rm_reserve(exploded.drop(*[f"new_{f}" for f in fields])))


# Clusters and candidates that meet in one block of the product.
GRID_BLOCK = 4000
# Kinds of candidates told apart; in a grid of more kinds, all candidates count as one.
GRID_KINDS = 32


def what_if_grid(clusters: DataFrame, grid: DataFrame, block: int = GRID_BLOCK, most_kinds: int = GRID_KINDS) -> DataFrame:
    """Z3 for a table of candidates: every cluster under every row of `grid`, of any size.

    `grid` has a `variant` and columns of the spec to change; a null keeps the cluster's own value. Both sides are
    cut into blocks, each row is repeated for the blocks of the other side, and blocks meet by a sort-merge join, so
    that a task holds one block of candidates: no broadcast, and no list of candidates in the plan. A block holds
    candidates of one kind, those with the same texts and flags. What follows from the cluster and the kind is
    computed before rows are repeated for blocks, so that a pair compares no texts.
    """
    df = schema.with_defaults(clusters)
    types, fields = dict(df.dtypes), [c for c in grid.columns if c != "variant"]
    options = grid.selectExpr("variant", *[f"CAST({f} AS {types[f]}) AS new_{f}" for f in fields])
    fields, df = [f for f in fields if f not in FORMULAS], df.drop(*FORMULAS)
    high = max(1, -(-clusters.count() // block))
    shared, kinds = _kinds(options, [f for f in fields if types[f] in ("string", "boolean")], most_kinds)
    wide = [max(1, -(-kind["_count"] // block)) for kind in kinds]
    first = [sum(wide[:i]) for i in range(len(kinds))]
    fields = [f for f in fields if f not in shared]
    reserve = {"rm", "rm_r"} & set(fields)
    # The mode is compared once a row, not in each of the formulas that ask for it.
    formulas = {"_on_cluster": ON_CLUSTER, **{n: e.replace(ON_CLUSTER, "_on_cluster") for n, e in _formulas(df).items()}}
    changed = _depending({*fields, *(("rm", "rm_r") if reserve else ())}, CLEAN_SPEC)
    late = _depending(changed, formulas)
    # Rows are dealt out before they are repeated, as a small file is one task.
    rows = df.repartition("cluster_id").select("*", F.inline(F.array(*[
        F.struct(F.lit(a).alias("_first"), F.lit(a + n - 1).alias("_last"), *[F.lit(kind[f]).cast(types[f]).alias(f"new_{f}") for f in shared])
        for kind, a, n in zip(kinds, first, wide)])))
    rows = derive(rows, {f: f"coalesce(new_{f}, {f})" for f in shared}).drop(*[f"new_{f}" for f in shared])
    rows = rows if reserve else resolve_rm_reserve(rows)
    rows = derive(derive(rows, {n: e for n, e in CLEAN_SPEC.items() if n not in changed}),
                  {n: e for n, e in formulas.items() if n not in late})
    rows = rows.selectExpr("* EXCEPT (_first, _last)", f"CAST(pmod(xxhash64(cluster_id), {high}) AS INT) AS _high",
                           "explode(sequence(_first, _last)) AS _wide")
    dealt = F.coalesce(*[F.when(_alike(kind, shared), F.expr(f"CAST({a} + pmod(xxhash64(variant), {n}) AS INT)"))
                         for kind, a, n in zip(kinds, first, wide)])
    others = options.repartition("variant").select("variant", *[f"new_{f}" for f in fields], dealt.alias("_wide"))
    met = _blockwise(rows, others.selectExpr("*", f"explode(sequence(0, {high - 1})) AS _high"), high * sum(wide))
    met = derive(met, {f: f"coalesce(new_{f}, {f})" for f in fields}).drop(*[f"new_{f}" for f in fields])
    met = derive(resolve_rm_reserve(met) if reserve else met, {n: e for n, e in CLEAN_SPEC.items() if n in changed})
    return derive(met, {n: e for n, e in formulas.items() if n in late}).drop("_on_cluster", "_cores", "_heap", *SET_COLUMNS)


def _kinds(options: DataFrame, fields: list[str], most: int) -> tuple[list[str], list[Row]]:
    """The fields that candidates of a kind share, and the kinds with their sizes; no field and one kind if there are too many."""
    found = options.groupBy(*[F.col(f"new_{f}").alias(f) for f in fields]).agg(F.count("*").alias("_count")).limit(most + 1).collect()
    return (fields, found) if 0 < len(found) <= most else ([], options.agg(F.count("*").alias("_count")).collect())


def _alike(kind: Row, fields: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"new_{f}").eqNullSafe(F.lit(kind[f])) for f in fields], F.lit(True))


def _blockwise(rows: DataFrame, others: DataFrame, blocks: int) -> DataFrame:
    """Every row with every other row of its block, named by `_high` and `_wide`.

    The planner takes repeated rows for no more than the table they come from, so it would broadcast them, and it judges
    a task by the bytes it reads and not by the pairs it makes: the join and its number of tasks, at most 20,000, are given.
    """
    rows, others = (side.repartition(min(blocks, 20_000), "_high", "_wide") for side in (rows, others))
    return rows.join(others.hint("merge"), ["_high", "_wide"]).drop("_high", "_wide")


def driver_profile(sized: DataFrame) -> DataFrame:
    """Where the driver runs and how heavy it is there."""
    return sized.selectExpr(
        "cluster_id", "deploy_mode",
        f"CASE WHEN {ON_CLIENT} THEN CASE WHEN drv_m >= 16 THEN 'high' WHEN drv_m >= 8"
        " THEN 'moderate' ELSE 'low' END END AS footprint",
        "drv_m AS heap_gb", "drv_oh AS overhead_mb", "drv_c AS cores",
        f"IF({ON_CLUSTER}, 1D, 0D) AS reserved_nodes", "exec_nodes", "exec_pn", "total_exec")


# Fallbacks of the dynamic allocation bounds.
DYN_MIN, DYN_INIT, DYN_IDLE_SECONDS = 1.0, 4.0, 60.0
DYNAMIC = {"dyn_min": or_else("dyn_min", f"{DYN_MIN}D"), "dyn_init": or_else("dyn_init", f"{DYN_INIT}D"),
           "dyn_idle": or_else("dyn_idle", f"{DYN_IDLE_SECONDS}D")}


def dynamic_allocation_plan(sized: DataFrame) -> DataFrame:
    """Executor bounds and the shuffle setting each resource manager needs."""
    return sized.filter("dyn_alloc").selectExpr(
        "cluster_id", "rm",
        f"{DYNAMIC["dyn_min"]} AS min_executors",
        f"{or_else('dyn_max', 'total_exec')} AS max_executors",
        f"{DYNAMIC["dyn_init"]} AS initial_executors",
        f"{DYNAMIC["dyn_idle"]} AS idle_seconds",
        "IF(rm = 'yarn', 'spark.shuffle.service.enabled',"
        " 'spark.dynamicAllocation.shuffleTracking.enabled') AS shuffle_property")
