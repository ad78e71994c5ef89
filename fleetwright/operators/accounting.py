"""Utilisation, ledgers and fleet totals over sized clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.functions.bands import POLICIES, band
from fleetwright.functions.columns import derive, open_rows, records
from fleetwright.functions.numbers import (
    at_least, fixed_text, half_up, nonzero, one_decimal, overhead_mb, percent,
)
from fleetwright.operators.rules import Rule, fired
from fleetwright.operators.sizing import ON_CLIENT, ON_CLUSTER

STATUS = band("fleet", "core_util", "mem_util")


def utilisation(sized: DataFrame) -> DataFrame:
    """Cores and memory in use against all installed capacity, with the overall status."""
    return sized.selectExpr(
        "cluster_id", "used_cores", "total_cores", "core_util", "unused_cores",
        "used_ram", "total_ram", "mem_util", "unused_ram",
        "usable_total_cores", "usable_total_ram",
        f"{band('standard', 'core_util')} AS core_band",
        f"{band('standard', 'mem_util')} AS mem_band", f"{STATUS} AS status")


def classify(df: DataFrame, policy: str, metrics: list[str], out: str = "band") -> DataFrame:
    """Band of one or more percentage columns under a named policy."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; one of {sorted(POLICIES)}")
    return derive(df, {out: band(policy, *metrics)})


def classify_all(sized: DataFrame) -> DataFrame:
    """Every cluster under every policy that applies to it, one row per policy and metric."""
    def entry(policy, metric, *columns):
        percent = f"greatest({', '.join(columns)})" if len(columns) > 1 else columns[0]
        return {"policy": f"'{policy}'", "metric": f"'{metric}'", "percent": percent,
                "band": band(policy, *columns)}

    every = [entry("fleet", "worst", "core_util", "mem_util")]
    for policy in ("standard", "report", "capacity"):
        every += [entry(policy, "core", "core_util"), entry(policy, "mem", "mem_util")]
    client = [entry("master", "core", "master_core_util"),
              entry("master", "mem", "master_ram_util")]
    rows = f"IF({ON_CLIENT}, concat({records(every)}, {records(client)}), {records(every)})"
    return sized.selectExpr("cluster_id", f"inline({rows})")


# A policy's range of bounds is cut into so many cells.
CELLS = 1024


def classify_by(values: DataFrame, policies: DataFrame, value: str = "percent", cells: int = CELLS) -> DataFrame:
    """U2 with policies as rows: adds `band` to rows of (policy, value), any number of policies and of bands.

    `policies` has (policy, low, above, band): a band holds from `low` on, or above it, up to the next one of its
    policy; a null `low` is the lowest. Values meet bands by cells of the policy's range, an equi-join in which a
    value meets the bands of its own cell only. Values below all bands, null values and unknown policies get no
    band.
    """
    in_policy = Window.partitionBy("policy").orderBy(F.col("low").asc_nulls_first(), "above")
    whole = Window.partitionBy("policy")
    bands = policies.select("policy", F.col("low").cast("double").alias("low"), "above", "band").withColumns({
        "next_low": F.lead("low").over(in_policy), "next_above": F.lead("above").over(in_policy),
        "least": F.coalesce(F.min("low").over(whole), F.lit(0.0)), "most": F.coalesce(F.max("low").over(whole), F.lit(0.0))})
    bands = derive(bands, {"width": f"IF(most > least, (most - least) / {cells}, 1D)"})

    def cell(x):
        return f"IF(isnan({x}), {cells + 1}L, greatest(-1L, least({cells + 1}L, CAST(floor(({x} - least) / width) AS BIGINT))))"

    # Rounding may put a value beside a bound into the cell next to the bound's: bands reach one cell further.
    first = f"IF(low IS NULL, -1L, greatest(-1L, {cell('low')} - 1))"
    last = f"IF(next_low IS NULL, {cells + 1}L, least({cells + 1}L, {cell('next_low')} + 1))"
    opened = bands.selectExpr("policy AS _policy", "low", "above", "next_low", "next_above", "band",
                              f"explode(sequence({first}, greatest({first}, {last}))) AS _cell")
    ranges = bands.select(F.col("policy").alias("_of"), "least", "width").distinct()
    keyed = values.withColumn("_row", F.struct("*")).select("_row", "policy", F.col(value).cast("double").alias("_value"))
    placed = derive(keyed.join(ranges, F.col("policy") == F.col("_of"), "left"), {"_at": cell("_value")})
    holds = ("(low IS NULL OR _value > low OR (_value = low AND NOT above))"
             " AND (next_low IS NULL OR _value < next_low OR (_value = next_low AND next_above))")
    found = placed.join(opened, (F.col("policy") == F.col("_policy")) & (F.col("_at") == F.col("_cell")) & F.expr(holds), "left")
    return found.select("_row.*", "band")


# GB of each part of the fleet's memory, rounded as the reference plots them.
LEDGER = {
    "executor_heap": half_up("total_exec * exec_m"),
    "overhead": half_up("total_exec * exec_oh / 1024"),
    "driver": f"IF({ON_CLUSTER}, drv_m, 0D)",
    "reserves": half_up("reserve_ram"),
    "unused": at_least(0, half_up("unused_ram")),
}


def memory_ledger(sized: DataFrame) -> DataFrame:
    """Where the memory of each cluster goes."""
    amounts = derive(sized, {f"_{name}": expr for name, expr in LEDGER.items()})
    return open_rows(amounts, ["cluster_id"], records([
        {"segment": f"'{name}'", "gb": f"_{name}", "pct": half_up(f"_{name} / total_ram * 100")}
        for name in LEDGER]))


def core_ledger(sized: DataFrame) -> DataFrame:
    """U4: where the cores of each cluster go."""
    parts = {"executor_cores": "total_ec", "driver": f"IF({ON_CLUSTER}, drv_c, 0D)",
             "os_reserve": "nodes * os_cr", "unused": "unused_cores"}
    return open_rows(sized, ["cluster_id"], records([
        {"segment": f"'{name}'", "cores": expr, "pct": half_up(f"{expr} / total_cores * 100")}
        for name, expr in parts.items()]))


def capacity_bars(sized: DataFrame) -> DataFrame:
    """Five used / total / available lines; the shown percentage stops at 100.

    The driver figure here is heap plus overhead, unlike the one inside used memory.
    """
    df = derive(sized, {"_heap": LEDGER["executor_heap"], "_over": LEDGER["overhead"],
                        "_res": LEDGER["reserves"], "_used": half_up("used_ram")})
    driver = f"IF({ON_CLUSTER}, {one_decimal('drv_m + drv_oh / 1024')}, 0D)"
    lines = [
        ("cores", "used_cores", "total_cores", "cores", "unused_cores", "0D"),
        ("memory", "_used", "total_ram", "GB", half_up("unused_ram"), driver),
        ("executor_heap", "_heap", "total_ram", "GB", half_up("total_ram - _heap"), "0D"),
        ("executor_overhead", "_over", "total_ram", "GB", half_up("total_ram - _over"), "0D"),
        ("reserves", "_res", "total_ram", "GB", half_up("total_ram - reserve_ram"), "0D"),
    ]
    rows = open_rows(df, ["cluster_id"], records([
        {"line": f"'{name}'", "used": used, "total": total, "unit": f"'{unit}'",
         "pct": f"least(100D, {half_up(f'{used} / {total} * 100')})", "available": available,
         "driver_gb": driver_gb}
        for name, used, total, unit, available, driver_gb in lines]))
    return derive(rows, {"tag": "CASE WHEN pct > 95 THEN 'critical' WHEN pct > 80 THEN 'warning'"
                                " ELSE 'normal' END"})


def usage_summary(sized: DataFrame) -> DataFrame:
    """Used and available amounts with whole percentages, as the stacked overview shows them."""
    df = derive(sized, {"_used": half_up("used_ram"), "_free": half_up("unused_ram")})
    lines = [("cores", "used_cores", "unused_cores", "total_cores"),
             ("memory_gb", "_used", "_free", "total_ram")]
    return open_rows(df, ["cluster_id"], records([
        {"resource": f"'{name}'", "used": used, "available": free,
         "used_pct": percent(used, total), "available_pct": percent(free, total)}
        for name, used, free, total in lines]))


def executor_memory_breakdown(sized: DataFrame) -> DataFrame:
    """Parts of one executor's memory; the rounded parts need not add up."""
    parts = {
        "execution": half_up("exec_m * mf * (1 - sf)"), "storage": half_up("exec_m * mf * sf"),
        "user": half_up("exec_m * (1 - mf)"),
        "jvm_overhead": f"{half_up(overhead_mb('exec_m') + ' / 1024 * 100')} / 100",
        "pyspark_overhead": "1D",
    }
    df = derive(sized, {
        "jvm_total_gb": f"exec_m + {one_decimal('exec_oh / 1024')}",
        "gb_per_core": f"IF(exec_c > 0, {fixed_text('exec_m / ' + nonzero('exec_c'), 1)}, NULL)",
        "managed_gb": half_up("exec_m * mf"),
        **{f"_{name}": expr for name, expr in parts.items()},
    })
    rows = records([
        {"part": f"'{name}'", "gb": f"_{name}", "pct": percent(f"_{name}", "jvm_total_gb")}
        for name in parts])
    shown = f"IF(pyspark, {rows}, slice({rows}, 1, {len(parts) - 1}))"
    return open_rows(df, ["cluster_id", "jvm_total_gb", "gb_per_core", "managed_gb"], shown)


MASTER_REMARKS = [
    Rule("M1", "error", "master_ram_util > 90", "master_ram_util", "90"),
    Rule("M2", "warning", "master_ram_util > 70 AND master_ram_util <= 90", "master_ram_util", "70"),
    Rule("M3", "error", "master_core_util > 90", "master_core_util", "90"),
    Rule("M4", "error", "master_ram_used > master_ram * 0.85D", "master_ram_used",
         "master_ram * 0.85D"),
    Rule("M5", "ok", "master_ram_util <= 70 AND master_core_util <= 70", "master_ram_util", "70"),
    Rule("M6", "tip", "master_ram < 8", "master_ram", "8"),
    Rule("M7", "tip", "master_cores < 4", "master_cores", "4"),
    Rule("M8", "tip", "drv_m > master_ram * 0.5D", "drv_m", "master_ram * 0.5D"),
]


def master_utilisation(sized: DataFrame) -> DataFrame:
    """Load of the submitting host in client mode, one row per remark on it."""
    return sized.filter(ON_CLIENT).selectExpr(
        "cluster_id", "master_ram", "master_ram_used", "master_ram_free", "master_ram_util",
        "master_cores", "master_cores_used", "master_cores_free", "master_core_util",
        f"posexplode_outer({fired(MASTER_REMARKS)}) AS (pos, _r)",
    ).selectExpr("* EXCEPT (_r)", "_r.rule", "_r.severity", "_r.observed", "_r.threshold")


def fleet_rollup(sized: DataFrame,
                 dims: tuple[str, ...] = ("workload", "rm", "deploy_mode")) -> DataFrame:
    """U8: headline figures over the fleet and every prefix of the dimensions."""
    measures = ["nodes", "total_cores", "total_ram", "total_exec", "total_ec",
                "exec_ram_gb", "used_cores", "used_ram"]
    return sized.selectExpr(*dims, *measures, f"{STATUS} AS _status").rollup(*dims).agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("clusters"),
        *[F.sum(m).alias(m) for m in measures],
        *[F.expr(f"count_if(_status = '{name}') AS n_{name}")
          for name in ("critical", "warning", "under", "optimal")])
