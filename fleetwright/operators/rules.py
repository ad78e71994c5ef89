"""Advisory rules as data (R1) and hints over measured task metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.columns import open_rows, records


@dataclass(frozen=True)
class Rule:
    """A condition with the value it looks at, its limit and up to two suggested values."""

    name: str
    severity: str
    when: str
    observed: str
    threshold: str
    fix: str = "NULL"
    fix_alt: str = "NULL"

    def row(self) -> dict[str, str]:
        return {
            "rule": f"'{self.name}'", "severity": f"'{self.severity}'",
            "observed": f"CAST({self.observed} AS DOUBLE)",
            "threshold": f"CAST({self.threshold} AS DOUBLE)",
            "fix": f"CAST({self.fix} AS DOUBLE)", "fix_alt": f"CAST({self.fix_alt} AS DOUBLE)",
            "hit": self.when,
        }


def fired(rules: list[Rule]) -> str:
    """Array of the rules that hold for a row, in rule order."""
    return f"filter({records([r.row() for r in rules])}, r -> r.hit)"


CLIENT = "deploy_mode = 'client'"

# W3 and W4 also fire when the computed value merely equals the minimum.
WARNINGS = [
    Rule("W1", "warning", "NOT enf_c AND exec_c < min_ec", "exec_c", "min_ec"),
    Rule("W2", "warning", "NOT enf_m AND exec_m < min_em", "exec_m", "min_em"),
    Rule("W3", "info", "enf_c AND exec_c = min_ec", "exec_c", "min_ec"),
    Rule("W4", "info", "enf_m AND exec_m = min_em", "exec_m", "min_em"),
    Rule("W5", "error", "core_util > 95", "core_util", "95",
         "greatest(2D, exec_c - 1)", "greatest(1D, exec_pn - 1)"),
    Rule("W6", "error", "mem_util > 95", "mem_util", "95", "greatest(1D, exec_m - 2)"),
    Rule("W7", "warning", "core_util > 80 AND core_util <= 95", "core_util", "80"),
    Rule("W8", "warning", "mem_util > 80 AND mem_util <= 95", "mem_util", "80"),
    Rule("W9", "warning", "exec_c > 5 AND workload <> 'ml'", "exec_c", "5"),
    Rule("W10", "warning", "exec_m > 64", "exec_m", "64"),
    Rule("W11", "warning", "exec_oh < 512", "exec_oh", "512"),
    Rule("W12", "warning", "para < total_ec", "para", "total_ec", "total_ec"),
    Rule("W13", "info", "core_util < 50 AND mem_util < 50", "greatest(core_util, mem_util)", "50"),
    Rule("W14", "info", "exec_pn = 1", "exec_pn", "1"),
    Rule("W15", "ok", "aqe", "1", "1"),
    Rule("W16", "info", "dyn_alloc", "1", "1"),
    Rule("W17", "info", "pyspark", "1", "1", "greatest(512D, exec_oh - 1024)"),
    Rule("W18", "error", f"{CLIENT} AND master_ram_util > 90", "master_ram_util", "90"),
    Rule("W19", "warning", f"{CLIENT} AND master_ram_util > 70 AND master_ram_util <= 90",
         "master_ram_util", "70"),
    Rule("W20", "warning", f"{CLIENT} AND master_core_util > 80", "master_core_util", "80"),
    Rule("W21", "warning", f"{CLIENT} AND drv_m >= 16", "drv_m", "16", "drv_m + 4"),
]
NOTHING = Rule("W22", "ok", "true", "0", "0")

# Our own one-line explanations; the figures are in the other columns.
EXPLANATIONS = {
    "W1": "executor cores under the minimum, which is not enforced",
    "W2": "executor heap under the minimum, which is not enforced",
    "W3": "executor cores sit on the enforced minimum",
    "W4": "executor heap sits on the enforced minimum",
    "W5": "cores over-committed: use smaller or fewer executors",
    "W6": "memory over-committed: use a smaller heap or larger nodes",
    "W7": "little core headroom left",
    "W8": "little memory headroom left",
    "W9": "many concurrent streams per executor slow distributed storage",
    "W10": "large heap: expect long collector pauses",
    "W11": "little off-heap memory",
    "W12": "fewer partitions than task slots",
    "W13": "cores and memory mostly idle",
    "W14": "a single executor per node",
    "W15": "adaptive execution is on",
    "W16": "dynamic allocation needs a shuffle service or shuffle tracking",
    "W17": "memory for Python workers is included in the overhead",
    "W18": "driver nearly fills the submitting host",
    "W19": "driver takes much of the submitting host",
    "W20": "driver cores crowd the submitting host",
    "W21": "large driver heap: give the submitting host headroom",
    "W22": "nothing to remark",
}


def evaluate_warnings(sized: DataFrame) -> DataFrame:
    """One row per fired rule and cluster; W22 stands alone when nothing fired."""
    hits = sized.selectExpr("cluster_id", f"{fired(WARNINGS)} AS _hits")
    rows = open_rows(hits, ["cluster_id"], f"IF(size(_hits) > 0, _hits, {records([NOTHING.row()])})")
    texts = ", ".join(f"'{rule}', '{text}'" for rule, text in EXPLANATIONS.items())
    return rows.selectExpr("* EXCEPT (hit)", f"map({texts})[rule] AS explanation")


# Fixed value: share of time in the garbage collector above which a smaller heap is advised.
GC_LIMIT_PCT = 10
# Our own limits, as defaults: a task this many times the median is skewed; a hit rate below this is low.
SKEW_FACTOR = 5.0
LOW_HIT_PCT = 50.0


def _hints(gc_pct: float, skew: float, low_hits: float) -> list[Rule]:
    return [
        Rule("gc_time", "reduce_heap", f"gc > {gc_pct}", "gc", str(gc_pct)),
        Rule("spill", "more_execution_memory", "spill > 0", "spill", "0"),
        Rule("skew", "enable_aqe", f"slowest > median * {skew}D", "slowest", f"median * {skew}D"),
        Rule("evictions", "larger_storage_fraction", "evictions > 0", "evictions", "0"),
        Rule("cache_hits", "more_heap", f"hits < {low_hits}", "hits", str(low_hits)),
    ]


def tuning_hints(metrics: DataFrame, gc_pct: float = GC_LIMIT_PCT, skew: float = SKEW_FACTOR,
                 low_hits: float = LOW_HIT_PCT) -> DataFrame:
    """Hints per cluster from measured task metrics.

    All measures are combined on the map side; the median is `percentile_approx`, whose
    state stays small however many tasks a cluster reports.
    """
    def of(metric):
        return f"IF(metric = '{metric}', value, NULL)"

    measured = metrics.groupBy("cluster_id").agg(*[F.expr(e) for e in (
        f"max({of('gc_pct')}) AS gc", f"max({of('spill_gb')}) AS spill",
        f"max({of('evictions')}) AS evictions", f"max({of('task_ms')}) AS slowest",
        f"percentile_approx({of('task_ms')}, 0.5D) AS median",
        f"min({of('cache_hit_pct')}) AS hits")])
    return open_rows(measured, ["cluster_id"], fired(_hints(gc_pct, skew, low_hits))).selectExpr(
        "cluster_id", "pos", "rule AS symptom", "severity AS hint", "observed", "threshold")
