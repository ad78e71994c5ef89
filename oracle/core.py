"""SQL for sources, lookups, sizing, accounting, rules and alerts."""

from __future__ import annotations

from fleetwright.sources import fixtures as fx
from oracle import base as b

SIZED_OUT = """cluster_id, rm_r, total_cores, total_ram, usable_cpn, avail_ram, exec_c, exec_pn,
 exec_m, exec_oh, drv_m, drv_c, exec_nodes, total_exec, total_ec, para, shuf_p, dyn_max, used_cores,
 exec_ram_gb, reserve_ram, used_ram, core_util, mem_util, unused_cores, unused_ram,
 usable_total_cores, usable_total_ram, drv_oh, master_ram, master_cores, master_ram_used,
 master_cores_used, master_ram_util, master_core_util, master_ram_free, master_cores_free"""

NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def parse(x: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract({x}, '{NUMBER}', 1) AS DOUBLE), 0.0)"


def at_least(low, x: str) -> str:
    return f"greatest({low}::DOUBLE, {x})"


def text_or(x: str, default: str) -> str:
    return f"coalesce(nullif({x}, ''), '{default}')"


RAW = "raw AS (" + b.select(fx.RAW_SPECS, "customer") + ")"

READ_SPECS = f"""specs AS (SELECT cluster_id, {at_least(1, parse('nodes'))} AS nodes, {at_least(1, parse('cpn'))} AS cpn,
 {at_least(1, parse('rpn'))} AS rpn, {parse('os_r')} AS os_r, {parse('rm_r')} AS rm_r, {at_least(0, parse('os_cr'))} AS os_cr,
 {at_least(1, parse('min_ec'))} AS min_ec, {at_least(1, parse('min_em'))} AS min_em,
 coalesce(nullif({parse('mf')}, 0), 0.6::DOUBLE) AS mf, coalesce(nullif({parse('sf')}, 0), 0.5::DOUBLE) AS sf,
 coalesce(nullif(trunc({parse('num_jobs')}), 0), 2.0::DOUBLE) AS num_jobs,
 {at_least(1, parse('master_ram'))} AS master_ram, {at_least(1, parse('master_cores'))} AS master_cores,
 {parse('dyn_min')} AS dyn_min, {parse('dyn_init')} AS dyn_init, {parse('dyn_idle')} AS dyn_idle,
 coalesce(enf_c = 'true', false) AS enf_c, coalesce(enf_m = 'true', false) AS enf_m, coalesce(aqe = 'true', false) AS aqe,
 coalesce(dyn_alloc = 'true', false) AS dyn_alloc, coalesce(pyspark = 'true', false) AS pyspark,
 {text_or('workload', 'etl')} AS workload, {text_or('rm', 'yarn')} AS rm, {text_or('sv', '3.5')} AS sv,
 {text_or('storage', 'hdfs')} AS storage, {text_or('deploy_mode', 'client')} AS deploy_mode,
 {text_or('scheduler', 'fair')} AS scheduler FROM raw)"""


def param(key: str) -> str:
    raw = f"regexp_extract(split_part(url, '#', 1), '[?&]{key}=([^&]*)', 1)"
    return f"nullif(url_decode(replace({raw}, '+', ' ')), '')"


def link_number(key: str, default: float) -> str:
    p = param(key)
    return f"CASE WHEN {p} IS NULL THEN {default}::DOUBLE ELSE {at_least(1, parse(p))} END"


def band(policy: str, x: str) -> str:
    hi, mid, low = {"standard": (95, 80, 50), "fleet": (95, 80, 50), "report": (90, 80, None),
                    "master": (90, 70, None), "capacity": (95, 80, 40)}[policy]
    under = f" WHEN {x} < {low} THEN 'under'" if low else ""
    return f"CASE WHEN {x} > {hi} THEN 'critical' WHEN {x} > {mid} THEN 'warning'{under} ELSE 'optimal' END"


FLEET = ("CASE WHEN core_util > 95 OR mem_util > 95 THEN 'critical' WHEN core_util > 80 OR mem_util > 80"
         " THEN 'warning' WHEN core_util < 50 AND mem_util < 50 THEN 'under' ELSE 'optimal' END")


def union(rows: list[str]) -> str:
    return "\nUNION ALL ".join(rows)


def lines(rows: list[tuple[str, str]], source: str = "sized") -> str:
    """Numbered alternatives: (select list, filter)."""
    return union([f"SELECT cluster_id, {i} AS pos, {cols} FROM {source} WHERE {where}"
                  for i, (cols, where) in enumerate(rows)])


DRIVER = "CASE WHEN deploy_mode = 'cluster' THEN drv_m ELSE 0.0 END"
LEDGER = {"executor_heap": "round(total_exec * exec_m)", "overhead": "round(total_exec * exec_oh / 1024)",
          "driver": DRIVER, "reserves": "round(reserve_ram)", "unused": "greatest(0.0, round(unused_ram))"}


def half_up(x: str) -> str:
    """Nearest whole number, ties upwards also below zero."""
    return f"floor({x} + 0.5::DOUBLE)"


def bar(name, used, total, unit, available, driver="0.0"):
    pct = f"least(100.0, round({used} / {total} * 100))::DOUBLE"
    return (f"'{name}' AS line, ({used})::DOUBLE AS used, {total} AS total, '{unit}' AS unit, {pct} AS pct,"
            f" ({available})::DOUBLE AS available, CASE WHEN {pct} > 95 THEN 'critical' WHEN {pct} > 80 THEN 'warning'"
            f" ELSE 'normal' END AS tag, ({driver})::DOUBLE AS driver_gb", "true")


DRIVER_BAR = ("CASE WHEN deploy_mode = 'cluster' THEN round((drv_m + drv_oh / 1024) * 10) / 10 ELSE 0.0 END")
JVM = "exec_m + round(exec_oh / 1024 * 10) / 10"


def fixed(x: str, digits: int) -> str:
    """Fixed decimals on the exact binary value, exact ties upwards."""
    k = 2 ** (digits + 1)
    return (f"CASE WHEN ({x}) * {k} = floor(({x}) * {k}) THEN printf('%.{digits}f', round(({x}) * {10 ** digits}) / {10 ** digits})"
            f" ELSE printf('%.{digits}f', {x}) END")


def part(name: str, gb: str, where: str = "true"):
    return (f"{JVM} AS jvm_total_gb, {fixed('exec_m / exec_c', 1)} AS gb_per_core, round(exec_m * mf) AS managed_gb,"
            f" '{name}' AS part, ({gb})::DOUBLE AS gb, round(({gb}) / ({JVM}) * 100) AS pct", where)


def ranked(rules: list[tuple], extra: str = "", source: str = "sized", fallback: tuple | None = None,
           keep: str = "") -> str:
    """Rules as numbered alternatives; `pos` counts the ones that fired for a cluster."""
    parts = []
    for i, (name, severity, cond, observed, limit, *fixes) in enumerate(rules):
        fix = [*fixes, "NULL", "NULL"][:2]
        parts.append(f"SELECT cluster_id, {keep}{i} AS ord, '{name}' AS rule, '{severity}' AS severity,"
                     f" ({observed})::DOUBLE AS observed, ({limit})::DOUBLE AS threshold, ({fix[0]})::DOUBLE AS fix,"
                     f" ({fix[1]})::DOUBLE AS fix_alt FROM {source} WHERE {cond}")
    return union(parts)


MASTER = [
    ("M1", "error", "master_ram_util > 90", "master_ram_util", "90"),
    ("M2", "warning", "master_ram_util > 70 AND master_ram_util <= 90", "master_ram_util", "70"),
    ("M3", "error", "master_core_util > 90", "master_core_util", "90"),
    ("M4", "error", "master_ram_used > master_ram * 0.85::DOUBLE", "master_ram_used", "master_ram * 0.85::DOUBLE"),
    ("M5", "ok", "master_ram_util <= 70 AND master_core_util <= 70", "master_ram_util", "70"),
    ("M6", "tip", "master_ram < 8", "master_ram", "8"),
    ("M7", "tip", "master_cores < 4", "master_cores", "4"),
    ("M8", "tip", "drv_m > master_ram * 0.5::DOUBLE", "drv_m", "master_ram * 0.5::DOUBLE"),
]
WARN = [
    ("W1", "warning", "NOT enf_c AND exec_c < min_ec", "exec_c", "min_ec"),
    ("W2", "warning", "NOT enf_m AND exec_m < min_em", "exec_m", "min_em"),
    ("W3", "info", "enf_c AND exec_c = min_ec", "exec_c", "min_ec"),
    ("W4", "info", "enf_m AND exec_m = min_em", "exec_m", "min_em"),
    ("W5", "error", "core_util > 95", "core_util", "95", "greatest(2, exec_c - 1)", "greatest(1, exec_pn - 1)"),
    ("W6", "error", "mem_util > 95", "mem_util", "95", "greatest(1, exec_m - 2)"),
    ("W7", "warning", "core_util > 80 AND core_util <= 95", "core_util", "80"),
    ("W8", "warning", "mem_util > 80 AND mem_util <= 95", "mem_util", "80"),
    ("W9", "warning", "exec_c > 5 AND workload <> 'ml'", "exec_c", "5"),
    ("W10", "warning", "exec_m > 64", "exec_m", "64"),
    ("W11", "warning", "exec_oh < 512", "exec_oh", "512"),
    ("W12", "warning", "para < total_ec", "para", "total_ec", "total_ec"),
    ("W13", "info", "core_util < 50 AND mem_util < 50", "greatest(core_util, mem_util)", "50"),
    ("W14", "info", "exec_pn = 1", "exec_pn", "1"),
    ("W15", "ok", "aqe", "1", "1"),
    ("W16", "info", "dyn_alloc", "1", "1"),
    ("W17", "info", "pyspark", "1", "1", "greatest(512, exec_oh - 1024)"),
    ("W18", "error", "deploy_mode = 'client' AND master_ram_util > 90", "master_ram_util", "90"),
    ("W19", "warning", "deploy_mode = 'client' AND master_ram_util > 70 AND master_ram_util <= 90", "master_ram_util", "70"),
    ("W20", "warning", "deploy_mode = 'client' AND master_core_util > 80", "master_core_util", "80"),
    ("W21", "warning", "deploy_mode = 'client' AND drv_m >= 16", "drv_m", "16", "drv_m + 4"),
]
MASTER_COLS = ("master_ram, master_ram_used, master_ram_free, master_ram_util, master_cores,"
               " master_cores_used, master_cores_free, master_core_util")


def edges(source: str, cond: str, keys: str = "cluster_id, metric") -> str:
    return (f"SELECT * EXCLUDE (is_on, was_on) FROM (SELECT *, lag(is_on) OVER (PARTITION BY {keys} ORDER BY ts, sample_id)"
            f" AS was_on FROM (SELECT *, coalesce({cond}, false) AS is_on FROM {source})) WHERE is_on AND NOT coalesce(was_on, false)")


def variant(i: int, **changes) -> str:
    replace = ", ".join(f"{value} AS {name}" for name, value in changes.items())
    star = f"* REPLACE ({replace})" if changes else "*"
    return f"SELECT {star}, {i} AS variant FROM specs"


GROUPED = ["nodes", "total_cores", "total_ram", "total_exec", "total_ec", "exec_ram_gb", "used_cores", "used_ram"]

W = f"WITH {b.SIZED}\n"

DEBOUNCE = f"""WITH {b.SAMPLES}, g AS (SELECT *, lag(ts) OVER (PARTITION BY cluster_id ORDER BY ts, sample_id) AS before FROM samples),
 i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END)
 OVER (PARTITION BY cluster_id ORDER BY ts, sample_id) AS burst FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, burst ORDER BY ts DESC, sample_id DESC) AS back FROM i)
 SELECT cluster_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS edits, max(metric) FILTER (back = 1) AS metric,
 max(value) FILTER (back = 1) AS value FROM r GROUP BY cluster_id, burst"""
WINDOWS = f"""WITH {b.SAMPLES}, w AS (SELECT *, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - unnest([0, 1]) * INTERVAL 3 HOUR AS window_start FROM samples),
 a AS (SELECT cluster_id, metric, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS samples,
 sum(CAST(round(value * 1e6) AS BIGINT))::DOUBLE / count(*) / 1e6 AS average, max(value) AS peak FROM w GROUP BY cluster_id, metric, window_start)
 SELECT *, {band('standard', 'average')} AS band FROM a"""
LATEST = "WITH changes AS (" + b.select(fx.SPEC_CHANGES, "events") + f"""),
 newest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, seq DESC) AS rn FROM changes) WHERE rn = 1),
 specs AS (SELECT *, false AS pyspark, false AS enf_c, false AS enf_m, true AS aqe, {b.SPEC_TAIL} FROM newest),
 {b.sizing('specs')} SELECT {SIZED_OUT} FROM sized"""

OVERRIDDEN = "WITH changes AS (" + b.select(fx.SPEC_CHANGES, "events") + f"""), {b.LOG}, {b.OVERRIDES},
 newest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, seq DESC) AS rn FROM changes) WHERE rn = 1),
 specs AS (SELECT *, false AS pyspark, false AS enf_c, false AS enf_m, true AS aqe, {b.SPEC_TAIL} FROM newest),
 {b.sizing('specs', overrides=True)} SELECT {SIZED_OUT} FROM sized"""

CHANGES_MUTED = f"""WITH {b.ALERT_KEYS}, {b.MUTES},
 u AS (SELECT k.* FROM (SELECT * FROM keys WHERE seq NOT IN (SELECT seq FROM mutes)) k ASOF LEFT JOIN mutes m ON k.cluster_id = m.cluster_id AND k.ts >= m.ts
 WHERE NOT coalesce(m.muted, false)),
 s AS (SELECT *, CASE WHEN alert_key IN ('', 'OC') THEN '' ELSE alert_key END AS shown FROM u),
 l AS (SELECT *, lag(shown, 1, '') OVER (PARTITION BY cluster_id ORDER BY ts, seq) AS before FROM s)
 SELECT cluster_id, seq, ts, alert_key FROM l WHERE shown <> '' AND shown <> before"""

MUTED = f"""WITH {b.SAMPLES}, {b.MUTES},
 spans AS (SELECT *, sum(CASE WHEN muted THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id ORDER BY ts, seq) AS n FROM mutes),
 j AS (SELECT s.*, coalesce(m.muted, false) AS muted, CAST(coalesce(m.n, 0) AS BIGINT) AS span
 FROM (SELECT * FROM samples WHERE metric <> 'evictions') s ASOF LEFT JOIN spans m ON s.cluster_id = m.cluster_id AND s.ts >= m.ts),
 heard AS (SELECT * EXCLUDE (muted) FROM j WHERE NOT muted)
 {edges('heard', 'value > 20', 'cluster_id, metric, span')}"""


def passed(sql: str) -> str:
    """What a stream has judged: everything before its last watermark."""
    return f"SELECT * FROM ({sql}) WHERE ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)"


CLASSIFIED = W + union(
        [f"SELECT cluster_id, '{p}' AS policy, '{m}' AS metric, {x} AS percent, {band(p, x)} AS band FROM sized"
         for p in ("standard", "report", "capacity") for m, x in (("core", "core_util"), ("mem", "mem_util"))]
        + [f"SELECT cluster_id, 'fleet', 'worst', greatest(core_util, mem_util), {FLEET} FROM sized"]
        + [f"SELECT cluster_id, 'master', '{m}', {x}, {band('master', x)} FROM sized WHERE deploy_mode = 'client'"
           for m, x in (("core", "master_core_util"), ("mem", "master_ram_util"))])

SQL = {
    "s1_read_specs": f"WITH {RAW}, {READ_SPECS} SELECT * FROM specs",
    "s2_decode_share_links": f"""WITH {b.CLUSTERS}, links AS (
 SELECT cluster_id AS link_id, 'shared' AS origin, {fx.SHARE_LINK} AS url FROM clusters
 UNION ALL SELECT page_id, 'page', url FROM pages)
 SELECT *, {link_number('n', 10)} AS nodes, {link_number('c', 16)} AS cpn, {link_number('r', 64)} AS rpn,
 coalesce({param('m')}, 'client') AS deploy_mode, coalesce({param('w')}, 'etl') AS workload FROM links""",
    "s3_encode_share_links": f"""WITH {b.CLUSTERS} SELECT cluster_id,
 concat(split_part(coalesce(url, 'https://fleet.example/plan?old=1'), '?', 1), '?n=', {b.num('nodes')}, '&c=', {b.num('cpn')},
 '&r=', {b.num('rpn')}, '&m=', deploy_mode, '&w=', workload) AS share_url FROM clusters LEFT JOIN pages ON page_id = cluster_id""",
    "p1_apply_templates": f"""WITH {b.CLUSTERS}, t(template, tn, tc, tr) AS (VALUES ('small',4,8,32),('medium',10,16,64),
 ('large',20,32,128),('xlarge',50,64,256),('emr',10,16,64),('databricks',8,16,56),('hdp',12,24,96))
 SELECT cluster_id, template, coalesce(tn, nodes)::DOUBLE AS nodes, coalesce(tc, cpn)::DOUBLE AS cpn,
 coalesce(tr, rpn)::DOUBLE AS rpn FROM clusters LEFT JOIN t USING (template)""",
    "p2_resolve_rm_reserve": f"""WITH {RAW}, {READ_SPECS}, {b.CLUSTERS},
 n AS (SELECT cluster_id, coalesce(nullif({fx.ANY_RM}, ''), 'yarn') AS rm FROM clusters)
 SELECT n.cluster_id, n.rm, CASE n.rm WHEN 'local' THEN 0.0 ELSE coalesce(nullif(rm_r, 0.0),
 CASE n.rm WHEN 'k8s' THEN 2.0 ELSE 1.0 END) END::DOUBLE AS rm_r FROM n JOIN specs USING (cluster_id)""",
    "p3_label_dims": f"""WITH {b.CLUSTERS}, n AS (SELECT * REPLACE ({fx.ANY_WORKLOAD} AS workload) FROM clusters)
 SELECT cluster_id, CASE workload WHEN 'etl' THEN 'ETL' WHEN 'ml' THEN 'ML/AI' WHEN 'streaming' THEN 'STREAM'
 WHEN 'interactive' THEN 'ADHOC' WHEN 'graph' THEN 'GRAPH' ELSE workload END AS workload_label,
 upper(deploy_mode) AS mode_label, upper(rm) AS rm_label,
 CASE WHEN scheduler IN ('fair', 'fifo', 'capacity') THEN upper(scheduler) ELSE 'FAIR' END AS scheduler_label,
 'Spark 3.5' AS version_label FROM n""",
    "p4_merge_custom_props": f"""WITH {b.PROPS} SELECT *, 'cluster' AS mode FROM props WHERE key <> '' AND val <> ''
 UNION ALL SELECT *, 'job' FROM props WHERE key <> ''""",
    "p5_apply_overrides": f"WITH {b.LOG}, {b.OVERRIDES} SELECT * FROM overrides",
    "z1_size_fleet": f"{W} SELECT {SIZED_OUT} FROM sized",
    "z1_size_fleet_overridden": f"WITH {b.SIZED_SET} SELECT {SIZED_OUT} FROM sized",
    "z2_scaling_curve": f"""{W}, p AS (SELECT *, unnest(range(1, CAST(nodes AS BIGINT) + 1)) AS n FROM sized),
 e AS (SELECT cluster_id, CAST(n AS INT) AS n, exec_c, CASE WHEN deploy_mode = 'cluster' THEN greatest(1, n - 1) ELSE n END * exec_pn AS executors FROM p)
 SELECT cluster_id, n, executors, executors * exec_c AS tasks, executors * exec_c * 2 AS parallelism,
 round(executors * exec_c * 2 / 10) AS parallelism_tenth FROM e""",
    "z3_what_if_grid": f"""WITH {b.SPECS}, grid AS ({b.select(fx.CANDIDATES, 'supplier')}),
 v AS (SELECT specs.* REPLACE (coalesce(g.nodes, specs.nodes) AS nodes, coalesce(g.rpn, specs.rpn) AS rpn, coalesce(g.workload, specs.workload) AS workload,
 coalesce(g.deploy_mode, specs.deploy_mode) AS deploy_mode), g.variant FROM specs CROSS JOIN grid g), {b.sizing('v')}
 SELECT variant, count(*) AS clusters, sum(total_exec) AS total_exec, sum(total_ec) AS total_ec, sum(exec_m) AS heaps, max(mem_util) AS most_mem,
 min(core_util) AS least_core, count(*) FILTER (mem_util > 95) AS over_full FROM sized GROUP BY variant""",
    "z3_what_if": f"""WITH {b.SPECS}, v AS ({union([variant(0), variant(1, nodes='20.0::DOUBLE'), variant(2, workload="'ml'"),
        variant(3, deploy_mode="'cluster'", rpn='128.0::DOUBLE'), variant(4, rm="'local'", cpn='9.0::DOUBLE')])}), {b.sizing('v')}
 SELECT cluster_id, variant, nodes, cpn, rpn, exec_c, exec_pn, exec_m, exec_oh, total_exec, total_ec, para, core_util, mem_util FROM sized""",
    "z4_driver_profile": f"""{W} SELECT cluster_id, deploy_mode, CASE WHEN deploy_mode = 'client' THEN CASE WHEN drv_m >= 16 THEN 'high'
 WHEN drv_m >= 8 THEN 'moderate' ELSE 'low' END END AS footprint, drv_m AS heap_gb, drv_oh AS overhead_mb, drv_c AS cores,
 CASE WHEN deploy_mode = 'cluster' THEN 1.0 ELSE 0.0 END::DOUBLE AS reserved_nodes, exec_nodes, exec_pn, total_exec FROM sized""",
    "z5_dynamic_allocation_plan": f"""{W} SELECT cluster_id, rm, coalesce(nullif(dyn_min, 0.0), 1.0)::DOUBLE AS min_executors, total_exec AS max_executors,
 coalesce(nullif(dyn_init, 0.0), 4.0)::DOUBLE AS initial_executors, coalesce(nullif(dyn_idle, 0.0), 60.0)::DOUBLE AS idle_seconds, CASE WHEN rm = 'yarn' THEN 'spark.shuffle.service.enabled'
 ELSE 'spark.dynamicAllocation.shuffleTracking.enabled' END AS shuffle_property FROM sized WHERE dyn_alloc""",
    "u1_utilisation": f"""{W} SELECT cluster_id, used_cores, total_cores, core_util, unused_cores, used_ram, total_ram, mem_util, unused_ram,
 usable_total_cores, usable_total_ram, {band('standard', 'core_util')} AS core_band, {band('standard', 'mem_util')} AS mem_band,
 {FLEET} AS status FROM sized""",
    "u2_classify": CLASSIFIED,
    "u2_classify_by_policies": f"""WITH judged AS ({CLASSIFIED}),
 steps AS ({b.select(fx.BAND_LADDER, 'nation')}),
 ladder AS (SELECT j.cluster_id, 'ladder' AS policy, j.metric, j.percent, arg_max(s.band, coalesce(s.low, -1)) AS band FROM judged j JOIN steps s
 ON s.low IS NULL OR j.percent > s.low OR (j.percent = s.low AND NOT s.above) WHERE j.policy = 'standard' GROUP BY ALL)
 SELECT * FROM judged UNION ALL SELECT * FROM ladder""",
    "u3_memory_ledger": W + lines([
        (f"'{n}' AS segment, ({x})::DOUBLE AS gb, round(({x}) / total_ram * 100) AS pct", "true") for n, x in LEDGER.items()]),
    "u4_core_ledger": W + lines([
        (f"'{n}' AS segment, ({x})::DOUBLE AS cores, round(({x}) / total_cores * 100) AS pct", "true") for n, x in {
            "executor_cores": "total_ec", "driver": "CASE WHEN deploy_mode = 'cluster' THEN drv_c ELSE 0.0 END",
            "os_reserve": "nodes * os_cr", "unused": "unused_cores"}.items()]),
    "u5_capacity_bars": W + lines([
        bar("cores", "used_cores", "total_cores", "cores", "unused_cores"),
        bar("memory", "round(used_ram)", "total_ram", "GB", "round(unused_ram)", DRIVER_BAR),
        bar("executor_heap", LEDGER["executor_heap"], "total_ram", "GB", half_up(f"total_ram - {LEDGER['executor_heap']}")),
        bar("executor_overhead", LEDGER["overhead"], "total_ram", "GB", half_up(f"total_ram - {LEDGER['overhead']}")),
        bar("reserves", LEDGER["reserves"], "total_ram", "GB", half_up("total_ram - reserve_ram"))]),
    "u5_usage_summary": W + lines([
        (f"'{n}' AS resource, {u} AS used, {f} AS available, round({u} / {t} * 100) AS used_pct, round({f} / {t} * 100) AS available_pct", "true")
        for n, u, f, t in (("cores", "used_cores", "unused_cores", "total_cores"),
                           ("memory_gb", "round(used_ram)", "round(unused_ram)", "total_ram"))]),
    "u6_executor_memory_breakdown": W + lines([
        part("execution", "round(exec_m * mf * (1 - sf))"), part("storage", "round(exec_m * mf * sf)"),
        part("user", "round(exec_m * (1 - mf))"),
        part("jvm_overhead", "round(greatest(384.0, round(exec_m * 1024 * 0.1::DOUBLE)) / 1024::DOUBLE * 100) / 100"),
        part("pyspark_overhead", "1.0", "pyspark")]),
    "u7_master_utilisation": f"""{W}, client AS (SELECT * FROM sized WHERE deploy_mode = 'client'),
 hits AS ({ranked(MASTER, source='client')}), placed AS (SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY ord) - 1 AS INT) AS pos,
 rule, severity, observed, threshold FROM hits)
 SELECT cluster_id, {MASTER_COLS}, pos, rule, severity, observed, threshold FROM client LEFT JOIN placed USING (cluster_id)""",
    "u8_fleet_rollup": f"""{W}, s AS (SELECT *, {FLEET} AS st FROM sized)
 SELECT workload, rm, deploy_mode, CAST(grouping_id(workload, rm, deploy_mode) AS INT) AS level, count(*) AS clusters,
 {', '.join(f'sum({m}) AS {m}' for m in GROUPED)},
 {', '.join(f"count(*) FILTER (st = '{n}') AS n_{n}" for n in ('critical', 'warning', 'under', 'optimal'))}
 FROM s GROUP BY ROLLUP (workload, rm, deploy_mode)""",
    "r1_evaluate_warnings": f"""{W}, hits AS ({ranked(WARN)}), every AS (SELECT * FROM hits UNION ALL
 SELECT cluster_id, 99, 'W22', 'ok', 0.0, 0.0, NULL, NULL FROM sized WHERE cluster_id NOT IN (SELECT cluster_id FROM hits))
 SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY ord) - 1 AS INT) AS pos, * EXCLUDE (cluster_id, ord) FROM every""",
    "r4_edge_alerts": f"WITH {b.SAMPLES} {edges('samples', 'value > 40')}",
    "v3_edge_alerts_stream": passed(f"WITH {b.SAMPLES} {edges('samples', 'value > 40')}"),
    "r5_change_alerts_muted": CHANGES_MUTED,
    "r5_change_alerts_stream": passed(CHANGES_MUTED),
    "r5_change_alerts": f"""WITH {b.ALERT_KEYS}, s AS (SELECT *, CASE WHEN alert_key IN ('', 'OC') THEN '' ELSE alert_key END AS shown FROM keys),
 l AS (SELECT *, lag(shown, 1, '') OVER (PARTITION BY cluster_id ORDER BY ts, seq) AS before FROM s)
 SELECT cluster_id, seq, ts, alert_key FROM l WHERE shown <> '' AND shown <> before""",
    "r6_muted_alerts": MUTED,
    "r6_muted_alerts_stream": passed(MUTED),
    "r6_span_alerts": f"""WITH {b.SAMPLES}, spans AS ({b.select(fx.MUTE_SPANS, 'events')} WHERE event_type = 'error'),
 heard AS (SELECT s.*, (SELECT count(*) FROM spans p WHERE p.cluster_id = s.cluster_id AND p.ts <= s.ts) AS span
 FROM samples s WHERE metric <> 'evictions' AND NOT EXISTS (SELECT 1 FROM spans p WHERE p.cluster_id = s.cluster_id
 AND p.ts <= s.ts AND (p.until IS NULL OR s.ts < p.until)))
 {edges('heard', 'value > 20', 'cluster_id, metric, span')}""",
    "r7_tuning_hints": f"""WITH {b.TASK_METRICS}, t AS (SELECT cluster_id, value, row_number() OVER (PARTITION BY cluster_id ORDER BY value) AS rn,
 count(*) OVER (PARTITION BY cluster_id) AS n FROM task_metrics WHERE metric = 'task_ms'),
 med AS (SELECT cluster_id, max(value) FILTER (rn = ceil(n / 2)) AS median FROM t GROUP BY cluster_id),
 m AS (SELECT cluster_id, max(value) FILTER (metric = 'gc_pct') AS gc, max(value) FILTER (metric = 'spill_gb') AS spill,
 max(value) FILTER (metric = 'evictions') AS evictions, max(value) FILTER (metric = 'task_ms') AS slowest,
 min(value) FILTER (metric = 'cache_hit_pct') AS hits FROM task_metrics GROUP BY cluster_id),
 s AS (SELECT * FROM m LEFT JOIN med USING (cluster_id)), h AS ({ranked([
        ('gc_time', 'reduce_heap', 'gc > 10', 'gc', '10'), ('spill', 'more_execution_memory', 'spill > 0', 'spill', '0'),
        ('skew', 'enable_aqe', 'slowest > median * 5', 'slowest', 'median * 5'),
        ('evictions', 'larger_storage_fraction', 'evictions > 0', 'evictions', '0'),
        ('cache_hits', 'more_heap', 'hits < 50', 'hits', '50')], source='s')})
 SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY ord) - 1 AS INT) AS pos, rule AS symptom, severity AS hint,
 observed, threshold FROM h""",
    "v1_debounce": DEBOUNCE,
    "v1_debounce_stream": "SELECT * FROM (" + DEBOUNCE + ") WHERE last_ts + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "v4_usage_windows_stream": "SELECT * FROM (" + WINDOWS + ") WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "v2_latest_spec": LATEST,
    "v2_latest_spec_stream": LATEST,
    "v2_overridden_spec": OVERRIDDEN,
    "v2_overridden_spec_stream": OVERRIDDEN,
    "v4_usage_windows": WINDOWS,
}
