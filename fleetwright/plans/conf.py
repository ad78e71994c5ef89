"""Spark properties, property files and submit commands."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame

from fleetwright.functions.columns import derive, open_rows, records
from fleetwright.functions.numbers import half_up, job_count, num_text, or_else, overhead_mb
from fleetwright.functions.text import (
    CLUSTER_KEY_WIDTH, JOB_KEY_WIDTH, pad_end, quote, say, slug,
)
from fleetwright.operators.lookups import merge_custom_props, scheduler_label
from fleetwright.operators.sizing import DYNAMIC
from fleetwright.operators.slices import open_positions, positions

CUSTOM_POS = 100

# Fixed values.
QUEUE_CAPACITY = "yarn.scheduler.capacity.root.default.capacity"
KRYO = "org.apache.spark.serializer.KryoSerializer"

# Property lists: (section, key, value expression); a null value leaves the property out.
DRIVER = [
    ("driver", "spark.driver.memory", say("{drv_m}g")),
    ("driver", "spark.driver.cores", num_text("drv_c")),
    ("driver", "spark.driver.memoryOverhead", say("{drv_oh}m")),
]
MEMORY = [
    ("memory", "spark.memory.fraction", num_text("mf")),
    ("memory", "spark.memory.storageFraction", num_text("sf")),
]
ADAPTIVE = [
    ("adaptive", "spark.sql.adaptive.enabled", "CAST(aqe AS STRING)"),
    ("adaptive", "spark.sql.adaptive.coalescePartitions.enabled", "CAST(aqe AS STRING)"),
    ("adaptive", "spark.sql.adaptive.skewJoin.enabled", "CAST(aqe AS STRING)"),
]
KRYO_LINE = ("network", "spark.serializer", quote(KRYO))
KRYO_BUFFER = ("network", "spark.kryoserializer.buffer.max", "'512m'")
DYNAMIC_MAX = num_text(or_else("dyn_max", "total_exec"))


def _dynamic(key: str, value: str, when: str = "dyn_alloc") -> tuple[str, str, str]:
    return "dynamic", key, f"IF({when}, {value}, NULL)"


CLUSTER_CONF = [
    ("executor", "spark.executor.cores", num_text("exec_c")),
    ("executor", "spark.executor.memory", say("{exec_m}g")),
    ("executor", "spark.executor.memoryOverhead", say("{exec_oh}m")),
    ("executor", "spark.executor.instances", num_text("total_exec")),
    *DRIVER,
    ("parallelism", "spark.default.parallelism", num_text("para")),
    ("parallelism", "spark.sql.shuffle.partitions", num_text("shuf_p")),
    *MEMORY,
    *ADAPTIVE,
    ("dynamic", "spark.dynamicAllocation.enabled", "CAST(dyn_alloc AS STRING)"),
    _dynamic("spark.dynamicAllocation.minExecutors", num_text(DYNAMIC["dyn_min"])),
    _dynamic("spark.dynamicAllocation.maxExecutors", DYNAMIC_MAX),
    _dynamic("spark.dynamicAllocation.initialExecutors", num_text(DYNAMIC["dyn_init"])),
    _dynamic("spark.dynamicAllocation.executorIdleTimeout", f"concat({num_text(DYNAMIC['dyn_idle'])}, 's')"),
    _dynamic("spark.shuffle.service.enabled", "'true'", "dyn_alloc AND rm = 'yarn'"),
    _dynamic("spark.dynamicAllocation.shuffleTracking.enabled", "'true'",
             "dyn_alloc AND rm <> 'yarn'"),
    KRYO_LINE,
    KRYO_BUFFER,
    ("network", "spark.network.timeout", "'120s'"),
    ("network", "spark.rpc.askTimeout", "'120s'"),
]


def _executors(count: str, cores: str, heap: str, overhead: str, between: list, para: str) -> list:
    return [
        ("executor", "spark.executor.instances", num_text(count)),
        ("executor", "spark.executor.cores", num_text(cores)),
        ("executor", "spark.executor.memory", f"concat({num_text(heap)}, 'g')"),
        ("executor", "spark.executor.memoryOverhead", f"concat({num_text(overhead)}, 'm')"),
        *between,
        ("parallelism", "spark.default.parallelism", num_text(para)),
        ("parallelism", "spark.sql.shuffle.partitions", num_text(para)),
    ]


JOB_CONF = [
    *_executors("job_exec", "job_exec_c", "job_heap", "job_oh", DRIVER, "job_para"),
    *MEMORY, *ADAPTIVE, KRYO_LINE, KRYO_BUFFER,
]
# A reservation's file leaves the Python share out of the overhead.
RESERVATION_CONF = [
    *_executors("exec_count", "exec_cores", "exec_mem_gb", overhead_mb("exec_mem_gb"), [], "res_para"),
    KRYO_LINE,
]


def _long(df: DataFrame, owner: list[str], conf: list[tuple[str, str, str]]) -> DataFrame:
    rows = records([{"section": f"'{section}'", "key": f"'{key}'", "value": value}
                    for section, key, value in conf])
    return open_rows(df, owner, f"filter({rows}, r -> r.value IS NOT NULL)")


def _custom_rows(props: DataFrame, mode: str, *owner: str) -> DataFrame:
    return merge_custom_props(props, mode).selectExpr(
        "cluster_id", *owner, f"CAST(pos + {CUSTOM_POS} AS INT) AS pos", "'custom' AS section",
        "key", "val AS value")


def conf_properties(sized: DataFrame, props: DataFrame | None = None) -> DataFrame:
    """Properties of each cluster, its own additions last."""
    rows = _long(sized, ["cluster_id"], CLUSTER_CONF)
    return rows if props is None else rows.unionByName(_custom_rows(props, "cluster"))


def job_conf_properties(allocs: DataFrame, props: DataFrame | None = None) -> DataFrame:
    """Properties of each job; driver, fractions and adaptive settings come from the cluster.

    Additions hold for every job of the cluster and are listed once, without a job.
    """
    rows = _long(allocs, ["cluster_id", "job_idx"], JOB_CONF)
    every = "CAST(NULL AS BIGINT) AS job_idx"
    return rows if props is None else rows.unionByName(_custom_rows(props, "job", every))


def reservation_conf_properties(profile: DataFrame, props: DataFrame | None = None) -> DataFrame:
    """Properties of each reservation; additions are listed once per cluster."""
    rows = _long(profile, ["cluster_id", "res_idx"], RESERVATION_CONF)
    every = "CAST(NULL AS BIGINT) AS res_idx"
    return rows if props is None else rows.unionByName(_custom_rows(props, "job", every))


def conf_lines(conf: list[tuple[str, str, str]], width: int) -> str:
    """Lines of a property file as an array over a row's columns, a heading before each section.

    The first property of a section must always be present.
    """
    lines = []
    for section, rows in groupby(conf, key=lambda row: row[0]):
        lines.append(quote(f"# {section}"))
        lines += [f"concat({quote(key.ljust(width))}, {value})" for _, key, value in rows]
    return f"filter(array({', '.join(lines)}), x -> x IS NOT NULL)"


def render_text(df: DataFrame, owner: list[str], conf: list[tuple[str, str, str]], width: int,
                file_name: str, props: DataFrame | None = None, mode: str = "job") -> DataFrame:
    """T4: property files as rows (owner, file_name, pos, line).

    An owner's lines come from columns of its own row, so no shuffle collects them. The
    cluster's additions hold for all its files of that kind and stand once per cluster in a
    file of their own, a row for each, however many there are.
    """
    files = df.selectExpr(*owner, f"{file_name} AS file_name", f"posexplode({conf_lines(conf, width)}) AS (pos, line)")
    if props is None:
        return files
    name = "custom" if mode == "cluster" else "job-custom"
    more = merge_custom_props(props, mode).selectExpr(
        "cluster_id", *[f"CAST(NULL AS BIGINT) AS {o}" for o in owner if o != "cluster_id"],
        f"concat('cluster-', cluster_id, '-{name}.conf') AS file_name", "CAST(pos AS INT) AS pos",
        f"concat({pad_end('key', width)}, val) AS line")
    return files.unionByName(more)


def cluster_texts(sized: DataFrame, props: DataFrame | None = None) -> DataFrame:
    name = "concat('cluster-', cluster_id, '-spark-defaults.conf')"
    return render_text(sized, ["cluster_id"], CLUSTER_CONF, CLUSTER_KEY_WIDTH, name, props, "cluster")


def job_texts(allocs: DataFrame, props: DataFrame | None = None) -> DataFrame:
    name = f"concat('cluster-', cluster_id, '-', {slug('job_name')}, '-spark-defaults.conf')"
    return render_text(allocs, ["cluster_id", "job_idx"], JOB_CONF, JOB_KEY_WIDTH, name, props)


def distinct_names(profile: DataFrame) -> DataFrame:
    """Adds `file_slug`: the slug of a reservation's name, which those that share it tell apart by a number.

    The first by position keeps the plain slug. The others add a blank and their number, which no slug holds, so no
    two reservations of a cluster share a file, whatever they are called. Equal slugs are numbered in slices.
    """
    slugs = derive(profile, {"_slug": slug("res_name")})
    ranked = positions(slugs, ["cluster_id", "_slug"], "res_idx", ["res_idx"], "_same")
    return derive(ranked, {"file_slug": "IF(_same = 0, _slug, concat(_slug, ' ', _same + 1))"}).drop("_slug", "_same")


def reservation_texts(profile: DataFrame, props: DataFrame | None = None) -> DataFrame:
    name = "concat('cluster-', cluster_id, '-', file_slug, '-prealloc.conf')"
    return render_text(distinct_names(profile), ["cluster_id", "res_idx"], RESERVATION_CONF, JOB_KEY_WIDTH, name, props)


def _command(*parts: str, **texts: str) -> str:
    return say(" \\\n  ".join(("spark-submit", *parts)), **texts)


# How each resource manager is addressed.
MASTER_URL = ("CASE rm WHEN 'standalone' THEN 'spark://<master>:7077' WHEN 'yarn' THEN 'yarn'"
              " ELSE 'k8s://https://<k8s-api>' END")


def submit_commands(sized: DataFrame) -> DataFrame:
    """T5: submit command of each cluster."""
    command = _command(
        "--master {master}", "--deploy-mode {mode}", "--num-executors {total_exec}",
        "--executor-cores {exec_c}", "--executor-memory {exec_m}g", "--driver-memory {drv_m}g",
        "--driver-cores {drv_c}", "--conf spark.executor.memoryOverhead={exec_oh}m",
        "--conf spark.default.parallelism={para}", "--conf spark.sql.shuffle.partitions={shuf_p}",
        "--conf spark.sql.adaptive.enabled={adaptive}", f"--conf spark.serializer={KRYO}",
        "your-app.jar", master=MASTER_URL, mode="deploy_mode", adaptive="CAST(aqe AS STRING)")
    return sized.selectExpr("cluster_id", f"{command} AS command")


def job_submit_commands(allocs: DataFrame) -> DataFrame:
    command = _command(
        "--num-executors {job_exec}", "--executor-cores {job_exec_c}",
        "--executor-memory {job_heap}g", "--conf spark.default.parallelism={job_para}",
        "--conf spark.sql.shuffle.partitions={job_para}", "your-{app}-app.jar",
        app=slug("job_name"))
    return allocs.selectExpr("cluster_id", "job_idx", f"{command} AS command")


def reservation_submit_commands(profile: DataFrame) -> DataFrame:
    command = _command(
        "--num-executors {exec_count}", "--executor-cores {exec_cores}",
        "--executor-memory {exec_mem_gb}g", "your-{app}-app.jar", app=slug("res_name"))
    return profile.selectExpr("cluster_id", "res_idx", f"{command} AS command")


def scheduler_properties(clusters: DataFrame) -> DataFrame:
    """Scheduler properties; an unknown scheduler behaves as fair.

    The capacity scheduler's list of queues is given as rows, one for each queue, numbered by `part`: the property's
    value is the parts in order, joined by commas. So a plan of very many jobs makes rows and no long text.
    """
    df = derive(clusters, {"_label": scheduler_label(), "_n": job_count(), "_share": f"greatest(10D, {half_up('100D / _n')})"})

    def only(label, value):
        return f"IF(_label = '{label}', {value}, NULL)"

    plain = _long(df, ["cluster_id"], [
        ("scheduler", "spark.scheduler.mode", "IF(_label = 'FIFO', 'FIFO', 'FAIR')"),
        ("scheduler", "spark.scheduler.allocation.file", only("FAIR", "'fairscheduler.xml'")),
        ("scheduler", QUEUE_CAPACITY, only("CAPACITY", f"concat({num_text('_share')}, '%')")),
    ]).selectExpr("cluster_id", f"IF(key = '{QUEUE_CAPACITY}', 2, pos) AS pos", "key", "CAST(NULL AS BIGINT) AS part", "value")
    listed = df.filter("_label = 'CAPACITY'").selectExpr("cluster_id", "CAST(_n AS BIGINT) + 1 AS _parts")
    queues = open_positions(listed, "0L", "_parts", "part").selectExpr(
        "cluster_id", "1 AS pos", "'yarn.scheduler.capacity.root.queues' AS key", "part",
        "IF(part = 0, 'default', concat('q', part)) AS value")
    return plain.unionByName(queues)
