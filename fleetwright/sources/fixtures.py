"""Logical input tables derived from the driver's parquet tables.

The column expressions are plain SQL that reads the same in Spark and in the checking
engine; the checks reuse them so that both sides start from the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright.operators.slices import positions

CLUSTERS = {
    "cluster_id": "c_custkey",
    "nodes": "CAST(1 + c_custkey % 60 AS DOUBLE)",
    "cpn": "CAST(CASE c_custkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 16 WHEN 3 THEN 24"
           " WHEN 4 THEN 32 ELSE 64 END AS DOUBLE)",
    "rpn": "CAST(CASE c_custkey % 7 WHEN 0 THEN 16 WHEN 1 THEN 32 WHEN 2 THEN 56 WHEN 3 THEN 64"
           " WHEN 4 THEN 96 WHEN 5 THEN 128 ELSE 256 END AS DOUBLE)",
    "workload": "CASE c_mktsegment WHEN 'MACHINERY' THEN 'ml' WHEN 'AUTOMOBILE' THEN 'streaming'"
                " WHEN 'FURNITURE' THEN 'interactive' WHEN 'HOUSEHOLD' THEN 'graph' ELSE 'etl' END",
    "rm": "CASE c_nationkey % 5 WHEN 0 THEN 'yarn' WHEN 1 THEN 'standalone' WHEN 2 THEN 'k8s'"
          " WHEN 3 THEN 'mesos' ELSE 'local' END",
    "deploy_mode": "CASE WHEN c_custkey % 2 = 0 THEN 'client' ELSE 'cluster' END",
    "pyspark": "c_custkey % 3 = 0",
    "enf_c": "c_custkey % 4 = 0",
    "enf_m": "c_custkey % 5 = 0",
    "aqe": "c_custkey % 8 <> 0",
    "dyn_alloc": "c_custkey % 4 < 2",
    "template": "CASE c_custkey % 9 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large'"
                " WHEN 3 THEN 'xlarge' WHEN 4 THEN 'emr' WHEN 5 THEN 'databricks'"
                " WHEN 6 THEN 'hdp' WHEN 7 THEN 'custom' END",
    "dyn_min": "CAST(CASE WHEN c_custkey % 6 = 0 THEN 7 ELSE 0 END AS DOUBLE)",
    "dyn_init": "CAST(CASE WHEN c_custkey % 6 = 0 THEN 9 ELSE 0 END AS DOUBLE)",
    "dyn_idle": "CAST(CASE WHEN c_custkey % 6 = 1 THEN 30.5 ELSE 0 END AS DOUBLE)",
    "scheduler": "CASE c_custkey % 4 WHEN 0 THEN 'fair' WHEN 1 THEN 'fifo' WHEN 2 THEN 'capacity'"
                 " ELSE 'other' END",
    "num_jobs": "CAST(CASE WHEN c_custkey % 17 = 0 THEN 0.5 WHEN c_custkey % 19 = 0 THEN -3 WHEN c_custkey % 23 = 0 THEN 3.9"
                " ELSE c_custkey % 13 END AS DOUBLE)",
}

# Specs as typed into a form: blanks, units, signs and junk included.
RAW_SPECS = {
    "cluster_id": "c_custkey",
    "nodes": "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'many'"
             " ELSE concat(CAST(c_custkey % 60 AS VARCHAR(9)), ' nodes') END",
    "cpn": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('  ', CAST(c_custkey % 33 AS VARCHAR(9))) END",
    "rpn": "CASE WHEN c_custkey % 5 = 0 THEN '1.5e2GB' WHEN c_custkey % 5 = 1 THEN '.5'"
           " WHEN c_custkey % 5 = 2 THEN '62.5' ELSE '+64' END",
    "os_r": "CASE WHEN c_custkey % 3 = 0 THEN '1.5' WHEN c_custkey % 3 = 1 THEN '2 GB' END",
    "rm_r": "CASE WHEN c_custkey % 4 = 0 THEN '3' WHEN c_custkey % 4 = 1 THEN '0' END",
    "os_cr": "CASE WHEN c_custkey % 5 = 0 THEN '-2' ELSE '1' END",
    "min_ec": "CASE WHEN c_custkey % 2 = 0 THEN '4' ELSE '0' END",
    "min_em": "CASE WHEN c_custkey % 2 = 0 THEN '8' ELSE 'x' END",
    "mf": "CASE WHEN c_custkey % 3 = 0 THEN '0.7' WHEN c_custkey % 3 = 1 THEN '0' END",
    "sf": "CASE WHEN c_custkey % 3 = 1 THEN '0.3' ELSE '' END",
    "num_jobs": "CASE WHEN c_custkey % 3 = 0 THEN '5.9' WHEN c_custkey % 3 = 1 THEN '0' END",
    "master_ram": "CASE WHEN c_custkey % 2 = 0 THEN '32' END",
    "master_cores": "CASE WHEN c_custkey % 2 = 0 THEN '8' ELSE '-1' END",
    "dyn_min": "CASE WHEN c_custkey % 2 = 0 THEN '3' END",
    "dyn_init": "CASE WHEN c_custkey % 3 = 0 THEN '6 executors' END",
    "dyn_idle": "CASE WHEN c_custkey % 2 = 1 THEN '45s' ELSE '' END",
    "enf_c": "CASE WHEN c_custkey % 4 = 0 THEN 'true' END",
    "enf_m": "CASE WHEN c_custkey % 5 = 0 THEN 'true' ELSE 'false' END",
    "aqe": "CASE WHEN c_custkey % 2 = 0 THEN 'true' END",
    "dyn_alloc": "'false'",
    "pyspark": "CASE WHEN c_custkey % 3 = 0 THEN 'true' END",
    "workload": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) END",
    "rm": "CASE WHEN c_custkey % 3 = 1 THEN '' WHEN c_custkey % 3 = 0 THEN 'k8s' END",
    "sv": "CASE WHEN c_custkey % 3 = 1 THEN '4.0' ELSE '' END",
    "storage": "CASE WHEN c_custkey % 3 = 1 THEN 's3' END",
    "deploy_mode": "CASE WHEN c_custkey % 2 = 0 THEN 'client' ELSE 'cluster' END",
    "scheduler": "'fair'",
}

RESERVATIONS = {
    "cluster_id": "o_custkey",
    "job_id": "l_orderkey",
    # Some names repeat, also under another spelling of the same slug.
    "name": "CASE WHEN l_orderkey % 10 = 0 THEN concat('Nightly  ETL ', CAST(l_orderkey AS VARCHAR(19)))"
            " WHEN l_orderkey % 10 = 5 THEN 'nightly etl' WHEN l_orderkey % 10 = 3 THEN 'Nightly ETL' END",
    "exec_count": "CAST(1 + n_lines % 2 AS DOUBLE)",
    "exec_cores": "CAST(2 + parts % 4 AS DOUBLE)",
    "exec_mem_gb": "CAST(4 + supps % 12 AS DOUBLE)",
}
# All lines of an order make one reservation.
ORDER_LINES = {"n_lines": "count(*)", "parts": "sum(l_partkey)", "supps": "sum(l_suppkey)"}

# Order keys are numbered from 1 and stay below 2**40 at any scale of the tables.
ORDER_KEY_BITS = 40

# Some shares are typed out of range.
JOB_MANUAL_PCT = "CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(CASE o_orderkey % 41 WHEN 0 THEN -1 WHEN 1 THEN 150" \
                 " ELSE 5 + o_orderkey % 20 END AS INT) END"

# Shares over a wide range, which bring out where the two rounding bases part.
WIDE_MANUAL_PCT = "CASE WHEN o_orderkey % 3 < 2 THEN CAST(1 + o_orderkey % 60 AS INT) END"

USAGE_SAMPLES = {
    "sample_id": "event_id", "cluster_id": "user_id", "ts": "ts",
    "metric": "CASE event_type WHEN 'click' THEN 'core_util' WHEN 'view' THEN 'mem_util'"
              " WHEN 'signup' THEN 'gc_pct' WHEN 'purchase' THEN 'spill_gb' ELSE 'evictions' END",
    "value": "value",
}

TASK_METRICS = {
    **USAGE_SAMPLES,
    "metric": "CASE event_type WHEN 'click' THEN 'task_ms' WHEN 'view' THEN 'cache_hit_pct'"
              " WHEN 'signup' THEN 'gc_pct' WHEN 'purchase' THEN 'spill_gb' ELSE 'evictions' END",
}

OVERRIDE_LOG = {
    "seq": "event_id", "cluster_id": "user_id", "ts": "ts",
    "field": "CASE event_type WHEN 'click' THEN 'execC' WHEN 'view' THEN 'execPN'"
             " WHEN 'signup' THEN 'execM' ELSE 'drvM' END",
    "is_reset": "event_type = 'error'",
    "value": "CASE WHEN event_type <> 'error' THEN CAST(1 + event_id % 16 AS DOUBLE) END",
}

MUTE_LOG = {"cluster_id": "user_id", "seq": "event_id", "ts": "ts", "muted": "event_id % 2 = 0"}

ALERT_KEYS = {
    "cluster_id": "user_id", "seq": "event_id", "ts": "ts",
    "alert_key": "CASE WHEN value > 40 THEN concat(event_type, '|OE') WHEN value > 20"
                 " THEN event_type ELSE '' END",
}

SPEC_CHANGES = {
    "cluster_id": "user_id", "seq": "event_id", "ts": "ts",
    "nodes": "CAST(1 + event_id % 60 AS DOUBLE)",
    "cpn": "CAST(4 + event_id % 61 AS DOUBLE)",
    "rpn": "CAST(16 + event_id % 241 AS DOUBLE)",
    "workload": "CASE event_type WHEN 'click' THEN 'ml' WHEN 'view' THEN 'streaming' ELSE 'etl' END",
    "rm": "CASE event_id % 3 WHEN 0 THEN 'yarn' WHEN 1 THEN 'k8s' ELSE 'local' END",
    "deploy_mode": "CASE WHEN event_id % 2 = 0 THEN 'client' ELSE 'cluster' END",
}

# Spans in which a cluster is muted: they overlap, and some stay open.
MUTE_SPANS = {
    "cluster_id": "user_id", "ts": "ts",
    "until": "CASE WHEN event_id % 17 > 0 THEN ts + INTERVAL '1' HOUR * CAST(event_id % 50 AS INT) END",
}

# Weights that are no whole percents, many of them equal, and more jobs than a small pool has executors.
REAL_WEIGHT = "CASE WHEN o_orderkey % 4 = 0 THEN 12.5 WHEN o_orderkey % 11 = 0 THEN 0.0" \
              " ELSE CAST(o_orderkey % 9973 AS DOUBLE) / 413 END"

# Edits of reservations and jobs: of every eight events two add an entry, and the others edit these.
EDIT_ENTRY = "event_id - event_id % 4"
EDIT_CLUSTER = "1 + CAST((event_id - event_id % 4) / 4 AS BIGINT) % 60"
RESERVATION_EDITS = {
    "cluster_id": EDIT_CLUSTER, "ts": "ts", "seq": "event_id", "entry": EDIT_ENTRY,
    "op": "CASE WHEN event_id % 4 = 0 THEN 'add' WHEN event_id % 8 = 7 THEN 'remove' ELSE 'update' END",
    "name": "CASE WHEN event_id % 12 = 0 THEN 'Nightly ETL' WHEN event_id % 4 = 2 THEN concat('Load ', CAST(event_id % 5 AS VARCHAR(9))) END",
    "exec_count": "CAST(CASE WHEN event_id % 4 IN (0, 1) THEN 1 + event_id % 3 END AS DOUBLE)",
    "exec_cores": "CAST(CASE WHEN event_id % 4 IN (0, 3) THEN 2 + event_id % 5 END AS DOUBLE)",
    "exec_mem_gb": "CAST(CASE WHEN event_id % 4 = 0 THEN 4 + event_id % 12 END AS DOUBLE)",
}
JOB_EDITS = {
    "cluster_id": EDIT_CLUSTER, "ts": "ts", "seq": "event_id", "entry": EDIT_ENTRY,
    "op": "CASE WHEN event_id % 4 = 0 THEN 'add' WHEN event_id % 16 = 7 THEN 'remove' WHEN event_id % 4 = 3 THEN 'reset' ELSE 'update' END",
    "manual_pct": "CAST(CASE WHEN event_id % 4 IN (1, 2) THEN event_id % 23 END AS INT)",
}

# Candidate specs; a null keeps the cluster's own value.
CANDIDATES = {
    "variant": "s_suppkey",
    "nodes": "CAST(CASE WHEN s_suppkey % 3 > 0 THEN 1 + s_suppkey % 97 END AS DOUBLE)",
    "rpn": "CAST(CASE WHEN s_suppkey % 4 = 0 THEN 32 + s_suppkey % 200 END AS DOUBLE)",
    "workload": "CASE s_nationkey % 4 WHEN 0 THEN 'ml' WHEN 1 THEN 'streaming' END",
    "deploy_mode": "CASE WHEN s_nationkey % 5 = 0 THEN 'cluster' END",
}

# A policy of many bands, beside the reference's five: bounds are met exactly, from below and from above.
BAND_LADDER = {
    "policy": "'ladder'", "low": "CAST(CASE WHEN n_nationkey > 0 THEN n_nationkey * 4 END AS DOUBLE)",
    "above": "n_nationkey % 2 = 1", "band": "concat('step ', CAST(n_nationkey AS VARCHAR(9)))",
}

# How late an event of the stream may arrive.
ARRIVAL_LAG_SECONDS = 1800

# Four properties per cluster: usable, without value, without key, and with a very long key.
CUSTOM_PROPS = [
    ("0", "'spark.app.team'", "concat('team-', CAST(c_nationkey AS VARCHAR(9)))"),
    ("1", "'spark.app.note'", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END"),
    ("2", "CASE WHEN c_custkey % 3 = 0 THEN 'spark.app.owner' ELSE '' END", "c_name"),
    ("3", "'spark.hadoop.fleet.connector.very.long.property.name.limit'", "'64'"),
]


# Shared links with some parameters missing, empty, encoded or behind a fragment.
SHARE_LINK = (
    "concat('https://fleet.example/plan?', CASE c0 WHEN 0 THEN 'n=12&c=8&r=48.5&m=cluster&w=ml'"
    " WHEN 1 THEN 'n=&c=24&w=streaming' WHEN 2 THEN 'm=client&w=big%20graph&n=7'"
    " WHEN 3 THEN 'x=1&r=abc&c=2%2E5' WHEN 4 THEN 'w=a+b&m=' WHEN 5 THEN 'n=3#c=9'"
    " WHEN 6 THEN 'n=12&w=ml&q=a b' ELSE 'q={x}&c=6&m=cluster' END)"
).replace("c0", "cluster_id % 8")
ANY_RM = "CASE WHEN cluster_id % 7 = 0 THEN '' WHEN cluster_id % 11 = 0 THEN 'nomad' ELSE rm END"
ANY_WORKLOAD = "CASE WHEN cluster_id % 7 = 0 THEN 'olap' ELSE workload END"


# Columns the fixtures use, as stored; naming them spares reading the footers up front.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "pages": "page_id bigint, url string",
    "nation": "n_nationkey int, n_name string",
    "supplier": "s_suppkey bigint, s_nationkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def clusters(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "customer"), CLUSTERS)


def raw_specs(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "customer"), RAW_SPECS)


def jobs(spark, sf_dir, manual_pct: str = JOB_MANUAL_PCT) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS cluster_id", "o_orderkey AS job_id", f"{manual_pct} AS manual_pct")
    return positions(orders, ["cluster_id"], "job_id", ["job_id"], "job_idx", id_bits=ORDER_KEY_BITS)


def reservations(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *[F.expr(expr).alias(name) for name, expr in ORDER_LINES.items()])
    orders = table(spark, sf_dir, "orders")
    return _project(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), RESERVATIONS)


def numbered_reservations(spark, sf_dir) -> DataFrame:
    """Reservations with their position in the cluster."""
    return number_reservations(reservations(spark, sf_dir))


def number_reservations(rows: DataFrame) -> DataFrame:
    return positions(rows, ["cluster_id"], "job_id", ["job_id"], "res_idx", id_bits=ORDER_KEY_BITS)


def usage_samples(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), USAGE_SAMPLES)


def task_metrics(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), TASK_METRICS)


def override_log(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), OVERRIDE_LOG)


def mute_log(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "events").filter("event_type = 'error'"), MUTE_LOG)


def mute_spans(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "events").filter("event_type = 'error'"), MUTE_SPANS)


def weighted_jobs(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS cluster_id", "o_orderkey AS job_id", f"CAST({REAL_WEIGHT} AS DOUBLE) AS weight")
    return positions(orders, ["cluster_id"], "job_id", ["job_id"], "job_idx", id_bits=ORDER_KEY_BITS)


def reservation_edits(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), RESERVATION_EDITS)


def job_edits(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), JOB_EDITS)


def candidate_grid(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "supplier"), CANDIDATES)


def band_ladder(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "nation"), BAND_LADDER)


def alert_keys(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), ALERT_KEYS)


def spec_changes(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), SPEC_CHANGES)


def custom_props(spark, sf_dir, dealt: bool = False) -> DataFrame:
    """The properties of each cluster; `dealt` spreads the clusters over tasks first, as a small file is one task."""
    rows = ", ".join(f"struct({pos} AS pos, {key} AS key, {val} AS val)"
                     for pos, key, val in CUSTOM_PROPS)
    owners = table(spark, sf_dir, "customer")
    exploded = (owners.repartition("c_custkey") if dealt else owners).selectExpr(
        "c_custkey AS cluster_id", f"explode(array({rows})) AS p")
    return exploded.select("cluster_id", "p.pos", "p.key", "p.val")


def event_stream(spark, sf_dir, columns: dict[str, str]) -> DataFrame:
    """The events as a stream, in the columns of one of the logical tables.

    The table may be one file or a folder of files; a pattern takes either. Files need not be slices of time:
    a run over what the table holds now reads all of them in one micro-batch, so that no event comes late.
    """
    source = spark.readStream.schema(SCHEMAS["events"])
    return _project(source.parquet(f"{sf_dir}/events.parque[t]"), columns)


def arrivals(spark, sf_dir, slices: int = 5) -> list[DataFrame]:
    """The events in slices of the time they arrive, up to half an hour after their own time and out of order."""
    events = table(spark, sf_dir, "events")
    first, last = events.selectExpr("unix_seconds(CAST(min(ts) AS TIMESTAMP))", "unix_seconds(CAST(max(ts) AS TIMESTAMP))").first()
    width = max(1, -(-((last or 0) - (first or 0) + ARRIVAL_LAG_SECONDS + 1) // slices))
    due = f"unix_seconds(CAST(ts AS TIMESTAMP)) + pmod(event_id * 37L, {ARRIVAL_LAG_SECONDS}L) - {first or 0}L"
    return [events.filter(f"({due}) DIV {width} = {i}") for i in range(slices)]
