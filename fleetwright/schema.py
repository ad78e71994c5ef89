"""Field lists, defaults and the fixed dictionaries of the data model.

Every quantity is a DOUBLE: the reference model has one number type, and overrides
and reserves may be fractional. Identifiers and positions are BIGINT or INT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fleetwright.functions.bands import policy_rows
from fleetwright.functions.columns import derive

# Reset defaults of a cluster spec.
NUMBER_DEFAULTS = {
    "nodes": 10.0, "cpn": 16.0, "rpn": 64.0, "os_r": 2.0, "rm_r": 0.0, "os_cr": 1.0,
    "min_ec": 4.0, "min_em": 8.0, "mf": 0.6, "sf": 0.5, "num_jobs": 2.0,
    "master_ram": 16.0, "master_cores": 4.0, "dyn_min": 1.0, "dyn_init": 4.0, "dyn_idle": 60.0,
}
FLAG_DEFAULTS = {"enf_c": False, "enf_m": False, "aqe": True, "dyn_alloc": False, "pyspark": False}
TEXT_DEFAULTS = {
    "workload": "etl", "rm": "yarn", "sv": "3.5", "storage": "hdfs",
    "deploy_mode": "client", "scheduler": "fair",
}

# The nine derived fields a user may set by hand.
OVERRIDE_FIELDS = {
    "execC": "exec_c", "execPN": "exec_pn", "execM": "exec_m", "execOH": "exec_oh",
    "drvM": "drv_m", "drvC": "drv_c", "para": "para", "shufP": "shuf_p", "dynMax": "dyn_max",
}

# Node count, cores per node and GB per node of the named templates.
TEMPLATES = [
    ("small", 4, 8, 32), ("medium", 10, 16, 64), ("large", 20, 32, 128), ("xlarge", 50, 64, 256),
    ("emr", 10, 16, 64), ("databricks", 8, 16, 56), ("hdp", 12, 24, 96),
]

# GB per node kept for each resource manager, and whether it is forced to zero.
RM_RESERVES = [
    ("yarn", 1, False), ("standalone", 1, False), ("k8s", 2, False), ("mesos", 1, False),
    ("local", 0, True),
]

# Short labels of the workload profiles.
WORKLOAD_LABELS = [
    ("etl", "ETL"), ("ml", "ML/AI"), ("streaming", "STREAM"), ("interactive", "ADHOC"),
    ("graph", "GRAPH"),
]

CLUSTER_SCHEMA = T.StructType(
    [T.StructField("cluster_id", T.LongType(), False)]
    + [T.StructField(name, T.DoubleType()) for name in NUMBER_DEFAULTS]
    + [T.StructField(name, T.BooleanType()) for name in FLAG_DEFAULTS]
    + [T.StructField(name, T.StringType()) for name in TEXT_DEFAULTS]
)

JOB_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.LongType(), False),
    T.StructField("job_id", T.LongType()),
    T.StructField("job_idx", T.LongType(), False),
    T.StructField("manual_pct", T.IntegerType()),
])

RESERVATION_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.LongType(), False),
    T.StructField("res_idx", T.LongType(), False),
    T.StructField("res_no", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("exec_count", T.DoubleType()),
    T.StructField("exec_cores", T.DoubleType()),
    T.StructField("exec_mem_gb", T.DoubleType()),
])

OVERRIDE_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("field", T.StringType()),
    T.StructField("is_reset", T.BooleanType()),
    T.StructField("value", T.DoubleType()),
])

SAMPLE_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.LongType(), False),
    T.StructField("sample_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


CUSTOM_PROPS_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.LongType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("key", T.StringType()),
    T.StructField("val", T.StringType()),
])

INPUTS = {
    "clusters": CLUSTER_SCHEMA, "jobs": JOB_SCHEMA, "reservations": RESERVATION_SCHEMA,
    "override_log": OVERRIDE_SCHEMA, "usage_samples": SAMPLE_SCHEMA,
    "custom_props": CUSTOM_PROPS_SCHEMA,
}


def read_input(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """One of the logical input tables under its explicit schema, from any file format."""
    return spark.read.schema(INPUTS[name]).format(fmt).options(**options).load(path)


def read_input_stream(spark: SparkSession, name: str, path: str, fmt: str = "parquet",
                      max_files: int = 100, **options) -> DataFrame:
    """The same table as a stream; `max_files` bounds what one micro-batch holds."""
    reader = spark.readStream.schema(INPUTS[name]).format(fmt)
    return reader.options(maxFilesPerTrigger=max_files, **options).load(path)


def _values(spark: SparkSession, rows, columns: str) -> DataFrame:
    # A VALUES list is a local relation of known size, so the planner broadcasts it by itself.
    def literal(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def template_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, TEMPLATES, "template, nodes, cpn, rpn")


def rm_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, RM_RESERVES, "rm, default_reserve, disabled")


def workload_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, WORKLOAD_LABELS, "workload, label")


def policy_dim(spark: SparkSession) -> DataFrame:
    """The reference's band policies as rows that a caller may extend by others."""
    return _values(spark, policy_rows(), "policy, low, above, band").selectExpr(
        "policy", "CAST(low AS DOUBLE) AS low", "above", "band")


def with_defaults(clusters: DataFrame) -> DataFrame:
    """Add the optional spec columns that are missing and type the ones present."""
    have = set(clusters.columns)
    columns = {name: f"CAST({name} AS DOUBLE)" if name in have else f"{value}D"
               for name, value in NUMBER_DEFAULTS.items()}
    for name, value in {**FLAG_DEFAULTS, **TEXT_DEFAULTS}.items():
        default = f"'{value}'" if isinstance(value, str) else str(value).lower()
        columns[name] = f"coalesce({name}, {default})" if name in have else default
    return derive(clusters, columns)
