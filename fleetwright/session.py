"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fleetwright", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Wide plans have more generated classes than the default cache keeps.
        "spark.sql.codegen.cache.maxEntries": "4000",
        # Recording the call site of every column costs driver time in wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, else one under the session's warehouse.

    On a cluster a warehouse on a machine's own disk is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        own_disk = "://" not in named.replace("file:///", "") or named.startswith("file:")
        if own_disk and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"executors do not share {named}: set spark.checkpoint.dir to a folder that they share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's stored stages."""
    return f"{shared_dir(spark).rstrip('/')}/stages-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own among the application's stored stages."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_stored(spark: SparkSession) -> None:
    """Remove all stages that this application has stored, once their results have been written or read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again, so that several readers share one computation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
