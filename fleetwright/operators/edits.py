"""Reservations and jobs as logs of edits, folded into their current rows.

An `add` makes an entry of a cluster and gives it the cluster's next number; an `update` sets the fields that it
names; a `reset` clears the fields that can be; a `remove` takes the entry away for good, and its number is not used
again. Fields are settled by the last edit that sets them, and edits before the `add` of their entry do nothing.
Numbers are counted by slices of time and entries fold by key, so a busy cluster is shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.operators.slices import BUCKET_SECONDS, ordered_scan, positions


def fold_edits(log: DataFrame, fields: list[str], number: str, index: str, cleared: tuple[str, ...] = (),
               bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The current entries (cluster_id, entry, `number`, `index`, fields) of a log.

    `log` has cluster_id, ts, seq (which decides between edits of one time), op, entry, which names an entry within
    its cluster, and the fields, null where an edit does not set them. `number` counts the cluster's adds from 1,
    removed ones too; `index` is the place among those that are left, from 0. Of several adds of an entry the first
    counts as such, the others as updates.
    """
    at = F.struct("ts", "seq")
    adds = log.filter("op = 'add'").groupBy("cluster_id", "entry").agg(F.min(at).alias("added"))
    counted = ordered_scan(adds.select("cluster_id", "entry", "added.*").withColumn("_one", F.lit(1).cast("bigint")),
                           ["cluster_id"], ["ts", "seq"], total={number: "_one"}, bucket_seconds=bucket_seconds)
    born = counted.select("cluster_id", "entry", number, at.alias("added"))
    live = log.join(born, ["cluster_id", "entry"]).filter(at >= F.col("added"))

    def settled(field: str):
        sets = F.col(field).isNotNull() | (F.col("op") == "reset" if field in cleared else F.lit(False))
        value = F.when(F.col("op") != "reset", F.col(field)) if field in cleared else F.col(field)
        return F.max_by(F.struct(value.alias("value")), F.when(sets, at)).alias(f"_{field}")

    folded = live.groupBy("cluster_id", "entry").agg(
        F.any_value(number).alias(number), F.expr("count_if(op = 'remove')").alias("_removed"), *[settled(f) for f in fields])
    left = folded.filter("_removed = 0").select("cluster_id", "entry", number, *[F.col(f"_{f}.value").alias(f) for f in fields])
    return positions(left, ["cluster_id"], number, [number], index).select("cluster_id", "entry", number, index, *fields)


def reservations_from(log: DataFrame, **options) -> DataFrame:
    """Current reservations, named by their number where they have no name of their own."""
    return fold_edits(log, ["name", "exec_count", "exec_cores", "exec_mem_gb"], "res_no", "res_idx", **options)


def jobs_from(log: DataFrame, **options) -> DataFrame:
    """Current jobs; a reset makes a job's share automatic again."""
    return fold_edits(log, ["manual_pct"], "job_no", "job_idx", ("manual_pct",), **options).withColumnRenamed("entry", "job_id")
