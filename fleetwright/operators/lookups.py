"""Dictionary lookups and override resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright import schema
from fleetwright.functions.columns import derive


def apply_templates(clusters: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """A named template replaces node count, cores and memory; other names change nothing."""
    templates = templates if templates is not None else schema.template_dim(clusters.sparkSession)
    fields = ["nodes", "cpn", "rpn"]
    dim = templates.selectExpr("template", *[f"CAST({f} AS DOUBLE) AS _t_{f}" for f in fields])
    joined = derive(clusters.join(dim, "template", "left"),
                    {f: f"coalesce(_t_{f}, CAST({f} AS DOUBLE))" for f in fields})
    return joined.drop(*[f"_t_{f}" for f in fields])


def resolve_rm_reserve(clusters: DataFrame, rm_dim: DataFrame | None = None) -> DataFrame:
    """GB per node kept for the resource manager.

    Blank or zero takes the manager's default, a disabled manager is forced to zero and an
    unknown one behaves as yarn.
    """
    rm_dim = rm_dim if rm_dim is not None else schema.rm_dim(clusters.sparkSession)
    yarn = next(reserve for name, reserve, _ in schema.RM_RESERVES if name == "yarn")
    dim = rm_dim.selectExpr("rm", "CAST(default_reserve AS DOUBLE) AS _default",
                            "disabled AS _disabled")
    named = derive(clusters, {"rm": "coalesce(nullif(rm, ''), 'yarn')"})
    return derive(named.join(dim, "rm", "left"), {
        "rm_r": "IF(coalesce(_disabled, false), 0D, coalesce(nullif(CAST(rm_r AS DOUBLE), 0D),"
                f" _default, {float(yarn)}D))"}).drop("_default", "_disabled")


def scheduler_label(scheduler: str = "scheduler") -> str:
    return f"IF(lower({scheduler}) IN ('fair', 'fifo', 'capacity'), upper({scheduler}), 'FAIR')"


def label_dims(clusters: DataFrame, workload_dim: DataFrame | None = None) -> DataFrame:
    """Display labels; an unknown workload shows its own key."""
    dim = workload_dim if workload_dim is not None else schema.workload_dim(clusters.sparkSession)
    dim = dim.selectExpr("workload", "label AS _label")
    return derive(clusters.join(dim, "workload", "left"), {
        "workload_label": "coalesce(_label, workload)",
        "mode_label": "upper(deploy_mode)",
        "rm_label": "upper(rm)",
        "scheduler_label": scheduler_label(),
        "version_label": "concat('Spark ', sv)",
    }).drop("_label")


def merge_custom_props(props: DataFrame, mode: str) -> DataFrame:
    """The cluster file keeps rows with key and value, a job file needs only the key."""
    keep = "length(key) > 0" + (" AND length(val) > 0" if mode == "cluster" else "")
    return derive(props.filter(keep), {"val": "coalesce(val, '')"})


def apply_overrides(log: DataFrame) -> DataFrame:
    """P5: nine nullable columns per cluster, the latest entry of each field, resets as null.

    One aggregation with nine filtered states instead of a pivot: one shuffle, combined
    on the map side, so a cluster with a very long log costs one row per input task.
    """
    latest = [
        "max_by(struct(is_reset, coalesce(value, 0D) AS value), struct(ts, seq))"
        f" FILTER (WHERE field = '{field}') AS {column}"
        for field, column in schema.OVERRIDE_FIELDS.items()
    ]
    states = log.groupBy("cluster_id").agg(*[F.expr(state) for state in latest])
    return states.selectExpr("cluster_id", *[
        f"IF({c}.is_reset, NULL, {c}.value) AS set_{c}" for c in schema.OVERRIDE_FIELDS.values()])

