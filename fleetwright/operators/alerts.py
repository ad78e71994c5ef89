"""Alerts that remember what was already shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.operators.slices import BUCKET_SECONDS, ordered_scan, spans_at

HOT_LIMIT = 95.0


def too_hot(limit: float = HOT_LIMIT) -> Column:
    return F.col("value") > limit


def edge_alerts(samples: DataFrame, condition: Column | None = None,
                keys: tuple[str, ...] = ("cluster_id", "metric"),
                bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The samples at which a condition turns true; it re-arms when the condition ends."""
    condition = condition if condition is not None else too_hot()
    marked = samples.withColumn("_on", F.coalesce(condition, F.lit(False)))
    seen = ordered_scan(marked, list(keys), ["ts", "sample_id"], lag={"_was_on": "_on"},
                        bucket_seconds=bucket_seconds)
    return seen.filter(F.col("_on") & ~F.coalesce("_was_on", F.lit(False))).drop("_on", "_was_on")


def raises_alert(key: Column) -> Column:
    """A key that only reports missing task slots shows nothing and re-arms."""
    return (F.length(key) > 0) & (key != "OC")


def change_alerts(keys: DataFrame, mute_log: DataFrame | None = None,
                  bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The rows whose alert key differs from the one last shown; silent keys re-arm.

    While a cluster is muted nothing is shown and the remembered key stays as it was.
    """
    heard = keys if mute_log is None else _unmuted(keys, "seq", ["alert_key"], mute_log, bucket_seconds).drop("span")
    shown = heard.withColumn("_shown", F.when(raises_alert(F.col("alert_key")), F.col("alert_key"))
                             .otherwise(F.lit("")))
    seen = ordered_scan(shown, ["cluster_id"], ["ts", "seq"], lag={"_before": "_shown"},
                        bucket_seconds=bucket_seconds)
    return seen.filter(
        (F.col("_shown") != "") & (F.col("_shown") != F.coalesce("_before", F.lit("")))
    ).drop("_shown", "_before")


def _unmuted(rows: DataFrame, seq: str, values: list[str], mute_log: DataFrame, bucket_seconds: int) -> DataFrame:
    """The rows at whose time their cluster is not muted, with the number of mutings before (`span`).

    Rows and switches are merged into one time line per cluster; a switch comes before
    rows of the same time.
    """
    types = dict(rows.dtypes)
    switches = mute_log.select(
        "cluster_id", "ts", F.col("seq").alias(seq), F.lit(0).alias("_kind"),
        F.col("muted").alias("_muted"), F.col("muted").cast("bigint").alias("_off"),
        *[F.lit(None).cast(types[v]).alias(v) for v in values])
    readings = rows.select(
        "cluster_id", "ts", seq, F.lit(1).alias("_kind"), F.lit(None).cast("boolean").alias("_muted"),
        F.lit(0).cast("bigint").alias("_off"), *values)
    line = ordered_scan(
        switches.unionByName(readings), ["cluster_id"], ["ts", "_kind", seq],
        last={"_state": "_muted"}, total={"span": "_off"}, bucket_seconds=bucket_seconds)
    heard = line.filter((F.col("_kind") == 1) & ~F.coalesce("_state", F.lit(False)))
    return heard.select("cluster_id", seq, "ts", *values, "span")


def muted_alerts(samples: DataFrame, mute_log: DataFrame, condition: Column | None = None,
                 bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Edge alerts while not muted; muting forgets everything shown before.

    The number of mutings before a sample becomes part of the alert key, so a condition
    still true after unmuting fires again.
    """
    heard = _unmuted(samples, "sample_id", ["metric", "value"], mute_log, bucket_seconds)
    return edge_alerts(heard, condition, ("cluster_id", "metric", "span"), bucket_seconds)


def span_alerts(samples: DataFrame, spans: DataFrame, condition: Column | None = None,
                bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """R6 over rows of mute spans (cluster_id, ts, until) instead of switches.

    Spans may overlap and stay open. A sample is muted while any span of its cluster is open; every span that
    begins forgets what was shown.
    """
    seen = spans_at(samples, spans, ["cluster_id"], "sample_id", bucket_seconds=bucket_seconds)
    heard = seen.filter("open_spans <= 0").drop("open_spans").withColumnRenamed("begun_spans", "span")
    return edge_alerts(heard, condition, ("cluster_id", "metric", "span"), bucket_seconds)
