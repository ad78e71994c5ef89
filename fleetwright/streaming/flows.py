"""Streams of edits, specs, alerts and usage samples (V1-V4, R5, R6) and their batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwright.functions.bands import band
from fleetwright.operators.alerts import raises_alert, too_hot
from fleetwright.operators.sizing import size_fleet
from fleetwright.schema import OVERRIDE_FIELDS
from fleetwright.operators.slices import BUCKET_SECONDS, time_slice
from fleetwright.streaming.reorder import changes_unmuted, in_event_order, turns_on, turns_on_unmuted

# Fixed value: pause after the last edit before results are recomputed.
DEBOUNCE_GAP = "55 milliseconds"


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; the tables carry TIMESTAMP_NTZ in UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _burst(value: list[str], seq: str) -> list[Column]:
    at = F.struct("ts", seq)
    return [F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            F.count(F.lit(1)).alias("edits"),
            *[F.max_by(v, at).alias(v) for v in value]]


def debounce(stream: DataFrame, key: str, value: list[str], seq: str, gap: str = DEBOUNCE_GAP,
             late: str = "1 hour") -> DataFrame:
    """V1: the last value of each burst of edits; every edit restarts the gap."""
    return (
        with_event_time(stream).withWatermark("ts", late)
        .groupBy(key, F.session_window("ts", gap))
        .agg(*_burst(value, seq)).drop("session_window")
    )


def debounce_batch(df: DataFrame, key: str, value: list[str], seq: str, gap: str = DEBOUNCE_GAP,
                   bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """V1 over a finished table; a burst ends when the next edit comes later than the gap.

    Edits move once, to their slice of time, and become parts of bursts there; what goes on over the edges of
    slices is settled on these parts.
    """
    longer, at = F.expr(f"INTERVAL {gap}"), F.struct("ts", seq)
    inside = Window.partitionBy(key, "_slice").orderBy("ts", seq)
    cut = df.select(key, "ts", seq, *[v for v in value if v not in (key, "ts", seq)], F.expr(time_slice("ts", bucket_seconds)).alias("_slice"))
    begins = F.coalesce(F.col("ts") - F.lag("ts").over(inside) > longer, F.row_number().over(inside) > 1)
    marked = cut.withColumn("_begins", begins.cast("bigint"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = marked.withColumn("_part", F.sum("_begins").over(so_far)).groupBy(key, "_slice", "_part").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("edits"),
        F.max(at).alias("_at"), F.max_by(F.struct(*value), at).alias("_last"))
    slices = parts.groupBy(key, "_slice").agg(
        F.min("first_ts").alias("_first"), F.max("last_ts").alias("_end"), F.max("_part").alias("_more"))
    by_slice = Window.partitionBy(key).orderBy("_slice")
    opens = F.coalesce(F.col("_first") - F.lag("_end").over(by_slice) > longer, F.lit(True)).cast("bigint")
    opened = slices.withColumn("_opens", opens)
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    numbered = opened.select(key, "_slice", (
        F.sum("_opens").over(by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        + F.coalesce(F.sum("_more").over(before), F.lit(0))).alias("_start"))
    whole = parts.join(numbered, [key, "_slice"]).groupBy(key, (F.col("_start") + F.col("_part")).alias("_burst"))
    return whole.agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("edits").alias("edits"),
                     F.max_by("_last", "_at").alias("_last")).select(key, "first_ts", "last_ts", "edits", "_last.*")


SPEC_FIELDS = ["nodes", "cpn", "rpn", "workload", "rm", "deploy_mode"]


def latest_spec(changes: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """V2: the newest spec per cluster, sized; works on a table and, in update mode, on a stream.

    The only state is one spec per cluster. Sizing adds columns and keeps none.
    """
    fields = fields or SPEC_FIELDS
    newest = changes.groupBy("cluster_id").agg(
        F.max_by(F.struct(*fields), F.struct("ts", "seq")).alias("_spec"))
    return size_fleet(newest.select("cluster_id", "_spec.*"))


def overridden_spec(changes: DataFrame, overrides: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """V2 under P5: the newest spec per cluster with its overrides in force, sized.

    Both change logs are merged into one state per cluster, the last entry by (ts, seq) of the spec and of each
    field; a reset is kept as such, so that an older value that comes late does not return. Works on tables and,
    in update mode, on streams: a micro-batch gives the clusters it touches. Clusters without a spec wait for one.
    """
    fields = fields or SPEC_FIELDS
    at = F.struct("ts", "seq")
    nothing = F.lit(None)
    types = {**dict(changes.dtypes), **dict(overrides.dtypes)}
    specs = changes.select("cluster_id", "ts", "seq", F.struct(*fields).alias("spec"),
                           nothing.cast("string").alias("field"), nothing.cast("boolean").alias("is_reset"),
                           nothing.cast(types["value"]).alias("value"))
    entries = overrides.select("cluster_id", "ts", "seq", nothing.cast(specs.schema["spec"].dataType).alias("spec"),
                               "field", "is_reset", "value")
    newest = specs.unionByName(entries).groupBy("cluster_id").agg(
        F.max_by("spec", F.when(F.col("spec").isNotNull(), at)).alias("spec"),
        *[F.max_by(F.struct("is_reset", F.coalesce("value", F.lit(0.0)).alias("value")),
                   F.when(F.col("field") == field, at)).alias(f"set_{column}")
          for field, column in OVERRIDE_FIELDS.items()])
    settled = newest.filter("spec IS NOT NULL").select("cluster_id", "spec.*", *[
        F.expr(f"IF(set_{c}.is_reset, NULL, set_{c}.value) AS set_{c}") for c in OVERRIDE_FIELDS.values()])
    return size_fleet(settled)


EDGE_COLUMNS = ["cluster_id", "metric", "sample_id", "ts", "value"]
LATE = "1 hour"


def edge_alerts_stream(stream: DataFrame, condition: Column | None = None, keys: tuple[str, ...] = ("cluster_id", "metric"),
                       late: str = LATE, forget_ms: int | None = None) -> DataFrame:
    """V3: R4 on a stream, in the order of event time.

    A sample is judged when the watermark has passed it, so those late within the allowance count. Only keys
    whose condition holds, or that have samples waiting, have state.
    """
    condition = condition if condition is not None else too_hot()
    marked = with_event_time(stream).withColumn("is_on", F.coalesce(condition, F.lit(False)))
    columns = [c for c in ("metric", "value", "is_on") if c not in keys]
    return in_event_order(marked, list(keys), ["sample_id"], columns, turns_on, EDGE_COLUMNS, late=late, forget_ms=forget_ms)


def _with_switches(rows: DataFrame, seq: str, values: list[str], mutes: DataFrame) -> DataFrame:
    """Rows and mute switches of one time line; a switch comes before rows of the same time."""
    types = dict(rows.dtypes)
    switches = with_event_time(mutes).select(
        "cluster_id", "ts", F.lit(0).alias("kind"), F.col("seq").alias(seq), "muted",
        *[F.lit(None).cast(types[v]).alias(v) for v in values])
    return switches.unionByName(with_event_time(rows).select(
        "cluster_id", "ts", F.lit(1).alias("kind"), seq, F.lit(None).cast("boolean").alias("muted"), *values))


def muted_alerts_stream(samples: DataFrame, mutes: DataFrame, condition: Column | None = None, late: str = LATE) -> DataFrame:
    """R6 on a stream of samples and a control stream of mute switches, joined in event time."""
    condition = condition if condition is not None else too_hot()
    marked = samples.withColumn("is_on", F.coalesce(condition, F.lit(False)))
    line = _with_switches(marked, "sample_id", ["metric", "value", "is_on"], mutes)
    return in_event_order(line, ["cluster_id"], ["kind", "sample_id"], ["muted", "metric", "value", "is_on"],
                          turns_on_unmuted, EDGE_COLUMNS, {"span": "long"}, late)


def change_alerts_stream(alert_keys: DataFrame, mutes: DataFrame, late: str = LATE) -> DataFrame:
    """R5 on a stream of alert keys and a control stream of mute switches, joined in event time."""
    key = F.col("alert_key")
    marked = alert_keys.withColumn("shown", F.when(raises_alert(key), key).otherwise(F.lit("")))
    line = _with_switches(marked, "seq", ["alert_key", "shown"], mutes)
    return in_event_order(line, ["cluster_id"], ["kind", "seq"], ["muted", "alert_key", "shown"], changes_unmuted,
                          ["cluster_id", "seq", "ts", "alert_key"], late=late)


def run_to_table(stream: DataFrame, root: str) -> DataFrame:
    """Run a stream in append mode over what its source holds now, into a stored table."""
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/rows")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def run_in_steps(arrivals: list[DataFrame], streams, root: str) -> DataFrame:
    """Run a stream that is stopped after each part of its input has arrived, and started again from its checkpoint.

    `streams` builds the stream from a function that reads the arrived rows as one; append mode.
    """
    spark = arrivals[0].sparkSession

    def arrived() -> DataFrame:
        return spark.readStream.schema(arrivals[0].schema).parquet(f"{root}/arrived")

    out = None
    for part in arrivals:
        part.write.mode("append").parquet(f"{root}/arrived")
        out = run_to_table(streams(arrived), root)
    return out


def run_updates(stream: DataFrame, keys: list[str], root: str) -> DataFrame:
    """Run a stream in update mode over what its source holds now; the last update of each key."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    query = (stream.writeStream.outputMode("update").foreachBatch(keep)
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(f"{root}/rows")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return newest.select(*keys, "_last.*").select(*stream.columns)


def usage_windows(samples: DataFrame, width: str = "6 hours", slide: str = "3 hours",
                  late: str | None = None) -> DataFrame:
    """V4: average and peak of each metric per time window, with its band.

    Values count in millionths, so the sum does not depend on the order of arrival. Pass
    `late` (a watermark) for a stream.
    """
    if late is not None:
        samples = with_event_time(samples).withWatermark("ts", late)
    millionths = F.sum(F.round(F.col("value") * 1e6, 0).cast("bigint"))
    grouped = samples.groupBy("cluster_id", "metric", F.window("ts", width, slide)).agg(
        F.count(F.lit(1)).alias("samples"),
        (millionths.cast("double") / F.count(F.lit(1)) / 1e6).alias("average"),
        F.max("value").alias("peak"))
    return grouped.select(
        "cluster_id", "metric", F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"), "samples", "average", "peak",
        F.expr(band("standard", "average")).alias("band"))
