"""Order-dependent work over groups of any size, in bounded pieces.

A plain window over `cluster_id` puts a whole group into one task. One group may hold a
large part of all rows, so ordered work is always cut into slices that follow from a row's
own values; nothing is measured first and all sizes take the same path:

* `positions` numbers rows by a whole-number id; a slice is a block of ids, so its size
  is bounded by construction. Sparse ids make many small slices; their starts are added up
  block by block in turn, so no window sees more than 2**bits of them.
* `ordered_scan` covers time orders; a slice is a time bucket of fixed width.

In both, a small per-slice summary carries what a slice needs from the ones before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 20
OPEN_BITS = 16
ID_BITS = 64
# Width of a time slice: what one key sends in this time is ordered in one task.
BUCKET_SECONDS = 3600


def slice_of(idx: str, bits: int = SLICE_BITS) -> str:
    return f"shiftright(CAST({idx} AS BIGINT), {bits})"


def spread(one: DataFrame, rows: str, bits: int = SLICE_BITS) -> DataFrame:
    """Repeat each row once per slice of its group (`rows` = rows of the group).

    Joining on (group, slice) instead of (group) then meets no key above 2**bits rows;
    groups that fit one slice are not repeated.
    """
    last = f"greatest(0L, {slice_of(f'{rows} - 1', bits)})"
    return one.selectExpr("*", f"explode(sequence(0L, {last})) AS slice")


def open_positions(df: DataFrame, first: str, count: str, out: str, bits: int = OPEN_BITS,
                   spread_by: list[str] | None = None) -> DataFrame:
    """One row per position `first … first + count - 1`; none where `count` is not positive.

    Positions open in blocks, so no row carries a long array; with `spread_by` the blocks
    of one row are first dealt out to many tasks.
    """
    blocks = df.filter(f"{count} > 0").selectExpr("*", f"explode(sequence(0L, {slice_of(f'{count} - 1', bits)})) AS _block")
    if spread_by:
        blocks = blocks.repartition(*spread_by, "_block")
    low = f"shiftleft(_block, {bits})"
    end = f"least({low} + {1 << bits}L, {count}) - 1"
    return blocks.selectExpr(
        "* EXCEPT (_block)", f"explode(sequence({first} + {low}, {first} + {end})) AS {out}")


def positions(df: DataFrame, group: list[str], id_col: str, order: list[str], out: str,
              weight: str | None = None, bits: int = SLICE_BITS, id_bits: int = ID_BITS) -> DataFrame:
    """0-based position of each row in its group; `weight` counts a row several times.

    `order` must start with `id_col`, a whole number. Ids known to stay below 2**id_bits
    need fewer levels.
    """
    weight_col = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    cut = df.selectExpr("*", f"{slice_of(id_col, bits)} AS _slice")
    counts = cut.groupBy(*group, "_slice").agg(F.sum(weight_col).alias("_n"))
    starts = _starts(counts, group, "_slice", bits, id_bits - bits).select(*group, "_slice", "_start")
    inside = (
        Window.partitionBy(*group, "_slice").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.withColumn("_local", F.sum(weight_col).over(inside) - weight_col)
        .join(starts, [*group, "_slice"])
        .withColumn(out, F.col("_start") + F.col("_local"))
        .drop("_slice", "_start", "_local")
    )


def _starts(counts: DataFrame, group: list[str], at: str, bits: int, left: int) -> DataFrame:
    """Adds `_start`, the sum of `_n` over the earlier slices of the group.

    Slices lie in blocks of 2**SLICE_BITS slice numbers; a block's own start comes from the
    next level, until one block spans all numbers that are left.
    """
    if left <= SLICE_BITS:
        before = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    upper = f"{at}_up"
    blocks = counts.selectExpr("*", f"{slice_of(at, SLICE_BITS)} AS {upper}")
    sums = blocks.groupBy(*group, upper).agg(F.sum("_n").alias("_n"))
    higher = _starts(sums, group, upper, bits, left - SLICE_BITS).select(
        *group, upper, F.col("_start").alias("_higher"))
    inside = Window.partitionBy(*group, upper).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.withColumn("_local", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return local.join(higher, [*group, upper]).withColumn("_start", F.col("_local") + F.col("_higher")).drop(
        upper, "_local", "_higher")


def time_slice(time: str, bucket_seconds: int = BUCKET_SECONDS) -> str:
    """The number of a row's time bucket; rows without a time come before all."""
    return f"coalesce(floor(unix_micros(CAST({time} AS TIMESTAMP)) / {bucket_seconds * 1_000_000}L), -9223372036854775808L)"


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], *,
                 lag: dict[str, str] | None = None, total: dict[str, str] | None = None,
                 last: dict[str, str] | None = None, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Running values per group in a total order that starts with a time.

    `lag` adds the previous row's value, `total` the running sum and `last` the latest
    non-null value up to the row itself, each as {new column: source column}. A lagged
    value that is null counts as no value. Rows without a time come first.
    """
    lag, total, last = lag or {}, total or {}, last or {}
    spec, time = (lag, total, last), order[0]
    cut = df.selectExpr("*", f"{time_slice(time, bucket_seconds)} AS _slice")
    at = F.struct(*order)
    ends = cut.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.max_by(src, at).alias(f"_lag_{out}") for out, src in lag.items()],
        *[F.sum(src).alias(f"_sum_{out}") for out, src in total.items()],
        *[F.max_by(src, F.when(F.col(src).isNotNull(), at)).alias(f"_last_{out}")
          for out, src in last.items()],
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, "_slice",
        *[F.lag(f"_lag_{out}").over(by_slice).alias(f"_lag_{out}") for out in lag],
        *[F.sum(f"_sum_{out}").over(before).alias(f"_sum_{out}") for out in total],
        *[F.last(f"_last_{out}", ignorenulls=True).over(before).alias(f"_last_{out}")
          for out in last],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    local = _window_scan(cut, [*keys, "_slice"], order, spec)
    local = local.withColumn("_first", F.row_number().over(inside) == 1)
    joined = local.join(carry, [*keys, "_slice"])
    joined = joined.withColumns({
        **{out: F.when(F.col("_first"), F.col(f"_lag_{out}")).otherwise(F.col(out)) for out in lag},
        **{out: F.col(out) + F.coalesce(F.col(f"_sum_{out}"), F.lit(0)) for out in total},
        **{out: F.coalesce(F.col(out), F.col(f"_last_{out}")) for out in last},
    })
    return joined.select(*df.columns, *lag, *total, *last)


def spans_at(rows: DataFrame, spans: DataFrame, keys: list[str], seq: str, begin: str = "ts", end: str = "until",
             bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Adds to each row how many spans [begin, end) of its key are open at its `ts`, and how many have begun by then.

    Spans may overlap and be of any length; a span without an end stays open, one without a beginning always
    was, one that ends before it begins is empty but counts as begun. A span is two marks on the time line, and
    what is open enters each slice of time as one sum, so no span is repeated and no key is in one task.
    """
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in (*keys, "ts")]
    begins = spans.select(*keys, F.col(begin).alias("ts"), *rest, F.lit(1).alias("_open"), F.lit(1).alias("_begun"))
    ends = spans.filter(F.col(end).isNotNull()).select(
        *keys, F.greatest(begin, end).alias("ts"), *rest, F.lit(-1).alias("_open"), F.lit(0).alias("_begun"))
    marks = begins.unionByName(ends).withColumn("_kind", F.lit(0))
    own = rows.withColumns({"_open": F.lit(0), "_begun": F.lit(0), "_kind": F.lit(1)})
    line = marks.unionByName(own).withColumns({c: F.col(c).cast("bigint") for c in ("_open", "_begun")})
    seen = ordered_scan(line, keys, ["ts", "_kind", seq], total={"open_spans": "_open", "begun_spans": "_begun"},
                        bucket_seconds=bucket_seconds)
    return seen.filter("_kind = 1").select(*rows.columns, "open_spans", "begun_spans")


def _window_scan(df, keys, order, spec):
    lag, total, last = spec
    ordered = Window.partitionBy(*keys).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({
        **{out: F.lag(src).over(ordered) for out, src in lag.items()},
        **{out: F.sum(src).over(so_far) for out, src in total.items()},
        **{out: F.last(src, ignorenulls=True).over(so_far) for out, src in last.items()},
    })

