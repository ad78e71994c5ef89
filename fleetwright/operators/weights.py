"""Largest-remainder split by weights that are any numbers (N3 beyond whole percents).

The split needs, for each group, the fraction at which the leftover runs out. It is found by rounds of histograms:
fractions are cut into `2**digits` bins, the bins of a group are added up from the top, and only the rows of the
bin in which the leftover ends go into the next round, which cuts that bin again. Bin edges are prefixes of binary
fractions and so exact. When all rows of that bin are equal, the leftover goes to them by position, which is
counted by slices. No group is sorted, and none is in one task: rows move by (group, slice of positions).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.operators.slices import SLICE_BITS, positions, slice_of
from fleetwright.session import stored

DIGIT_BITS = 12


def _to_rows(rows: DataFrame, per_group: DataFrame, group: str) -> DataFrame:
    """Joins one row per group to its rows, with a copy of it for each slice."""
    blocks = rows.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_in_slice")).drop("_in_slice")
    return rows.join(blocks.join(per_group, group), [group, "_slice"])


def _ends(rows: DataFrame, group: str) -> DataFrame:
    """The bin of each group in which its leftover `_k` runs out, with what is left for that bin."""
    bins = rows.groupBy(group, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_frac").alias("_least"), F.max("_frac").alias("_most"), F.any_value("_k").alias("_k"))
    from_top = Window.partitionBy(group).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = bins.withColumn("_upto", F.sum("_n").over(from_top))
    return summed.filter("_upto >= _k AND _upto - _n < _k").selectExpr(
        group, "_bin AS _end", "_k - (_upto - _n) AS _rest", "_upto = _k AS _even", "_least = _most AS _equal")


def apportion_weights(rows: DataFrame, totals: DataFrame, group: str = "cluster_id", total: str = "rem_exec",
                      weight: str = "weight", order: str = "job_idx", floor: float = 1.0, whole: float | None = 100.0,
                      bits: int = SLICE_BITS, digits: int = DIGIT_BITS) -> DataFrame:
    """Adds `base`, `extra` and `assigned`: each group's total split by largest remainder.

    A row's share is total * weight / whole; without `whole` that is the sum of the group's weights, to twelve
    decimals, so that it does not depend on the order of rows. Every row gets its floored share, at least
    `floor`; what is left goes one each by descending fraction, ties by `order`, a whole number that is distinct
    within the group. Floors may exceed the total, and a surplus may stay unassigned. Weights that are null,
    negative or no finite numbers count as zero; groups without a total are left out. `totals` has one row per
    group.
    """
    names = [c for c in rows.columns if c not in ("base", "extra", "assigned")]
    clean = f"CAST(IF({weight} > 0 AND {weight} < double('Infinity'), {weight}, 0) AS DOUBLE)"
    cut = rows.selectExpr(*names, f"{clean} AS _weight", f"{slice_of(order, bits)} AS _slice")
    given = totals.selectExpr(group, f"CAST({total} AS DOUBLE) AS _total").filter("_total IS NOT NULL")
    if whole is None:
        sums = cut.groupBy(group).agg(F.sum(F.expr("CAST(_weight AS DECIMAL(38, 12))")).cast("double").alias("_whole"))
        given = given.join(sums, group)
    else:
        given = given.withColumn("_whole", F.lit(float(whole)))
    shared = _to_rows(cut, given, group).withColumn("_share", F.expr("coalesce(_total * _weight / nullif(_whole, 0D), 0D)"))
    shared = stored(shared.selectExpr(
        *names, "_slice", "_total", f"greatest({float(floor)}D, floor(_share)) AS base", "_share - floor(_share) AS _frac"), "shares")
    left = shared.groupBy(group).agg(F.expr(
        "least(count(1), CAST(ceil(greatest(0D, max(_total) - sum(base))) AS BIGINT))").alias("_k"))
    scale = float(1 << digits)
    open_ = _to_rows(shared, left, group).withColumns({"_low": F.lit(0.0), "_scale": F.lit(scale)})
    columns, settled = [*names, "_slice", "base"], []
    while True:
        open_ = open_.withColumn("_bin", F.expr("floor((_frac - _low) * _scale)"))
        ends = stored(_ends(open_.filter("_k > 0"), group), "ends")
        placed = open_.join(_to_rows(open_.select(group, "_slice").distinct(), ends, group), [group, "_slice"], "left")
        placed = stored(placed.withColumn("extra", F.expr(
            "CASE WHEN _end IS NULL OR _bin < _end THEN 0D WHEN _bin > _end OR _even THEN 1D END")), "placed")
        settled.append(placed.filter("extra IS NOT NULL").select(*columns, "extra"))
        rest = placed.filter("extra IS NULL")
        ties = positions(rest.filter("_equal").select(*columns, "_rest").withColumnRenamed("_slice", "_kept_slice"),
                         [group], order, [order], "_turn", bits=bits)
        settled.append(ties.withColumnRenamed("_kept_slice", "_slice").selectExpr(
            *columns, "IF(_turn < _rest, 1D, 0D) AS extra"))
        if ends.filter("NOT _even AND NOT _equal").isEmpty():
            break
        open_ = rest.filter("NOT _equal").selectExpr(
            *columns, "_frac", "_rest AS _k", "_low + _bin / _scale AS _low", f"_scale * {scale}D AS _scale")
    return reduce(DataFrame.unionByName, settled).selectExpr(*names, "base", "extra", "base + extra AS assigned")
