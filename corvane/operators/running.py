"""Running sums over a total order without one task holding the whole order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.staging import stage


def running_sums(df: DataFrame, order: list[str], weight: str, groups: list[str] | None = None, out: str = "running") -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same group up to and including this row.

    Rows are range-partitioned and sorted by (groups, order) and written once, so that the ranges can't
    differ between the two reads that follow: the totals of the ranges, and the sums within each range.
    A group that spans many ranges (one that holds a third of all rows, say) is summed range by range; the
    offsets are one row per range and group. ``order`` must be unique within a group for a defined result.
    Null weights count as 0; null group values form a group.
    """
    groups = groups or []
    part = "_range"
    staged = stage(
        df.repartitionByRange(*[F.col(c) for c in groups + order])
        .sortWithinPartitions(*groups, *order)
        .withColumn(part, F.spark_partition_id()),
        "ranges",
    )
    within = Window.partitionBy(part, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = before.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = staged.groupBy(part, *groups).agg(F.sum(F.coalesce(F.col(weight), F.lit(0))).alias("_total"))
    offsets = totals.select(
        F.col(part).alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"),
    )
    summed = staged.withColumn("_within", F.sum(F.coalesce(F.col(weight), F.lit(0))).over(within))
    same = F.col(part) == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = summed.join(offsets, same)
    return joined.withColumn(out, F.col("_within") + F.col("_offset")).select(*df.columns, out)
