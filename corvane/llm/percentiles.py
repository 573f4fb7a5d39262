"""Percentiles of very large numeric columns (problem 3): SQL cumulative frequencies.

State: one row per group, period and value bucket with its number of values and its least and
greatest value. States of partitions, days or runs merge by adding counts. A bucket is 1/512 of an
octave wide, so a percentile read from the state lies within ``RELATIVE_ERROR`` of the exact
(nearest-rank) one, and a state has at most 512 rows per octave of the value range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.running import running_sums

#: Buckets per octave as a power of two, and the error of a bucket's midpoint that follows from it.
BUCKET_BITS = 9
RELATIVE_ERROR = 2.0 ** -(BUCKET_BITS + 1)
PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def bucket_floor(value: Column) -> Column:
    """The lower end of the bucket of ``value``: its binary exponent and leading bits, exact in any engine.

    Zero is a bucket of its own; negative values mirror positive ones.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    exponent = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    step = F.pow(F.lit(2.0), exponent - BUCKET_BITS)
    return F.when(value == 0, F.lit(0.0)).when(size == float("inf"), value).otherwise(F.signum(value) * F.floor(size / step) * step)


def value_counts(df: DataFrame, groups: list[str], value: str, period: Column) -> DataFrame:
    """The state of ``df``: (groups, period, bucket, n, low, high).

    Null and NaN values count in no state; a null group or period is a group of its own; a repeated row
    counts as often as it stands. Aggregation is partial before the shuffle, so a group holding a third
    of all rows sends no more than its buckets from each task.
    """
    v = F.col(value).cast("double")
    return (
        df.select(*groups, period.alias("period"), v.alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("bucket", bucket_floor(F.col("_v")))
        .groupBy(*groups, "period", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    )


def merge_counts(state: DataFrame, groups: list[str]) -> DataFrame:
    """Merge states over all periods; the merged rows have a null period."""
    merged = state.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.select(*groups, F.lit(None).cast(state.schema["period"].dataType).alias("period"), "bucket", "n", "low", "high")


def percentiles(state: DataFrame, groups: list[str], shares: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Rows (groups, period, percentile, value, low, high, n_values): ``value`` is the middle of the range
    of the first bucket whose cumulative count reaches rank ceil(percentile * n_values); the exact
    nearest-rank percentile lies within [low, high].

    ``groups`` may be empty. A group without any value has no row.
    """
    keys = [*groups, "period"]
    ranked = running_sums(state, ["bucket"], "n", keys)
    totals = state.groupBy(*keys).agg(F.sum("n").alias("_all"))
    totals = totals.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "_all")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("percentile")
    at = ranked.join(totals, same).select(*keys, "n", "low", "high", "running", "_all", wanted)
    rank = F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("_all")))
    hit = at.where((F.col("running") >= rank) & (F.col("running") - F.col("n") < rank))
    middle = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.col("low") + F.col("high")) / 2)
    return hit.select(*keys, "percentile", middle.alias("value"), "low", "high", F.col("_all").alias("n_values"))


def daily_percentiles(df: DataFrame, groups: list[str], value: str, time: str) -> DataFrame:
    """Percentiles per group for each day and, merged from the days' states, for all days together
    (``scope`` "day" or "all"). Works on an empty table; a late row joins the day of its ``time``."""
    from corvane.staging import stage

    days = stage(value_counts(df, groups, value, F.to_date(time)), "day-counts")
    scoped = days.select(*groups, F.concat(F.lit("d"), F.coalesce(F.col("period").cast("string"), F.lit("?"))).alias("period"), "bucket", "n", "low", "high")
    merged = merge_counts(days, groups).select(*groups, F.lit("all").alias("period"), "bucket", "n", "low", "high")
    found = percentiles(scoped.unionByName(merged), groups)
    day = F.when(F.col("period").startswith("d") & (F.col("period") != "d?"), F.substring("period", 2, 20).cast("date"))
    return found.select(
        *groups,
        F.when(F.col("period") == "all", "all").otherwise("day").alias("scope"),
        day.alias("day"),
        "percentile", "value", "low", "high", "n_values",
    )
