"""Nested stratified samples: one global order of which every prefix is a sample proportional by stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.running import running_sums


def global_order(records: DataFrame, seed: int, key: str = "id", stratum: str = "db_id") -> DataFrame:
    """(key, stratum, place): place counts from 1.

    Within a stratum records are ordered by a seeded hash; strata are interleaved so that each is always as far
    along as its size allows: a record's turn is the share of its stratum taken before it, ties by stratum. Ranks
    are running sums over range partitions, so a stratum with a third of all rows is spread over many tasks.
    Repeated and null keys are left out.
    """
    one = records.select(F.col(key).alias("_k"), F.col(stratum).alias("_s")).where("_k is not null").dropDuplicates(["_k"])
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce("_s", F.lit("")), "_k"), 256)
    hashed = one.select("_k", "_s", digest.alias("_h"), F.lit(1).alias("_one"))
    ranked = running_sums(hashed, ["_h", "_k"], "_one", ["_s"], "_rank")
    sizes = hashed.groupBy(F.col("_s").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    turn = (F.col("_rank") - 1) / F.col("_n")
    placed = ranked.join(sizes, F.col("_s").eqNullSafe(F.col("_t"))).select("_k", "_s", turn.alias("_turn"), "_one")
    # records of a stratum have distinct turns, so (turn, stratum) is a total order
    placed = running_sums(placed, ["_turn", "_s"], "_one", None, "place")
    return placed.select(F.col("_k").alias(key), F.col("_s").alias(stratum), F.col("place").cast("bigint").alias("place"))


def nested_samples(order: DataFrame, sizes: list[int]) -> DataFrame:
    """The first n rows of the order for each n of ``sizes``, as column ``size``; smaller samples are part of larger ones."""
    return order.withColumn("size", F.explode(F.array(*[F.lit(int(s)) for s in sizes]))).where(F.col("place") <= F.col("size"))


def stratum_counts(samples: DataFrame, stratum: str = "db_id") -> DataFrame:
    """(size, stratum, n) of nested samples."""
    return samples.groupBy("size", stratum).agg(F.count(F.lit(1)).alias("n"))


def unfit_for_sampling(records: DataFrame) -> DataFrame:
    """One row of counts of what keeps a table from being sampled: rows, null ids, repeated ids, other splits, blank gold_sql or db_id."""
    blank = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "")
    return records.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("id").isNull()).alias("null_ids"), (F.count("id") - F.count_distinct("id")).alias("repeated_ids"),
        F.count_if(F.coalesce(F.col("split") != "train", F.lit(True))).alias("other_splits"), blank(F.col("gold_sql")).alias("blank_sql"), blank(F.col("db_id")).alias("blank_db"),
    )
