"""Checks of synthetic question and query pairs: flags and reasons per record, and their histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import first_keyword, normalize_question, normalize_sql

#: Statements that change data.
UNSAFE = ("DROP", "DELETE", "UPDATE", "ALTER", "INSERT", "TRUNCATE")


def record_flags(records: DataFrame, evaluation: DataFrame | None = None, human: DataFrame | None = None, key: str = "synthetic_id", order: str = "pos", near: DataFrame | None = None) -> DataFrame:
    """(key, pos, unsafe, repeated_id, repeated_pair, copies_human, contaminated, near_eval_id, reasons).

    "Repeated" means not the first in ``order``; first occurrences are minima per key, partial before the shuffle, so
    a pair that a third of all rows repeat is no window partition. ``near``: (train_id, eval_id, ...) from
    ``fuzzy_overlaps``; the least eval_id counts.
    """
    r = records.withColumn("nq", normalize_question(F.coalesce("question", F.lit("")))).withColumn("ns", normalize_sql(F.coalesce("sql", F.lit(""))))
    by_id = r.groupBy(F.col(key).alias("_i")).agg(F.min(order).alias("_fi"))
    by_pair = r.groupBy(F.col("nq").alias("_q"), F.col("ns").alias("_s")).agg(F.min(order).alias("_fp"))
    r = r.join(by_id, F.col(key).eqNullSafe(F.col("_i"))).join(by_pair, (F.col("nq") == F.col("_q")) & (F.col("ns") == F.col("_s")))
    r = r.withColumn("unsafe", first_keyword(F.col("sql")).isin(*UNSAFE)).withColumn("repeated_id", F.col(order) > F.col("_fi")).withColumn("repeated_pair", F.col(order) > F.col("_fp"))
    if human is not None:
        h = human.select(normalize_question(F.col("question")).alias("nq"), normalize_sql(F.col("gold_sql")).alias("ns"), F.lit(True).alias("_h")).distinct()
        r = r.join(h, ["nq", "ns"], "left")
    else:
        r = r.withColumn("_h", F.lit(None).cast("boolean"))
    if evaluation is not None:
        q = evaluation.select(normalize_question(F.col("question")).alias("nq"), F.lit(True).alias("_eq")).where("nq <> ''").distinct()
        s = evaluation.select(normalize_sql(F.col("gold_sql")).alias("ns"), F.lit(True).alias("_es")).where("ns <> ''").distinct()
        r = r.join(q, "nq", "left").join(s, "ns", "left")
    else:
        r = r.withColumn("_eq", F.lit(None).cast("boolean")).withColumn("_es", F.lit(None).cast("boolean"))
    if near is not None:
        first = near.groupBy(F.col("train_id").alias("_n")).agg(F.min("eval_id").alias("near_eval_id"))
        r = r.join(first, F.col(key) == F.col("_n"), "left")
    else:
        r = r.withColumn("near_eval_id", F.lit(None).cast("string"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    r = r.withColumn("copies_human", yes("_h")).withColumn("contaminated", yes("_eq") | yes("_es"))
    why = lambda c: F.when(F.col(c), F.lit(c))
    reasons = F.array_compact(F.array(*[why(c) for c in ("unsafe", "repeated_id", "repeated_pair", "copies_human", "contaminated")], F.when(F.col("near_eval_id").isNotNull(), F.lit("near_evaluation"))))
    return r.select(key, order, "unsafe", "repeated_id", "repeated_pair", "copies_human", "contaminated", "near_eval_id", reasons.alias("reasons"))


def reason_histogram(flags: DataFrame) -> DataFrame:
    """(reason, n) over all records."""
    return flags.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def corpus_verdict(flags: DataFrame) -> DataFrame:
    """One row (n_records, n_clean, all_clean); an empty corpus isn't clean."""
    return flags.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.size("reasons") == 0).alias("n_clean"), F.coalesce(F.bool_and(F.size("reasons") == 0), F.lit(False)).alias("all_clean"))


def first_occurrences(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with ``is_first``: whether the row is its key's first in ``order``."""
    return df.withColumn("is_first", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1)
