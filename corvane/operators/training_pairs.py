"""Prompt and target pairs for fine-tuning: admission, formatting, a toy vocabulary, label masks and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import tokens, trimmed
from corvane.operators.prompts import prompt_text

PAD, EOS, IGNORE = 0, 1, -100


def reject_reason(examples: DataFrame, known_schema: Column) -> Column:
    """Why a row is no training pair, null if it is one."""
    blank = lambda c: F.coalesce(trimmed(F.col(c)), F.lit("")) == ""
    return F.when(F.coalesce(F.col("split") != "train", F.lit(True)), "split").when(blank("question"), "blank_question").when(blank("db_id"), "blank_db_id").when(blank("gold_sql"), "blank_sql").when(~known_schema, "unknown_schema")


def training_pairs(examples: DataFrame, schemas: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(pairs, rejects): pairs (key, db_id, prompt_text, target_text), targets with a final semicolon; rejects (key, reason)."""
    joined = examples.join(schemas.select("db_id", "schema_text"), "db_id", "left")
    marked = joined.withColumn("_why", reject_reason(joined, F.col("schema_text").isNotNull()))
    sql = trimmed(F.col("gold_sql"))
    pairs = marked.where("_why is null").select(key, "db_id", prompt_text(F.col("db_id"), F.col("schema_text"), F.col("question"), F.col("evidence") if "evidence" in examples.columns else None, stub=None).alias("prompt_text"), F.when(sql.endswith(";"), sql).otherwise(F.concat(sql, F.lit(";"))).alias("target_text"))
    return pairs, marked.where("_why is not null").select(key, F.col("_why").alias("reason"))


def pair_summary(pairs: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row (n_pairs, n_rejected, n_databases, mean_prompt_chars, mean_target_chars)."""
    a = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("db_id").alias("n_databases"), F.round(F.coalesce(F.avg(F.length("prompt_text")), F.lit(0.0)), 1).alias("mean_prompt_chars"), F.round(F.coalesce(F.avg(F.length("target_text")), F.lit(0.0)), 1).alias("mean_target_chars"))
    return a.crossJoin(rejects.agg(F.count(F.lit(1)).alias("n_rejected"))).select("n_pairs", "n_rejected", "n_databases", "mean_prompt_chars", "mean_target_chars")  # one row each


def vocabulary(texts: DataFrame, text: str, order: str) -> DataFrame:
    """(token, token_id): white-space tokens numbered from 2 in the order of their first occurrence, 0 padding, 1 end.

    First occurrences are minima, partial before the shuffle; ids are running sums over range partitions.
    """
    from corvane.operators.running import running_sums

    found = texts.select(F.col(order).alias("o"), F.posexplode(tokens(F.col(text))).alias("i", "token"))
    first = found.groupBy("token").agg(F.min(F.struct("o", "i")).alias("at")).select("token", "at.o", "at.i", F.lit(1).alias("one"))
    return running_sums(first, ["o", "i"], "one", None, "r").select("token", (F.col("r") + 1).cast("bigint").alias("token_id"))


def encoded(texts: DataFrame, key: str, text: str, vocab: DataFrame, out: str) -> DataFrame:
    """(key, out array<bigint>): token ids in order; tokens outside the vocabulary are left out."""
    flat = texts.select(key, F.posexplode_outer(tokens(F.col(text))).alias("i", "token")).join(vocab, "token", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("token_id").isNotNull(), F.struct("i", "token_id")))), lambda s: s["token_id"])
    return flat.groupBy(key).agg(ids.alias(out))


def masked_labels(rows: DataFrame, max_length: int, least_target: int = 3, prompt: str = "prompt_ids", target: str = "target_ids") -> DataFrame:
    """Adds input_ids, labels, prompt_len, target_len, is_truncated and target_truncated.

    The target gets an end token if it has none; prompt labels are -100; both arrays are cut at ``max_length``, which is
    severe if the prompt fills it or fewer than ``least_target`` target tokens are left.
    """
    t = F.when(F.element_at(target, -1) == EOS, F.col(target)).otherwise(F.concat(F.col(target), F.array(F.lit(EOS).cast("bigint"))))
    t = F.when(F.size(target) > 0, t).otherwise(F.array(F.lit(EOS).cast("bigint")))
    out = rows.withColumn("_t", t).withColumn("prompt_len", F.size(prompt)).withColumn("target_len", F.size("_t"))
    over = (F.col("prompt_len") + F.col("target_len")) > max_length
    severe = over & ((F.lit(max_length) - F.col("prompt_len")) < least_target)
    labels = F.concat(F.transform(F.col(prompt), lambda _: F.lit(IGNORE).cast("bigint")), F.col("_t"))
    return out.withColumn("input_ids", F.slice(F.concat(F.col(prompt), F.col("_t")), 1, max_length)).withColumn("labels", F.slice(labels, 1, max_length)).withColumn("is_truncated", over).withColumn("target_truncated", severe).drop("_t")


def padded(rows: DataFrame, batch: str, side: str = "right") -> DataFrame:
    """input_ids, labels and attention_mask padded to the longest row of each batch. The longest rows are a grouped
    maximum, joined back, so that no task holds a batch; a null batch is one of its own."""
    if side not in ("left", "right"):
        raise ValueError("side must be left or right")
    longest = rows.groupBy(F.col(batch).alias("_batch")).agg(F.max(F.size("input_ids")).alias("_m"))
    gap = F.col("_m") - F.size("input_ids")
    fill = lambda value: F.array_repeat(F.lit(value).cast("bigint"), gap)
    join = lambda a, value: F.concat(a, fill(value)) if side == "right" else F.concat(fill(value), a)
    ones = F.transform("input_ids", lambda _: F.lit(1).cast("bigint"))
    return rows.join(longest, F.col(batch).eqNullSafe(F.col("_batch"))).select(*[c for c in rows.columns if c not in ("input_ids", "labels")], join(F.col("input_ids"), PAD).alias("input_ids"), join(F.col("labels"), IGNORE).alias("labels"), join(ones, 0).alias("attention_mask"))
