"""Content hashes of rows, id lists and files."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def record_json(df: DataFrame, fields: list[str]) -> Column:
    """Canonical JSON of a row: keys sorted, nulls kept."""
    return F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})


def content_hash(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row (n_rows, content_hash): a hash of all rows that depends on no order or partitioning.

    Rows are hashed, the hashes grouped by their first three hex digits and each group hashed in order, and the
    groups' hashes hashed in order: at most 4,096 values meet in one task, whatever the number of rows.
    """
    row = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(key).cast("string"), F.lit("")), record_json(df, fields)), 256)
    hashed = df.select(row.alias("h"))
    counted = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    mixed = counted.select(F.substring("h", 1, 3).alias("g"), F.sha2(F.concat_ws(":", "h", "c"), 256).alias("x"), "c")
    # sums of hash parts commute, so no group has to be collected
    parts = [F.sum(F.conv(F.substring("x", 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    groups = mixed.groupBy("g").agg(*parts, F.sum("c").alias("c"))
    one = groups.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n_rows"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "g", *[F.col(f"s{i}").cast("string") for i in range(4)])))), 256).alias("content_hash"))
    return one


def ordered_hash(df: DataFrame, order: list[str], text: str, limit: int) -> DataFrame:
    """One row (n_rows, ids_hash): SHA-256 of the ``text`` values joined by newlines, in order.

    The reference's id-list hash is a chain over the whole list, so the list has to fit one task: lists longer
    than ``limit`` are refused rather than cut.
    """
    listed = df.select(*order, text)
    if listed.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} ids; use content_hash")
    chain = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda s: s["_t"]), "\n")
    return listed.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(chain, 256).alias("ids_hash"))


def dict_hash(data: dict[str, Any]) -> str:
    """SHA-256 of the JSON with sorted keys."""
    return hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
