"""Manifests of files and tables, and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_differences(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, problem): missing (listed, not there), untracked (there, not listed), changed (another hash),
    malformed (no hash of 64 hex digits) and outside (a path that leaves the folder)."""
    m = manifest.select(F.col("path").alias("m_path"), F.col("sha256").alias("m_hash"))
    d = disk.select(F.col("path").alias("d_path"), F.col("sha256").alias("d_hash"))
    both = m.join(d, F.col("m_path") == F.col("d_path"), "full")
    bad_path = F.col("m_path").rlike(r"^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")
    problem = (
        F.when(bad_path, "outside")
        .when(F.col("m_path").isNotNull() & ~F.coalesce(F.col("m_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "malformed")
        .when(F.col("m_path").isNull(), "untracked")
        .when(F.col("d_path").isNull(), "missing")
        .when(F.col("m_hash") != F.col("d_hash"), "changed")
    )
    return both.select(F.coalesce("m_path", "d_path").alias("path"), problem.alias("problem")).where("problem is not null")


def folder_hashes(spark: object, folder: str) -> DataFrame:
    """(path, sha256) of a folder's files, paths relative to it."""
    from corvane.functions.hashing import file_hashes

    base = folder.rstrip("/") + "/"
    files = file_hashes(spark, folder)
    return files.select(F.regexp_replace(F.expr(f"substring_index(path, '{base}', -1)"), "^/", "").alias("path"), "sha256")


def split_manifest(examples: DataFrame, key: str = "id") -> DataFrame:
    """(split, n, n_databases): rows and distinct databases of each split."""
    return examples.groupBy("split").agg(F.count(key).alias("n"), F.count_distinct("db_id").alias("n_databases"))


def valid_run_id(df: DataFrame, column: str) -> DataFrame:
    """Rows whose id has letters, digits, hyphens and underscores only, 128 at most."""
    return df.where(F.col(column).rlike(r"^[a-zA-Z0-9_\-]{1,128}$"))
