"""Grids of planned runs and size estimates of adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Widths of model families (hidden, inner, layers, key-value).
MODEL_WIDTHS = {"7b": (3584, 18944, 28, 512), "1.5b": (1536, 8960, 28, 256), "default": (4096, 11008, 32, 1024)}
ATTENTION_MODULES = ("q_proj", "k_proj", "v_proj", "o_proj")
ALL_MODULES = (*ATTENTION_MODULES, "gate_proj", "up_proj", "down_proj")


def literal(spark: SparkSession, name: str, values: list, kind: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def run_grid(spark: SparkSession, ranks: list[int], modules: list[str], seeds: list[int], alpha: float = 2.0, model: str = "7b") -> DataFrame:
    """(run_id, rank, alpha, modules, seed, parameters, size_mb): every combination, a few dozen rows."""
    h, inner, layers, kv = MODEL_WIDTHS[model]
    grid = literal(spark, "rank", ranks, "int").crossJoin(literal(spark, "modules", modules, "string")).crossJoin(literal(spark, "seed", seeds, "int"))  # the grid is the result
    width = F.when(F.col("modules") == "attention-only", 2 * (2 * h) + 2 * (h + kv)).otherwise(2 * (2 * h) + 2 * (h + kv) + 3 * (h + inner))
    size = (F.col("rank") * width * layers).cast("bigint")
    a = F.round(F.col("rank") * alpha).cast("int")
    out = grid.withColumn("alpha", a).withColumn("parameters", size)
    run = F.concat(F.lit("r"), F.col("rank").cast("string"), F.lit("_a"), F.col("alpha").cast("string"), F.lit("_"), F.replace(F.col("modules"), F.lit("-"), F.lit("_")), F.lit("_s"), F.col("seed").cast("string"))
    return out.select(run.alias("run_id"), "rank", "alpha", "modules", "seed", "parameters", F.round(F.col("parameters") * 2 / 1048576, 2).alias("size_mb"))


def scaling_grid(spark: SparkSession, sizes: list[int], seeds: list[int]) -> DataFrame:
    """(run_id, size, seed): sizes by seeds."""
    grid = literal(spark, "size", sizes, "int").crossJoin(literal(spark, "seed", seeds, "int"))  # the grid is the result
    return grid.select(F.format_string("n%d_s%d", F.col("size"), F.col("seed")).alias("run_id"), "size", "seed")


def pending_runs(plan: DataFrame, verified: DataFrame) -> DataFrame:
    """The plan with ``cached``: whether the run is among the verified ones."""
    done = verified.select("run_id", F.lit(True).alias("cached")).distinct()
    return plan.join(done, "run_id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def target_modules(tag: str) -> tuple[str, ...]:
    """Module names of a preset."""
    return ATTENTION_MODULES if tag == "attention-only" else ALL_MODULES
