"""An extension: a prediction log as a stream, with windowed latencies and error counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.staging import new_path

SCHEMA = "example_id string, generated_sql string, latency_ms double, finish_reason string, model_id string, logged_at timestamp"


def prediction_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of predictions as they arrive in a folder; of a single file, that file."""
    reader = spark.readStream.schema(SCHEMA)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(str(path.getParent().toString()))
    return reader.parquet(folder)


def windowed_latency(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(model_id, start, n, mean_latency, max_latency, n_cut): per tumbling window of logged_at; rows later than the watermark are dropped.
    The mean comes from a sum of decimals of four places, so it doesn't depend on the order of rows."""
    w = F.window("logged_at", window)
    got = stream.withWatermark("logged_at", late).groupBy("model_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("latency_ms").cast("decimal(18,4)")).cast("double") / F.count("latency_ms")).alias("mean_latency"), F.max("latency_ms").alias("max_latency"), F.count_if(F.col("finish_reason") == "length").alias("n_cut"))
    return got.select("model_id", F.col("w.start").alias("start"), "n", "mean_latency", "max_latency", "n_cut")


def run_once(frame: DataFrame) -> DataFrame:
    """Process all that is there, to its end, and return the written result. A failed stream raises."""
    spark = frame.sparkSession
    path = new_path(spark, "stream")

    def write(result: DataFrame, _: int) -> None:
        result.write.mode("overwrite").parquet(path)

    query = frame.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:  # no batch: nothing was there
        spark.createDataFrame([], frame.schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
