"""Streams: incremental ingest, windows over events, a budget of steps.

Each function takes a streaming or a batch DataFrame alike; files of a directory are
the source here, and a checkpoint makes reruns exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = F.window("ts", size)
    out = _watermarked(events, late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    out = _watermarked(events, late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("most"))
    return out.select(F.col("window.start").alias("window_start"), "n", "most")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    out = _watermarked(events, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.withWatermark("ts", late) if events.isStreaming else ts


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there now, write each final result below `path`, and read it back."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    # complete mode: the last batch holds everything
    whole = stream.sparkSession.read.parquet(path)
    last = whole.agg(F.max("batch").alias("batch"))
    return whole.join(F.broadcast(last), "batch").drop("batch")


def incremental_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, key: str = "doc_id") -> None:
    """Append documents of new files in `source` that `target` hasn't got; a rerun adds nothing."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        if exists(spark, f"{target}/_SUCCESS"):
            fresh = fresh.join(spark.read.schema(schema).parquet(target).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def within_budget(steps: DataFrame, budget: int, by: str = "qid", order: str = "ts") -> DataFrame:
    """The first `budget` steps of each question, however many branches share it."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(by).orderBy(order, "step_id"))
    return steps.withColumn("n", n).where(F.col("n") <= budget)
