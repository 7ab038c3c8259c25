"""Streaming forms of event counts; an extension beyond batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_counts(stream: DataFrame, key: str = "event_type", ts: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    """key, ts (hour), n, total in tumbling windows; rows later than `late` are left out."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = timed.groupBy(F.window("_ts", "1 hour"), F.col(key)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(key, F.col("window.start").cast("timestamp_ntz").alias("ts"), "n", "total")


def run_to_table(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """All that is there now, by update batches; each window's last state is its row."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    kind = stream.schema.add("batch", "integer")
    return spark.read.schema(kind).parquet(f"{folder}/out/*")
