"""The shadow log as a stream, beyond what a batch log gives: windowed rates as records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, time: str, key: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of a value by key and tumbling window; rows later than ``late`` are left out."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    grouped = timed.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), key)
    sums = grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a Parquet folder; once through what is there, then it stops."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
