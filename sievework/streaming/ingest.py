"""Files that arrive over time, as a stream with event-time windows. An extra beside the batch scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema: str, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, key: str, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows per window and key; rows later than `late` behind the newest are left out."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, every), key).agg(F.count("*").alias("n"))
