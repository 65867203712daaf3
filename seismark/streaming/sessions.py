"""Event streams: links kept once as they arrive, and runs of activity with bounded gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int = 50) -> DataFrame:
    """Stream over a table of a folder, whether it is a folder of Parquet files itself or one file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}") if whole else reader.option("pathGlobFilter", name).parquet(folder)


def first_of_key(stream: DataFrame, key: str, at: str, lateness: str) -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def gap_sessions(stream: DataFrame, keys: list[str], at: str, gap: str, lateness: str) -> DataFrame:
    """keys, started, ended, n: runs of rows no further apart than ``gap``, closed when the watermark passes them."""
    grouped = stream.withWatermark(at, lateness).groupBy(*keys, F.session_window(at, gap).alias("run"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("run.start").alias("started"), F.col("run.end").alias("ended"), "n")


def drain(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Process what is there, append it to a Parquet table and stop; a later call goes on from there."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output).awaitTermination()
