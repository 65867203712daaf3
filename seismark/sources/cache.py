"""Results of a stage kept under a name and its parameters, and the tables of a stored collection."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seismark.operators.ingest import keep_first, unprocessed

# The columns of the stored tables.
TABLES = {
    "articles": "index_id BIGINT, url STRING, title STRING, date BIGINT, country STRING, query STRING, blob_offset BIGINT, blob_length BIGINT",
    "labels": "index_id BIGINT, event_occured INT, event STRING, impact INT, dt STRING, loc STRING, city STRING, state STRING, country STRING, latitude DOUBLE, longitude DOUBLE",
}


def stage_path(folder: str, name: str, parameters: dict) -> str:
    """Where the result of a stage with these parameters lies; equal parameters in any order give one path."""
    code = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{folder}/{name}-{code}"


def cached(spark: SparkSession, folder: str, name: str, parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage's result, read if it was written with the same parameters before, else built and written.

    A result counts as written once its commit marker is there, so a job that was lost half-way is built again.
    """
    path = stage_path(folder, name, parameters)
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def create_tables(spark: SparkSession, database: str, location: str | None = None) -> None:
    """The tables of a stored collection, where they do not exist; ``location`` is the folder of a new database."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def append_articles(spark: SparkSession, database: str, articles: DataFrame) -> int:
    """Append the articles whose url the table does not hold, each url once, and tell how many they were."""
    stored = spark.table(f"{database}.articles")
    rows = articles.select(*stored.columns)
    rest = [c for c in stored.columns if c != "url"]
    new = unprocessed(keep_first(rows, "url", rest), "url", stored.select("url")).select(*stored.columns)
    before = stored.count()
    new.write.mode("append").insertInto(f"{database}.articles")
    return spark.table(f"{database}.articles").count() - before
