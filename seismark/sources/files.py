"""Delimited, JSON and text files with fixed schemas, and sinks that keep their layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINK_SCHEMA = "title string, url string, domain string, date string, country string, query string"
PRICE_SCHEMA = "Date string, Ticker string, Close double"


def read_links(spark: SparkSession, folder: str) -> DataFrame:
    """All link files of a folder with the file each row is from; empty files give no rows."""
    return spark.read.schema(LINK_SCHEMA).csv(folder, header=True).select("*", F.col("_metadata.file_name").alias("file_name"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICE_SCHEMA).csv(path, header=True).select(F.try_to_date("Date", "yyyy-MM-dd").alias("date"), F.col("Ticker").alias("ticker"), F.col("Close").alias("close"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string").csv(path, header=True).where(F.col("term").isNotNull()).distinct()


def read_label_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("index_id bigint, event_occured int, event string, impact int, dt string, loc string").json(path, multiLine=True)


def write_links(df: DataFrame, folder: str) -> None:
    df.write.mode("append").csv(folder, header=True)


def write_label_json(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def write_failed(df: DataFrame, url: str, folder: str) -> None:
    df.select(F.col(url).cast("string")).where(F.col(url).isNotNull()).write.mode("append").text(folder)
