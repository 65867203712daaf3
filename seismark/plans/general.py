"""Queries of the data-preparation problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.operators.instants import normalise_instants
from seismark.operators.nearby import points_near
from seismark.sources import read_table


def label_instants(labels: DataFrame) -> DataFrame:
    """``labels`` with dt as an instant; text without a zone is UTC."""
    return normalise_instants(labels, "dt", "labeller", seen_at="labelled_at")


def article_instants(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """``articles`` with date as an instant; text without a zone is the outlet's local time."""
    known = outlets.select("domain", "tz_name", "day_first").dropDuplicates(["domain"])
    return normalise_instants(articles.join(known, "domain", "left"), "date", "domain", seen_at="fetched_at", zone="tz_name", day_first="day_first")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels", "label_id", "latitude", "longitude")
    sites = read_table(spark, folder, "sites", "site_id", "latitude", "longitude")
    near = points_near(labels, "label_id", "latitude", "longitude", sites, "site_id", "latitude", "longitude", 40.0)
    return near.select(F.col("left_id").alias("label_id"), F.col("right_id").alias("site_id"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    articles = article_instants(read_table(spark, folder, "articles", "index_id", "domain", "date", "fetched_at"), read_table(spark, folder, "outlets"))
    labels = label_instants(read_table(spark, folder, "labels", "label_id", "labeller", "dt", "labelled_at"))
    rows = articles.select(F.lit("articles").alias("src"), F.col("index_id").alias("row_id"), "epoch_s").unionByName(
        labels.select(F.lit("labels").alias("src"), F.col("label_id").alias("row_id"), "epoch_s")
    )
    return rows.where(F.col("epoch_s").isNotNull()).distinct()


QUERIES = {"p5_found": p5_found, "p7_found": p7_found}

ORACLES = {
    "p5_found": """
        SELECT DISTINCT l.label_id, s.site_id
        FROM labels l JOIN sites s
          ON l.latitude BETWEEN -90 AND 90 AND l.longitude BETWEEN -180 AND 180
         AND s.latitude BETWEEN -90 AND 90 AND s.longitude BETWEEN -180 AND 180
         AND 2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(s.latitude - l.latitude) / 2), 2)
             + cos(radians(l.latitude)) * cos(radians(s.latitude)) * power(sin(radians(s.longitude - l.longitude) / 2), 2)))) <= 40.0
        WHERE l.label_id IS NOT NULL AND s.site_id IS NOT NULL
    """,
}
