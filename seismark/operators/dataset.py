"""Articles with their labels: typed projection, filters that keep both sides in step, and distributions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_date(text: Column) -> Column:
    """A date written yyyy-MM-dd; null for any other text."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def typed_labels(labels: DataFrame) -> DataFrame:
    """Labels with event_occured as boolean and dt as date, every column but the key marked ``_label``."""
    typed = labels.withColumns({"event_occured": F.col("event_occured") == 1, "dt": strict_date(F.col("dt"))})
    return typed.withColumnsRenamed({c: f"{c}_label" for c in labels.columns if c != "index_id"})


def conjunction(conditions: Iterable[Column]) -> Column:
    """All of the conditions; true if there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class ArticleSet:
    """Articles and labels on index_id; a filter of one side restricts the other by a semi-join and gives a new set."""

    articles: DataFrame
    labels: DataFrame

    def joined(self) -> DataFrame:
        return self.articles.join(typed_labels(self.labels), "index_id")

    def where_articles(self, queries: list[str] | None = None, between: tuple | None = None, on_dates: list | None = None, date: str = "fetched_at") -> ArticleSet:
        """Empty or missing arguments do not filter; a range includes both ends; ``on_dates`` are days."""
        conditions = []
        if queries:
            conditions.append(F.col("query").isin(queries))
        if between:
            conditions.append(F.col(date).between(*between))
        if on_dates:
            conditions.append(F.to_date(date).isin(on_dates))
        kept = self.articles.where(conjunction(conditions))
        return ArticleSet(kept, self.labels.join(kept.select("index_id"), "index_id", "left_semi"))

    def where_labels(self, event_occured: bool | None = None, missing: Iterable[str] = (), **members: list) -> ArticleSet:
        """``members``: column name to allowed values, an empty list not filtering; ``missing``: columns that must be null."""
        conditions = [F.col(c).isin(values) for c, values in members.items() if values] + [F.col(c).isNull() for c in missing]
        if event_occured is not None:
            conditions.append(F.col("event_occured") == int(event_occured))
        kept = self.labels.where(conjunction(conditions))
        return ArticleSet(self.articles.join(kept.select("index_id"), "index_id", "left_semi"), kept)

    def strict(self) -> ArticleSet:
        """The same set; ValueError if no article is left in it."""
        if self.articles.isEmpty():
            raise ValueError("no articles are left after filtering")
        return self

    def article(self, index_id: int) -> DataFrame:
        """One article with its labels."""
        return ArticleSet(self.articles.where(F.col("index_id") == index_id), self.labels.where(F.col("index_id") == index_id)).joined()


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n: how often each value occurs, nulls left out, all columns in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("cell")
    return df.select(cells).select("cell.*").where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
