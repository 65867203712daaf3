"""Prices after events: forward as-of joins, returns some trading days ahead, and their correlation with event types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from seismark.session import broadcast_if_small, cut_lineage

#: Different calendar days that are broadcast at most (nearly three thousand years).
MOST_DAYS = 1_000_000


def price_steps(prices: DataFrame, ahead: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """One row per ticker and trading day with the previous day and the closes some rows ahead; repeated days count once."""
    days = prices.where(F.col("ticker").isNotNull() & F.col("date").isNotNull()).groupBy("ticker", "date").agg(F.max("close").alias("close"))
    order = Window.partitionBy("ticker").orderBy("date")
    return days.select("ticker", "date", "close", F.lag("date").over(order).alias("previous"), *[F.lead("close", k).over(order).alias(f"close_{k}d") for k in ahead])


def forward_asof(days: DataFrame, day: str, steps: DataFrame) -> DataFrame:
    """Each day with, per ticker, the first trading day at or after it; days after a ticker's last one match nothing.

    A trading day covers the calendar days since the one before it: those are spelt out and joined by equality. Before a
    ticker's first day the cover is open, so its first row also takes every earlier day asked for.
    """
    asked = days.select(F.col(day).alias("day")).where(F.col(day).isNotNull()).distinct()
    covered = steps.where(F.col("previous").isNotNull()).select("*", F.explode(F.sequence(F.date_add("previous", 1), F.col("date"))).alias("day"))
    inside = asked.join(covered, "day")
    first = steps.where(F.col("previous").isNull())
    before = first.join(broadcast_if_small(cut_lineage(asked), MOST_DAYS), F.col("day") <= F.col("date"))
    return inside.unionByName(before.select(*inside.columns)).drop("previous")


def with_returns(matched: DataFrame, ahead: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    return matched.select("*", *[F.try_divide(F.col(f"close_{k}d") - F.col("close"), F.col("close")).alias(f"return_{k}d") for k in ahead])


def correlation_from_sums(n: Column, x: Column, y: Column, xy: Column, xx: Column, yy: Column) -> Column:
    """Pearson correlation from sums; null where either side is constant."""
    spread = (n * xx - x * x) * (n * yy - y * y)
    return F.when(spread > 0, (n * xy - x * y) / F.sqrt(spread))


def event_return_correlation(events: DataFrame, event: str, day: str, prices: DataFrame, ahead: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """event, corr_<k>d: correlation, over all pairs of event and ticker, of being that type with the return k rows on.

    Pairs without all returns are left out. Events are counted per day and type and returns summed per day before the
    two meet, so the pairs themselves never exist.
    """
    counts = events.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("day"), F.col(event).alias("event")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    returns = with_returns(forward_asof(counts, "day", price_steps(prices, ahead)), ahead).dropna(subset=[f"return_{k}d" for k in ahead])
    moments = [x for k in ahead for x in (F.sum(f"return_{k}d").alias(f"s{k}"), F.sum(F.col(f"return_{k}d") * F.col(f"return_{k}d")).alias(f"q{k}"))]
    daily = returns.groupBy("day").agg(F.count(F.lit(1)).cast("double").alias("tickers"), *moments)
    met = counts.join(daily, "day")
    sums = [x for k in ahead for x in (F.sum(F.col("n") * F.col(f"s{k}")).alias(f"s{k}"), F.sum(F.col("n") * F.col(f"q{k}")).alias(f"q{k}"))]
    by_type = met.where(F.col("event").isNotNull()).groupBy("event").agg(F.sum(F.col("n") * F.col("tickers")).alias("pairs"), *sums)
    whole = met.agg(F.sum(F.col("n") * F.col("tickers")).alias("all_pairs"), *[s.alias(f"all_{name}") for s, name in zip(sums, [x for k in ahead for x in (f"s{k}", f"q{k}")])])
    joined = by_type.crossJoin(F.broadcast(whole))
    columns = [correlation_from_sums(F.col("all_pairs"), F.col("pairs"), F.col(f"all_s{k}"), F.col(f"s{k}"), F.col("pairs"), F.col(f"all_q{k}")).alias(f"corr_{k}d") for k in ahead]
    return joined.select("event", *columns)
